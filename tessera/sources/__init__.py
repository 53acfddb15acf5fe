"""Readers of semi-structured inputs, with explicit schemas."""
