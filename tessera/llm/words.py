"""Vectorised words of whole texts: one pass of numpy over an Arrow string column.

Words are ``[^\\x20\\x09-\\x0D]+``. Every separator is a single ASCII byte and no byte of
a multi-byte UTF-8 character equals one, so words are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tessera.llm.common import slices

_U = np.uint64
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Texts are cut into blocks of rows with so many bytes in all; a longer text is a block of its own.
BLOCK_BYTES = 512 << 10

#: Base of the polynomial word hash and its inverse modulo 2**64, and per-byte random values.
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of the texts of one block. ``first[i]:first[i + 1]`` are those of row i."""

    data: np.ndarray  # bytes of the block
    row_start: np.ndarray  # byte offset of each row, and the end
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    first: np.ndarray  # index of each row's first word, and the end

    def __len__(self) -> int:
        return len(self.row_start) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), self.counts())

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes; with ``lower``, of them with A-Z lowered."""
        if not len(self.start):
            return np.empty(0, dtype=_U)
        values = _BYTE_VALUE[_LOWER] if lower else _BYTE_VALUE
        with np.errstate(over="ignore"):
            powers, inverses = _powers(len(self.data))
            total = np.empty(len(self.data) + 1, dtype=_U)
            total[0] = 0
            np.cumsum(values[self.data] * powers[: len(self.data)], out=total[1:])
            out = (total[self.end] - total[self.start]) * inverses[self.start]
            return mix(out ^ ((self.end - self.start).astype(_U) << _U(48)))

    def text(self, i: int) -> bytes:
        return self.data[self.row_start[i] : self.row_start[i + 1]].tobytes()


_CACHE: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _CACHE or len(_CACHE["p"]) < n + 1:
        size = max(n + 1, BLOCK_BYTES + 1)
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(size, base, dtype=_U)
            x[0] = 1
            with np.errstate(over="ignore"):
                np.cumprod(x, out=x)
            if n > 4 * BLOCK_BYTES:  # one very long text; don't keep that much
                _CACHE[f"long {key}"] = x
            else:
                _CACHE[key] = x
        if n > 4 * BLOCK_BYTES:
            return _CACHE.pop("long p"), _CACHE.pop("long i")
    return _CACHE["p"], _CACHE["i"]


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """Yield (first row, row behind the last, Words) over an Arrow column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, dtype=np.uint8)
    for a, b in slices(np.diff(offsets), block_bytes):
        yield a, b, of_bytes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def of_bytes(data: np.ndarray, row_start: np.ndarray) -> Words:
    """Words of concatenated texts; a row's end always ends a word."""
    inside = ~_IS_SEPARATOR[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[row_start] = True
    cuts = np.flatnonzero(edge)
    if len(data):
        keep = inside[cuts[:-1]]
        start, end = cuts[:-1][keep], cuts[1:][keep]
    else:
        start = end = np.empty(0, dtype=np.int64)
    return Words(data, row_start, start, end, np.searchsorted(start, row_start))


def shingles(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within a row: (hash, index of the first word)."""
    if len(words) < n:
        return np.empty(0, dtype=_U), np.empty(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        size = len(words) - n + 1
        out = np.zeros(size, dtype=_U)
        for i in range(n):
            out = out * _U(_BASE) + words[i : i + size]
        at = np.flatnonzero(row[:size] == row[n - 1 :])
        return mix(out[at]), at
