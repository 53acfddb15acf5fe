"""Packed hash records: many small records travel through Spark as few binary rows.

A task sorts its records by hash, cuts them into buckets of the hash range and sends one
blob per bucket; columns are stored with the fewest bytes that hold their largest value.
The receiving side reads one bucket at a time. Buckets are ranges of uniform hashes, so
their sizes are even, and there are as many as the bytes of the input ask for, so that a
bucket's size doesn't grow with the input; groups that are large within a task are settled there and send one
record on, so that no hash is hot.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shuffle_count, stored_bytes

#: Records that a task gathers before it sends them on.
CHUNK = 2_000_000
#: Bytes of zipped text whose records share a bucket, on average.
BUCKET_BYTES = 8 << 20

SCHEMA = "bucket int, settled boolean, blob binary"


def _narrow(x: np.ndarray) -> bytes:
    x = x.astype(np.uint64)
    base = int(x.min()) if len(x) else 0
    x = x - np.uint64(base)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return struct.pack("<QB", base, width) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def pack(h: np.ndarray, *columns: np.ndarray) -> bytes:
    """Records sorted by ``h`` (uint64) with further columns of integers (int64)."""
    steps = np.diff(h, prepend=h[:1]) if len(h) else h
    return struct.pack("<QQ", len(h), int(h[0]) if len(h) else 0) + b"".join(_narrow(c.view(np.uint64) if c.dtype == np.int64 else c) for c in (steps, *columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    n, first = struct.unpack_from("<QQ", blob)
    at, out = 16, []
    while at < len(blob):
        base, width = struct.unpack_from("<QB", blob, at)
        at += 9
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=at).reshape(n, width)
        out.append(x.view(np.uint64).reshape(-1) + np.uint64(base))
        at += n * width
    out[0] = np.cumsum(out[0], dtype=np.uint64) + np.uint64(first)
    return [out[0], *[c.view(np.int64) for c in out[1:]]]


class Chunk:
    """Gathers arrays of records until there are CHUNK of them."""

    def __init__(self, most: int = CHUNK):
        self.most, self.parts, self.n = most, [], 0

    def add(self, *columns: np.ndarray) -> bool:
        self.parts.append(columns)
        self.n += len(columns[0])
        return self.n >= self.most

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts, strict=True)] if self.parts else []
        self.parts, self.n = [], 0
        return out


def by_bucket(buckets: int, h: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Blobs of records sorted by ``h``, one for each bucket of the hash range."""
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield int(b), pack(h[s], *[c[s] for c in columns])


def bucket_count(texts: DataFrame) -> int:
    """Buckets for records of staged texts: by their bytes, and two for each core at least."""
    spark = texts.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, -(-stored_bytes(texts) // BUCKET_BYTES))


def batch(rows: Iterable[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, settled, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(settled, pa.bool_()), pa.array(blob, pa.binary())], ["bucket", "settled", "blob"])


def received(packed: DataFrame, work: Callable[[list[np.ndarray], list[np.ndarray]], pa.RecordBatch | None], schema: str, buckets: int) -> DataFrame:
    """Run ``work(records, settled records)`` on each of ``buckets`` buckets of rows (bucket, settled, blob)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, open_, done = None, [], []
        for b in batches:
            for bucket, settled, blob in zip(b.column("bucket").to_pylist(), b.column("settled").to_pylist(), b.column("blob"), strict=True):
                if bucket != current:
                    if open_ or done:
                        yield from _work(work, open_, done)
                    current, open_, done = bucket, [], []
                (done if settled else open_).append(unpack(blob.as_py()))
        if open_ or done:
            yield from _work(work, open_, done)

    return packed.repartition(max(shuffle_count(packed.sparkSession), buckets // 2), "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _work(work: Callable, open_: list, done: list) -> Iterator[pa.RecordBatch]:
    join = lambda x: [np.concatenate(c) for c in zip(*x, strict=True)] if x else []
    out = work(join(open_), join(done))
    if out is not None:
        yield out


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys (first is major), and the starts of equal keys in that order."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def per_row(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A value of each group, for each of its n rows in order."""
    return np.repeat(values, np.diff(np.append(starts, n)))
