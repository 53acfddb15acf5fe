"""Texts that are shuffled by doc_id travel compressed, and are split into words where they arrive.
Where several joins on doc_id need them, they are stored in buckets of doc_id, so they move once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import bound_batches, fresh_path, shuffle_count


def _compress(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack.compress(x.as_py() or b"") for x in texts], pa.binary())], ["doc_id", "zipped"])


def compressed(docs: DataFrame) -> DataFrame:
    """doc_id and zipped text of each row; a null text is empty."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_compress, "doc_id long, zipped binary")


def stored(docs: DataFrame, name: str) -> DataFrame:
    """:func:`compressed` as a table of the shared folder in buckets of doc_id, one for each
    shuffle partition: joins on doc_id read it in place. The catalog's entry may be dropped
    with the folder once the results are written."""
    spark = docs.sparkSession
    path, n = fresh_path(spark, name), shuffle_count(spark)
    table = "tessera_" + path.rsplit("-", 1)[1]
    compressed(docs).repartition(n, "doc_id").write.bucketBy(n, "doc_id").option("path", path).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._tessera_path = path
    return out


def unzip(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, words.Words]]:
    """Like :func:`words.blocks`, of a column of zipped texts."""
    unpack = zstandard.ZstdDecompressor()
    start, n, parts = 0, 0, []
    for i, x in enumerate(column):
        parts.append(unpack.decompress(x.as_py()))
        n += len(parts[-1])
        if n >= words.BLOCK_BYTES or i + 1 == len(column):
            ends = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            yield start, i + 1, words.of_bytes(np.frombuffer(b"".join(parts), dtype=np.uint8), ends)
            start, n, parts = i + 1, 0, []
