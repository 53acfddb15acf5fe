"""Sinks, and the scans that read them back: lines, vectors with a hash, checkpoints, graphs, archives, audits."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, null fields left out."""
    df.write.mode("overwrite").json(path)


def table_hash(df: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """One row: a hash of all rows that doesn't depend on their order. Digests of rows are sorted and
    hashed within buckets, and the buckets' digests once more, so no task holds them all."""
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    digests = df.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("b"), row.alias("d"))
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    return digests.groupBy("b").agg(whole("d").alias("d")).agg(whole("d").alias("content_hash"), F.count(F.lit(1)).alias("buckets"))


def write_vectors(df: DataFrame, key: str, path: str) -> str:
    """Vectors as compressed Parquet; returns their content hash, which is written beside them."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/vectors")
    found = table_hash(df.sparkSession.read.parquet(f"{path}/vectors"), key)
    found.write.mode("overwrite").json(f"{path}/hash")
    return found.head()["content_hash"]


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """file, row and vector of the two-dimensional arrays in ``.npy`` and ``.npz`` files."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, content in zip(f["path"], f["content"], strict=True):
                found = np.load(io.BytesIO(content), allow_pickle=False)
                for name in getattr(found, "files", [""]):
                    own = np.atleast_2d(found[name] if name else found).astype(np.float32)
                    yield pd.DataFrame({"file": file, "name": name, "row": np.arange(len(own)), "vector": list(own)})

    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInPandas(run, "file string, name string, row long, vector array<float>")


def write_checkpoint(df: DataFrame, key: str, path: str) -> None:
    """Replace the partitions of the keys in ``df``; others stay. A key's files appear all at once, when the job commits."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).json(path)


def read_checkpoints(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All checkpoints below ``path``; unreadable files and lines that are no object are passed over."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", "true").json(path)
    return rows.filter("_bad is null").drop("_bad")


def write_graph(nodes: DataFrame, cites: DataFrame, similar: DataFrame, path: str, scores: list[str]) -> None:
    """Nodes with their scores as one map, and the two kinds of edges with their source."""
    packed = F.map_from_arrays(F.array(*[F.lit(c) for c in scores]), F.array(*[F.col(c).cast("double") for c in scores]))
    nodes.withColumn("scores", packed).drop(*scores).write.mode("overwrite").parquet(f"{path}/nodes")
    cites.write.mode("overwrite").parquet(f"{path}/cites")
    similar.write.mode("overwrite").parquet(f"{path}/similar")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, citations and similarities that :func:`write_graph` wrote."""
    return tuple(spark.read.parquet(f"{path}/{x}") for x in ("nodes", "cites", "similar"))


def freeze(nodes: DataFrame, labels: DataFrame, run: str) -> DataFrame:
    """Nodes (id, …) with the clusters of ``labels`` (id, cluster) and the run that set them; others keep theirs."""
    new = labels.select("id", F.col("cluster").alias("_new"))
    both = nodes.join(new, "id", "left")
    changed = F.col("_new").isNotNull()
    return both.withColumns({"cluster": F.coalesce("_new", "cluster"), "run_id": F.when(changed, F.lit(run)).otherwise(F.col("run_id"))}).select(nodes.columns)


def archive_kind(content: Column) -> Column:
    """What a downloaded file is, by its first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    tar = F.substring(content, 258, 5) == F.lit(b"ustar")
    return F.when(head.startswith("25504446"), "pdf").when(head.startswith("1F8B"), "gzip").when(head.startswith("504B0304"), "zip").when(tar, "tar").otherwise("other")


def gathered_sources(files: DataFrame) -> DataFrame:
    """paper, bbl, tex and bib of files (paper, name, text): each kind's texts in the order of their names."""
    of = lambda ending: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.lower("name").endswith(ending), F.struct("name", "text")))), lambda x: x["text"]), "\n").alias(ending[1:])
    return files.groupBy("paper").agg(of(".bbl"), of(".tex"), of(".bib"))


def audit(df: DataFrame, reason: str, title: str) -> DataFrame:
    """A Markdown report, a row for each reason: count, smallest and largest id."""
    rows = df.groupBy(reason).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))
    line = F.concat(F.lit(f"## {title}: "), F.coalesce(F.col(reason), F.lit("?")), F.lit("\n\n"), F.format_string("%d rows, from %s to %s\n", "n", F.col("least").cast("string"), F.col("most").cast("string")))
    return rows.select(reason, "n", line.alias("markdown"))
