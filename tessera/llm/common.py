"""What the training-data operators share: the shared folder, staged tables, batch limits."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import shared_folder, ship

#: The six separators of the contracts: space and U+0009 to U+000D.
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Upper bound of one Arrow batch handed to a Python worker.
BATCH_BYTES = 4 << 20


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and the
    table outlives any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes of a staged table's files."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._tessera_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has (column names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(df: DataFrame) -> list[Column]:
    """The columns of ``df``, whatever characters are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


#: A lookup table is broadcast up to so many rows, each of numbers or a digest (some 20 MB); beyond, it is joined by a shuffle.
LOOKUP_ROWS = 200_000


def looked_up(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Left join with a narrow staged table that has at most one row of each key. Wide rows aren't
    shuffled where the table's size, which is counted first, allows a broadcast."""
    small = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return rows.join(F.broadcast(table) if small else table, list(keys), "left")


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by bytes, so that long texts don't add up in a worker; and see
    that workers can import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def shuffle_count(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def empty_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def slices(sizes, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to ``most`` at most, or single rows above it."""
    start = total = end = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
        end = i + 1
    if end > start:
        yield start, end
