"""Exact dedup as a stateful stream (DataFrame operations only).

A narrow log of (digest, stable identifier, length, content locator) is streamed into a
keyed aggregation whose state lives in RocksDB and never expires: no watermark, one entry
per digest with the best row so far, its content locator and the number of rows. A hit on
an existing digest is only taken for a copy after the full normalised bytes of the row and
of the retained row, fetched by its locator, compare equal; rows that differ in spite of
equal digests are grouped again by their bytes.

Defined results: null text counts as empty, and all empty texts are one group. Of equal
texts the row with the most code points stays, then the smallest doc_id (null last), then
the first by file and row, so of repeated rows exactly one stays. An empty table gives an
empty result. Further columns of the input are neither read nor returned.

Partial aggregation reduces a large group of copies to one state update per task, and
the two joins on digests are plain equi-joins, which adaptive execution splits where a
digest is hot. No row is sent to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tessera.llm.common import SEPARATORS, columns, empty_text, free_name, fresh_path, staged

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # entries are small and stores are many: write changes only, and don't reserve disk ahead
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Bytes of the digest log taken into one micro-batch.
BYTES_PER_TRIGGER = str(1 << 30)


def normalised(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``."""
    return F.translate(text, SEPARATORS, "")


def located(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a stable locator of each row, file and row of the table it is read from, and
    the locator's name, which no column of ``docs`` has. Rows that come from no file, and those
    with a column that hides the file's metadata, are written to the shared folder first."""
    at = free_name(docs, "tessera_at")
    locator = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(at)
    if free_name(docs, "_metadata") == "_metadata":
        try:
            return docs.select(*columns(docs), locator), at
        except AnalysisException:
            pass
    plain = [f"c{i}" for i in range(len(docs.columns))]
    stored = staged(docs.toDF(*plain), "located")
    return stored.select(*[F.col(c).alias(name) for c, name in zip(plain, docs.columns, strict=True)], locator), at


def digest_log(docs: DataFrame, digest_length: int = 64) -> DataFrame:
    """doc_id, digest, key (what the state is keyed by), code points and locator of each row (doc_id, text, at)."""
    digest = F.sha2(normalised(empty_text()).cast("binary"), 256)
    return docs.select("doc_id", digest.alias("digest"), F.char_length(empty_text()).cast("long").alias("n"), "at").withColumn("key", F.substring("digest", 1, digest_length))


def _best() -> Column:
    """Smallest first: most code points, doc_id with nulls last, locator."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("at"))


def stream_state(log: DataFrame, checkpoint: str, out: str) -> None:
    """Run the stateful stream over a streaming digest log until its input is used up.

    Every micro-batch writes the entries that it changed below ``out``; ``checkpoint`` keeps
    offsets and state, so a restarted stream goes on where it was.
    """
    spark = log.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        query = (
            log.groupBy("key")
            .agg(F.count(F.lit(1)).alias("size"), F.min(_best()).alias("best"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def retained(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, size and best row of each digest, the last state of a stream over ``log``; and the log as written."""
    spark = log.sparkSession
    path, out = fresh_path(spark, "dedup-log"), fresh_path(spark, "dedup-state")
    log.write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxBytesPerTrigger", BYTES_PER_TRIGGER).parquet(path)
    stream_state(stream, fresh_path(spark, "dedup-checkpoint"), out)
    schema = "key string, size long, best struct<n: long, no_id: boolean, id: long, at: struct<file: string, row: long>>"
    changed = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out) if _exists(spark, out) else spark.createDataFrame([], schema)
    # the count of a digest only grows, so its largest is the last
    last = changed.groupBy("key").agg(F.max(F.struct("size", "best")).alias("last"))
    return last.select("key", "last.size", "last.best"), spark.read.schema(log.schema).parquet(path)


def _exists(spark, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def exact_dedup(docs: DataFrame, digest_length: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 and the locator ``at``.

    ``digest_length`` shortens the state's key (hex digits); shorter keys collide and only
    cost more comparisons of bytes.
    """
    rows, at = located(docs)
    return _deduped(rows.select("doc_id", "text", F.col(at).alias("at")), digest_length)


def _deduped(docs: DataFrame, digest_length: int = 64) -> DataFrame:
    """:func:`exact_dedup` of rows (doc_id, text, at)."""
    state, log = retained(digest_log(docs, digest_length))
    state = staged(state, "dedup-retained")
    content = docs.select("at", normalised(empty_text()).alias("bytes"), F.char_length(empty_text()).cast("long").alias("n"), "doc_id")
    content = content.withColumn("key", F.substring(F.sha2(F.col("bytes").cast("binary"), 256), 1, digest_length))
    hits = staged(content.join(state.filter("size > 1"), "key"), "dedup-hits")
    first = hits.filter(F.col("at") == F.col("best.at")).select("key", F.col("bytes").alias("kept_bytes"))
    differ = hits.filter(F.col("at") != F.col("best.at")).join(first, "key").filter(F.col("bytes") != F.col("kept_bytes"))
    differ = staged(differ.select("key"), "dedup-differ").distinct()

    rows = log.join(state, "key")
    if not differ.isEmpty():
        inner = hits.join(differ, "key", "left_semi").drop("best", "size")
        groups = inner.groupBy("key", "bytes").agg(F.count(F.lit(1)).alias("own_size"), F.min(_best()).alias("own"))
        own = staged(inner.join(groups, ["key", "bytes"]).select("at", "own", "own_size"), "dedup-own")
        rows = rows.join(own, "at", "left").withColumns({"best": F.coalesce("own", "best"), "size": F.coalesce("own_size", "size")})
    return rows.select(
        "doc_id",
        F.when(~F.col("best.no_id"), F.col("best.id")).alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("at") == F.col("best.at")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "at",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without the copies that :func:`exact_dedup` drops; its columns and order of columns
    stay, whatever their names."""
    rows, at = located(docs)
    gone = _deduped(rows.select("doc_id", "text", F.col(at).alias("at"))).filter(~F.col("kept")).select(F.col("at").alias(at))
    return rows.join(gone, at, "left_anti").select(*columns(docs))
