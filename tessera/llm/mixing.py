"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Targets: sources in order of code points, null last, weigh 5, 2, 1, repeating, and share
``share`` times all sizes; a target stops at ``most`` times its source's size and the excess
is reshared by weight until none is above. That end is one water level, so it is computed
in closed form: sources are sorted by the level at which they fill up, and the level is
what is left divided by the weights that are left.

Sampling: a document of a source expects target / source size copies. Documents stand in
order of (size, hash bucket, doc_id) within their source; the expected copies are summed up
in that order, the source's random offset is added, and a copy is emitted for each integer
boundary crossed. Sizes in order keep each source's words within about one document of its
target, and no document gets more than ``most`` copies.

The prefix sum needs no task that holds a source: counts by (source, size) and by
(source, size, bucket) are summed up as small tables, and rows are numbered only within one
bucket, of which a source and size have 4,096.

Defined results: a null text has size 0; a null source is a source of its own, the last one;
an empty source has target 0; rows may repeat, each is sampled; offsets are hashes of the
source's name and ``seed``, so that reruns agree. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, columns, free_name, staged
from tessera.llm.exact_dedup import located

WEIGHTS = (5, 2, 1)


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """source, source_size, target from rows of (source, source_size), one per source."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    weighed = weighed.withColumn("cap", F.lit(most) * F.col("source_size"))
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    levels = weighed.withColumns(
        {
            "left": F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(after),
        }
    ).withColumn("level", F.col("left") / F.col("open"))
    # the level is that of the first source, in order of filling up, which does not fill up; later ones only fall
    first = F.max(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.col("level"))).over(everything)
    target = F.when(first.isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * first, F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def hash_bucket(column: str) -> Column:
    """One of 4,096 buckets, as three hex digits."""
    return F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))), 1, 3)


def random_offset(source: Column, seed: str) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: str = "mix:", row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of ``docs``,
    with the column ``row``, if named, which also settles ties."""
    own = [row] if row else []
    sized = docs.select("doc_id", "source", *own, word_count().alias("size"))
    # the texts are read once; what follows works on the narrow table
    sized = staged(sized.withColumn("bucket", hash_bucket("doc_id")), "mix-sizes")
    by_bucket = sized.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    by_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, most)

    def earlier(*keys: str, by: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(w), F.lit(0))

    smaller = by_size.select("source", "size", earlier("source", by="size").alias("smaller"))
    smaller = smaller.join(targets, smaller["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    before = by_bucket.select("source", "size", "bucket", earlier("source", "size", by="bucket").alias("before"))
    ranked = sized.withColumn("within", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("doc_id", *own)))

    null = "\x00"  # joins on nullable sources by a key that stands for null, apart from every name
    key = F.when(F.col("source").isNull(), F.lit(null)).otherwise(F.concat(F.lit("="), F.col("source"))).alias("key")
    ranked, before, smaller = ranked.select(key, "*"), before.select(key, "size", "bucket", "before"), smaller.select(key, "size", "smaller", "source_size", "target")
    offsets = before.join(smaller, ["key", "size"])
    rows = ranked.join(offsets, ["key", "size", "bucket"])
    rank = F.col("smaller") + F.col("before") + F.col("within")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    boundary = lambda r: F.floor(each * r + random_offset(F.col("source"), seed))
    rows = rows.withColumn("copies", (boundary(rank) - boundary(rank - 1)).cast("long"))
    return rows.select("doc_id", "source", *own, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: str = "mix:") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows are told apart by where they
    are stored. Its columns stay, whatever their names."""
    rows, at = located(docs)
    narrow = rows.select("doc_id", "source", "text", F.col(at).alias("at"))
    n = free_name(rows, "tessera_copies")
    copies = staged(mix_sources(narrow, share, most, seed, row="at").filter("copies > 0").select(F.col("at").alias(at), F.col("copies").alias(n)), "mix-copies")
    taken = rows.join(copies, at)
    return taken.withColumn(free_name(taken, "tessera_copy"), F.explode(F.sequence(F.lit(1), F.col(n)))).select(*columns(docs))
