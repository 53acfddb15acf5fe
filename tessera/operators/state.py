"""Relational building blocks: search, merging, sets, ranks and keyed state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graphs import cut


def where(df: DataFrame, equal: dict | None = None, words: str | None = None, over: list[str] | None = None, tag: str | None = None, tags: str = "tags") -> DataFrame:
    """Rows that equal the given values, hold ``words`` literally in one of several columns, in any case, and have the tag."""
    for column, value in (equal or {}).items():
        df = df.filter(F.col(column) == value)
    if words:
        hit = F.lit(False)
        for column in over or []:
            hit = hit | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(words.lower()))
        df = df.filter(hit)
    if tag:
        df = df.filter(F.array_contains(F.from_json(tags, "array<string>"), tag))
    return df


def hybrid(semantic: DataFrame, keyword: DataFrame, k: int) -> DataFrame:
    """id, match and score of the k best hits of (id, score) and (id, weight): scored ones first."""
    both = semantic.withColumn("s", F.lit(True)).join(keyword.withColumn("w", F.lit(True)), "id", "full_outer")
    kind = F.when(F.col("s") & F.col("w"), "both").when(F.col("s"), "semantic").otherwise("keyword")
    return both.withColumn("match", kind).orderBy(F.col("score").isNull(), F.desc("score"), F.desc_nulls_last("weight"), "id").limit(k).select("id", "match", "score")


def band_best(rows: DataFrame, key: str, order: Column, value: str, reach: int) -> DataFrame:
    """For each key the ``value`` with the largest ``order`` among rows whose key is at most ``reach`` away.

    Each key's best is found before rows are spread over the band, so the band join carries
    one row for each key.
    """
    best = rows.withColumn("o", order).groupBy(key).agg(F.max(F.struct("o", F.col(value).alias("v"))).alias("b"))
    spread = best.select(F.explode(F.sequence(F.col(key) - reach, F.col(key) + reach)).alias(key), "b")
    return spread.groupBy(key).agg(F.max("b").alias("b")).select(key, F.col("b.v").alias("best"))


def remap(edges: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """Edges with ``column`` sent through (old, new); ids that aren't mapped stay."""
    return edges.join(mapping, edges[column] == mapping["old"], "left").withColumn(column, F.coalesce("new", column)).select(*edges.columns)


def before(df: DataFrame, order: list, by: list[str] | None = None, weight: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1 each) over the rows ahead of each, in an order without
    ties within ``by``, whose columns aren't null.

    Rows are sorted in ranges, so neither the table nor a group has to fit a task: a range
    sums its own rows, and a table with a row for each range says what lies ahead of it.
    """
    by = by or []
    ranged = df.withColumn("_w", F.lit(1) if weight is None else weight)
    ranged = cut(ranged.repartitionByRange(*by, *order).withColumn("_p", F.spark_partition_id()))  # ranges are sampled: fix them
    ahead = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.withColumn("_i", F.coalesce(F.sum("_w").over(ahead("_p", *by).orderBy(*order)), F.lit(0)))
    sizes = ranged.groupBy("_p", *by).agg(F.sum("_w").alias("_n"))
    sizes = sizes.withColumn("_b", F.coalesce(F.sum("_n").over(ahead(*(by or [F.lit(0)])).orderBy("_p")), F.lit(0))).drop("_n")
    return ranged.join(sizes, ["_p", *by]).select(*df.columns, (F.col("_b") + F.col("_i")).alias(name))


def percentile_rank(df: DataFrame, column: str) -> DataFrame:
    """``df`` with pr: mean 0-based rank of ties over n - 1. Ranks come from counts by value."""
    counts = before(df.groupBy(column).agg(F.count(F.lit(1)).alias("n")), [column], weight=F.col("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    pr = (F.col("before") + (F.col("n") - 1) / 2) / F.nullif(F.col("_all") - 1, F.lit(0))
    return df.join(counts.crossJoin(F.broadcast(total)).select(column, pr.alias("pr")), column)  # one row


def keep_one(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def even_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    """k rows evenly spaced in the order of a unique key, the first and the last included."""
    rows = before(df, [key], name="_at")
    total = df.agg(F.count(F.lit(1)).alias("_all"))
    steps = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.bround(j * (F.col("_all") - 1) / float(max(1, k - 1))).cast("long")))
    return rows.crossJoin(F.broadcast(total)).filter(F.array_contains(steps, F.col("_at"))).select(*df.columns)  # one row


def compare_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of both, only a, only b and the union of two sets of rows, in one join."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
    x, y = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.agg(F.count_if(x & y).alias("both_"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count(F.lit(1)).alias("union_"))


def insert_counts(new: DataFrame, held: DataFrame, key: str, order: str) -> DataFrame:
    """How many rows an insert adds and how many are duplicates, of held rows or of earlier ones."""
    rows = new.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).join(held.select(key).distinct().withColumn("_held", F.lit(True)), key, "left")
    fresh = (F.col("_r") == 1) & F.col("_held").isNull()
    return rows.agg(F.count_if(fresh).alias("inserted"), F.count_if(~fresh).alias("duplicates"))


def dispatch(commands: DataFrame, log: DataFrame, project: str, order: str, kind: str, allowed: list[str]) -> DataFrame:
    """Valid commands with the sequence each gets behind its project's last one (log: project, seq)."""
    own = Window.partitionBy(project).orderBy(order)
    valid = commands.filter(F.col(kind).isin(allowed) & F.col(project).isNotNull()).withColumn("n", F.row_number().over(own))
    return valid.join(log, project, "left").withColumn("seq", F.coalesce("seq", F.lit(0)) + F.col("n")).drop("n")


def partial_update(rows: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Rows with the allowed columns of their changes, and what came of each: kept, updated, or not found."""
    new = changes.select(key, *[F.col(c).alias(f"{c}__new") for c in allowed], F.lit(True).alias("__changed"))
    both = rows.withColumn("__known", F.lit(True)).join(new, key, "full")
    known = F.col("__known").isNotNull()
    columns = [F.when(known, F.coalesce(f"{c}__new", c)).alias(c) if c in allowed else F.col(c) for c in rows.columns]
    outcome = F.when(~known, "not found").when(F.col("__changed").isNull(), "kept").otherwise("updated")
    return both.select(*columns, outcome.alias("outcome"))


def pending(steps: DataFrame, applied: DataFrame, version: str) -> DataFrame:
    """Steps of later versions than the last applied one; applying them twice leaves nothing to do."""
    last = applied.agg(F.max(version).alias("__last"))
    return steps.crossJoin(last).filter(F.coalesce(F.col(version) > F.col("__last"), F.lit(True))).drop("__last")  # one row
