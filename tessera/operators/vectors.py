"""Nearest neighbours and measures of clusters in a vector space."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot, unit
from tessera.session import ship

#: Bytes of vectors in a group; a task holds two groups and multiplies them in tiles.
GROUP_BYTES = 32 << 20
#: Rows and columns of a tile.
TILE, WIDE = 512, 4096
#: What stands for a vector's pair with itself, below every cosine (and its negative is an integer too).
NONE = -(2**62)


def _best(ids: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The k best of ``others`` for each of ``ids``, by cosine of 6 decimals, then by id."""
    order = np.argsort(others, kind="stable")
    others, b = others[order], b[order]
    for i in range(0, len(ids), TILE):
        own, held = ids[i : i + TILE], None
        for j in range(0, len(others), WIDE):
            # cosine in millionths above, position below: one integer a pair, all different
            key = np.rint(a[i : i + TILE] @ b[j : j + WIDE].T * 1e6).astype(np.int64) << np.int64(32)
            key -= np.arange(j, j + key.shape[1], dtype=np.int64)[None, :]
            key[own[:, None] == others[None, j : j + WIDE]] = NONE
            key = key if held is None else np.concatenate((held, key), axis=1)
            held = -np.partition(-key, k - 1, axis=1)[:, :k] if key.shape[1] > k else key
        src = np.repeat(own, held.shape[1])
        held = held.ravel()
        real = held > NONE
        src, held = src[real], held[real]
        place = -held & np.int64(2**32 - 1)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(others[place]), pa.array(((held + place) >> np.int64(32)) / 1e6)], ["src", "dst", "cosine"])


def knn(vectors: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """src, dst, cosine (6 decimals) and rank of the k nearest other vectors of each vector, exact.
    Rows without a key or vector have no neighbours.

    Vectors are dealt to groups by a hash of their key; a task takes a pair of groups, in one order
    only, and finds neighbours both ways. So a vector is shuffled once for each group, of which there are
    as many as GROUP_BYTES asks for, and afterwards k rows for each vector and group.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).cast("long").alias("id"), unit(F.col(column)).alias("v")).dropna()
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    groups = max(1, -(-n * size * 8 // GROUP_BYTES), min(-(-n // TILE), math.ceil(math.sqrt(2 * cores))))
    own = F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y")))
    dealt = rows.withColumn("own", own).select("own", "id", "v", F.explode(pairs).alias("pair")).select("pair.x", "pair.y", "own", "id", "v")

    def run(table: pa.Table) -> pa.Table:
        group, ids = (table.column(c).to_numpy() for c in ("own", "id"))
        v = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x, y = (table.column(c)[0].as_py() for c in ("x", "y"))
        a, b = group == x, group == y
        sides = [(a, b)] if x == y else [(a, b), (b, a)]  # one of two groups may be empty
        found = [batch for s, t in sides if s.any() and t.any() for batch in _best(ids[s], v[s], ids[t], v[t], k)]
        return pa.Table.from_batches(found, schema=pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("cosine", pa.float64())]))

    best = dealt.groupBy("x", "y").applyInArrow(run, "src long, dst long, cosine double")
    w = Window.partitionBy("src").orderBy(F.desc("cosine"), "dst")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def connection_strength(edges: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """c1, c2, cross and strength of each pair of labels that kNN edges join (labels: id, label)."""
    a = labels.select(F.col("id").alias("src"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    totals = labels.groupBy("label").agg((F.count(F.lit(1)) * k).alias("total"))
    cross = edges.join(a, "src").join(b, "dst").filter("la <> lb").groupBy(F.least("la", "lb").alias("c1"), F.greatest("la", "lb").alias("c2")).agg(F.count(F.lit(1)).alias("cross"))
    cross = cross.join(totals.select(F.col("label").alias("c1"), F.col("total").alias("t1")), "c1").join(totals.select(F.col("label").alias("c2"), F.col("total").alias("t2")), "c2")
    return cross.withColumn("strength", F.round(F.col("cross") / (F.col("t1") + F.col("t2")), 4)).filter("strength > 0.01").select("c1", "c2", "cross", "strength")


def mean_vectors(vectors: DataFrame, label: str, column: str) -> DataFrame:
    """label and mean vector; sums run over positions, so partial sums are made before the shuffle."""
    parts = vectors.select(label, F.posexplode(column).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def cosine_silhouette(vectors: DataFrame, column: str) -> DataFrame:
    """id, label and silhouette of (id, label, vector) under the cosine distance, exact.

    The mean distance to a label's members is 1 minus the product with the sum of their unit vectors
    over their number, so points meet labels, never each other.
    """
    units = vectors.select("id", "label", unit(F.col(column)).alias("v"))
    means = mean_vectors(units, "label", "v").join(units.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    every = means.agg(F.collect_list(F.struct(F.col("label").alias("other"), "mean", "n")).alias("labels"))  # a row for each label
    rows = units.crossJoin(every).withColumn("own", F.filter("labels", lambda x: x["other"] == F.col("label"))[0])  # one row
    n = F.col("own.n")
    inside = F.when(n > 1, 1 - (dot(F.col("v"), F.col("own.mean")) * n - dot(F.col("v"), F.col("v"))) / (n - 1))
    outside = F.array_min(F.transform(F.filter("labels", lambda x: x["other"] != F.col("label")), lambda x: 1 - dot(F.col("v"), x["mean"])))
    both = rows.select("id", "label", inside.alias("a"), outside.alias("b"))
    most = F.greatest("a", "b")
    return both.select("id", "label", F.when(F.col("a").isNull() | F.col("b").isNull() | (most == 0), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / most).alias("silhouette"))


def min_max(x: Column, *by: str, constant: float = 1.0) -> Column:
    """Scaled to 0..1 within a group; ``constant`` where all values are the same."""
    w = Window.partitionBy(*by)
    span = F.max(x).over(w) - F.min(x).over(w)
    return F.when(span < 1e-9, F.lit(constant)).otherwise((x - F.min(x).over(w)) / span)
