"""Queries over the vector table: neighbours, centroids, radii, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import plane as OP
from tessera.operators import vectors as OV
from tessera.plans.registry import query
from tessera.session import table

K = 15
#: Cosines as the checks see them, all pairs.
COSINES = """
WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u),
pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) AS cosine
          FROM n a JOIN n b ON a.vec_id <> b.vec_id),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS rank FROM pairs) WHERE rank <= 15)
"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OV.knn(_vectors(spark, sf_dir), "vec_id", "embedding", K)


@query("agg13_connection_strength", COSINES + """
, t AS (SELECT label, count(*) * 15 AS total FROM embeddings GROUP BY label),
c AS (SELECT least(a.label, b.label) AS c1, greatest(a.label, b.label) AS c2, count(*) AS cross_
      FROM knn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE a.label <> b.label GROUP BY 1, 2)
SELECT c1, c2, cross_ AS "cross", round(cross_ / (x.total + y.total), 4) AS strength
FROM c JOIN t x ON x.label = c1 JOIN t y ON y.label = c2
WHERE round(cross_ / (x.total + y.total), 4) > 0.01 ORDER BY strength DESC, c1, c2 LIMIT 50
""")
def connection_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label")
    return OV.connection_strength(_edges(spark, sf_dir), labels, K).orderBy(F.desc("strength"), "c1", "c2").limit(50)


@query("jn17_knn_edges", COSINES + "SELECT src, dst, cosine, rank FROM knn WHERE cosine >= 0.30")
def knn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("cosine >= 0.30")


@query("set08_undirected_edges", COSINES + "SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM knn WHERE cosine >= 0.30")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("cosine >= 0.30").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


@query("fn22_vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"))


@query("jn19_vector_search", COSINES + "SELECT dst AS vec_id, cosine AS score FROM pairs WHERE src = (SELECT min(vec_id) FROM embeddings) ORDER BY score DESC, vec_id LIMIT 20")
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    wanted = v.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("q"), F.col("embedding").alias("e"))
    scored = v.crossJoin(F.broadcast(wanted)).filter("vec_id <> q")  # one row by its limit
    return scored.select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("e")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(20)


MEANS = """
WITH p AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM p GROUP BY label, i),
s AS (SELECT p.vec_id, p.label, sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))) AS c, sqrt(sum((x - m) * (x - m))) AS d
      FROM p JOIN m USING (label, i) GROUP BY 1, 2)
"""


def _to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    e, m = F.col("embedding"), F.col("mean")
    apart = F.sqrt(F.aggregate(F.zip_with(V.as_double(e), m, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return v.join(OV.mean_vectors(v, "label", "embedding"), "label").select("vec_id", "label", V.cosine(e, m).alias("c"), apart.alias("d"))


@query("agg08_mean_vector", MEANS + "SELECT label, i, round(m, 6) AS m FROM m")
def mean_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = OV.mean_vectors(_vectors(spark, sf_dir), "label", "embedding")
    return means.select("label", F.posexplode("mean").alias("j", "x")).select("label", (F.col("j") + 1).cast("long").alias("i"), F.round("x", 6).alias("m"))


@query("ml07_centroid_similarity", MEANS + "SELECT vec_id, label, round(c, 6) AS centrality FROM s")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_centroid(spark, sf_dir).select("vec_id", "label", F.round("c", 6).alias("centrality"))


@query("win03_nearest_to_centroid", MEANS + "SELECT label, vec_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(c, 6) DESC, vec_id) AS r FROM s) WHERE r <= 10")
def nearest_to_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.desc(F.round("c", 6)), "vec_id")
    return _to_centroid(spark, sf_dir).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("label", "vec_id", "rank")


@query("win05_membership", MEANS + """SELECT vec_id, label, round(CASE WHEN max(c) OVER w - min(c) OVER w < 1e-9 THEN 1 ELSE (c - min(c) OVER w) / (max(c) OVER w - min(c) OVER w) END, 5) AS membership
FROM s WINDOW w AS (PARTITION BY label)""")
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_centroid(spark, sf_dir).select("vec_id", "label", F.round(OV.min_max(F.col("c"), "label"), 5).alias("membership"))


@query("win06_centrality", MEANS + "SELECT vec_id, label, round(CASE WHEN max(d) OVER w = 0 THEN 1 ELSE 1 - d / max(d) OVER w END, 5) AS centrality FROM s WINDOW w AS (PARTITION BY label)")
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = F.max("d").over(Window.partitionBy("label"))
    return _to_centroid(spark, sf_dir).select("vec_id", "label", F.round(F.when(most == 0, F.lit(1.0)).otherwise(1 - F.col("d") / most), 5).alias("centrality"))


@query("win07_rank_in_cluster", MEANS + "SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY round(d, 6), vec_id) AS rank FROM s")
def rank_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy(F.round("d", 6), "vec_id")
    return _to_centroid(spark, sf_dir).select("vec_id", "label", F.row_number().over(w).alias("rank"))


@query("agg09_radius_p90", MEANS + "SELECT label, round(quantile_cont(d, 0.9), 5) AS radius FROM s GROUP BY label")
def radius_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_centroid(spark, sf_dir).groupBy("label").agg(F.round(F.percentile("d", F.lit(0.9)), 5).alias("radius"))


@query("agg10_positional_radius", MEANS + "SELECT label, round(list_sort(list(d))[(floor(count(*) * 0.85))::INT + 1], 5) AS radius FROM s GROUP BY label")
def positional_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("label").orderBy("d", "vec_id")
    ranked = _to_centroid(spark, sf_dir).select("label", "d", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy("label")).alias("n"))
    return ranked.filter(F.col("i") == F.floor(F.col("n") * 0.85)).select("label", F.round("d", 5).alias("radius"))


XY = "WITH c AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


def _plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _vectors(spark, sf_dir).select("vec_id", "label", e[0].cast("double").alias("x"), e[1].cast("double").alias("y"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).withColumnRenamed("vec_id", "id")


@query("agg06_centroids", XY + "SELECT label, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM c GROUP BY label")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).groupBy("label").agg(F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"), F.count(F.lit(1)).alias("n"))


@query("agg07_median_centroids", XY + "SELECT label, round(median(x), 6) AS mx, round(median(y), 6) AS my FROM c GROUP BY label")
def median_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).groupBy("label").agg(F.round(F.median("x"), 6).alias("mx"), F.round(F.median("y"), 6).alias("my"))


@query("agg32_extent", XY + "SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM c")
def extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plane(spark, sf_dir).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.round(F.avg("x"), 6).alias("mx"), F.round(F.avg("y"), 6).alias("my"))


@query("agg35_territory", XY + ", m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY label) SELECT c.label, round(greatest(max(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 0.1), 6) AS radius FROM c JOIN m USING (label) GROUP BY c.label")
def territory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir)
    m = p.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return p.join(m, "label").groupBy("label").agg(F.round(F.greatest(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy"))), F.lit(0.1)), 6).alias("radius"))


@query("prj09_padded_scale", XY + "SELECT vec_id, round(0.05 + 0.9 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS px, round(0.05 + 0.9 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS py FROM c")
def padded_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir)
    box = p.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    scale = lambda v, a, b: F.round(0.05 + 0.9 * (F.col(v) - F.col(a)) / (F.col(b) - F.col(a)), 6)
    return p.crossJoin(F.broadcast(box)).select("vec_id", scale("x", "x0", "x1").alias("px"), scale("y", "y0", "y1").alias("py"))  # one row


@query("jn18_plane_knn", XY + """, d AS (SELECT a.vec_id AS src, b.vec_id AS dst, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2
FROM c a JOIN c b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT src, dst, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM d) WHERE r <= 3""")
def plane_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OP.knn(_points(spark, sf_dir), 3, by="label").select("src", "dst", "rank")


_NEAR = """, d AS (SELECT a.vec_id AS src, b.vec_id AS dst, a.label AS la, b.label AS lb, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), 9) AS d2 FROM c a JOIN c b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS r FROM d) WHERE r <= {k})"""


@query("prj22_displacement", XY + _NEAR.format(k=12) + """, e AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) AS l FROM near)
SELECT src, dst, round(bx + (bx - ax) / (CASE WHEN l = 0 THEN 1 ELSE l END) * 18.0::DOUBLE, 6) AS x, round(by_ + (by_ - ay) / (CASE WHEN l = 0 THEN 1 ELSE l END) * 18.0::DOUBLE, 6) AS y FROM e""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each point's 12 nearest, moved away from it."""
    p = _points(spark, sf_dir)
    return OP.pushed(OP.knn(p, 12), p, 18.0).select("src", "dst", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_PLANE_SILHOUETTE = """, e AS (SELECT src, la, lb, avg(sqrt((ax - bx) * (ax - bx) + (ay - by_) * (ay - by_))) AS d FROM d GROUP BY 1, 2, 3),
s AS (SELECT src, max(d) FILTER (la = lb) AS a, min(d) FILTER (la <> lb) AS b FROM e GROUP BY 1), sil AS (SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM s)"""


@query("ml06_territory", XY + _NEAR.format(k=10) + _PLANE_SILHOUETTE + """, m AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM c GROUP BY 1),
o AS (SELECT vec_id, c.label, arg_min(m.label, ((x - cx) * (x - cx) + (y - cy) * (y - cy), m.label)) AS nearest FROM c, m GROUP BY 1, 2),
q AS (SELECT (SELECT avg((la = lb)::INT) FROM near) AS purity, (SELECT avg((label = nearest)::INT) FROM o) AS centroid, (SELECT v FROM sil) AS silhouette)
SELECT round(purity, 5) AS purity, round(centroid, 5) AS centroid, round(silhouette, 5) AS silhouette, round((purity + centroid + (silhouette + 1) / 2) / 3, 5) AS territory FROM q""")
def territory_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(spark, sf_dir)
    label = lambda c, to: p.select(F.col("id").alias(c), F.col("label").alias(to))
    purity = OP.knn(p, 10).join(label("src", "la"), "src").join(label("dst", "lb"), "dst").agg(F.avg((F.col("la") == F.col("lb")).cast("int")).alias("purity"))
    centroid = OP.nearest_centre(p, "label").agg(F.avg((F.col("label") == F.col("nearest")).cast("int")).alias("centroid"))
    whole = _silhouettes(spark, sf_dir).agg(F.avg("silhouette").alias("silhouette"))
    score = (F.col("purity") + F.col("centroid") + (F.col("silhouette") + 1) / 2) / 3
    return purity.crossJoin(centroid).crossJoin(whole).select(*[F.round(c, 5).alias(c) for c in ("purity", "centroid", "silhouette")], F.round(score, 5).alias("territory"))  # one row each


@query("ml05_silhouette_cosine", """WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u),
d AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_dot_product(a.v, b.v) / (a.norm * b.norm)) AS d FROM n a JOIN n b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY 1, 2)
SELECT label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s GROUP BY label""")
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OV.cosine_silhouette(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "label", "embedding"), "embedding").groupBy("label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))


@query("ml06_neighbour_purity", COSINES + "SELECT a.label, round(avg((a.label = b.label)::INT), 6) AS purity FROM knn JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst WHERE rank <= 10 GROUP BY a.label")
def neighbour_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _vectors(spark, sf_dir)
    a, b = labels.select(F.col("vec_id").alias("src"), "label"), labels.select(F.col("vec_id").alias("dst"), F.col("label").alias("other"))
    return _edges(spark, sf_dir).filter("rank <= 10").join(a, "src").join(b, "dst").groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("purity"))


@query("ml05_silhouette", XY + """, d AS (SELECT a.vec_id, a.label, b.label AS other, avg(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d
FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, max(d) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM d GROUP BY 1, 2)
SELECT label, round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s GROUP BY label""")
def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _silhouettes(spark, sf_dir).groupBy("label").agg(F.round(F.avg("silhouette"), 5).alias("silhouette"))


def _silhouettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _plane(spark, sf_dir)
    q = p.select(F.col("vec_id").alias("v2"), F.col("label").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    d = p.crossJoin(q).filter("vec_id <> v2").groupBy("vec_id", "label", "other").agg(F.avg(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))).alias("d"))
    s = d.groupBy("vec_id", "label").agg(F.max(F.when(F.col("label") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("label") != F.col("other"), F.col("d"))).alias("b"))
    one = F.when(F.col("a").isNull() | F.col("b").isNull(), F.lit(0.0)).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.select("label", one.alias("silhouette"))
