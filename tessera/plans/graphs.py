"""Queries over the graph of parts: an edge leads from a line's part to that of a later line of the same order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import graphs as G
from tessera.plans.registry import query
from tessera.session import table

E = "WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_partkey <> b.l_partkey), n AS (SELECT p_partkey AS id, p_size, p_brand FROM part), o AS (SELECT src, count(*) AS out_ FROM e GROUP BY 1), p AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM e), both_ AS (SELECT u AS src, v AS dst FROM p UNION ALL SELECT v, u FROM p)"


def _links(spark: SparkSession, d: str) -> DataFrame:
    """Edges as often as they occur."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    b = l.select("l_orderkey", F.col("l_linenumber").alias("after"), F.col("l_partkey").alias("dst"))
    return l.join(b, "l_orderkey").filter("l_linenumber < after AND l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst")


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).distinct()


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", "p_brand")


@query("agg01_in_degree", E + " SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS indegree FROM n")
def in_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.in_degree(_nodes(spark, d).select("id"), _edges(spark, d))


@query("agg04_coverage", E + " SELECT (SELECT count(*) FROM e) AS edges, round((SELECT count(*) FROM e) / count(*), 6) AS per_node, round(avg((id IN (SELECT src FROM e) OR id IN (SELECT dst FROM e))::INT), 6) AS linked FROM n")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    e = G.cut(_edges(spark, d))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("l", F.lit(1))
    nodes = _nodes(spark, d).join(ends, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("l", F.lit(0))).alias("linked"))
    return e.agg(F.count(F.lit(1)).alias("edges")).crossJoin(nodes).select("edges", F.round(F.col("edges") / F.col("n"), 6).alias("per_node"), F.round("linked", 6).alias("linked"))


@query("agg14_flows", E + " SELECT least(a.p_brand, b.p_brand) AS c1, greatest(a.p_brand, b.p_brand) AS c2, count(*) AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2 ORDER BY n DESC, c1, c2 LIMIT 10")
def flows(spark: SparkSession, d: str) -> DataFrame:
    n = _nodes(spark, d)
    e = _edges(spark, d).join(n.select(F.col("id").alias("src"), F.col("p_brand").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("p_brand").alias("b")), "dst").filter("a <> b")
    return e.groupBy(F.least("a", "b").alias("c1"), F.greatest("a", "b").alias("c2")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "c1", "c2").limit(10)


_LPA = ", s0 AS (SELECT id, least(0.6, 0.25 * (p_size % 4))::DOUBLE AS prior, p_size = 1 AS seed, CASE WHEN p_size = 1 THEN 1.0::DOUBLE ELSE least(0.6, 0.25 * (p_size % 4))::DOUBLE END AS score FROM n)" + "".join(
    f", s{i + 1} AS (SELECT id, prior, seed, CASE WHEN seed THEN 1.0::DOUBLE ELSE 0.55::DOUBLE * prior + 0.45::DOUBLE * coalesce(m, 0) END AS score FROM s{i} LEFT JOIN (SELECT src, avg(score) AS m FROM both_ JOIN s{i} ON id = dst GROUP BY 1) ON src = id)" for i in range(6)
)


@query("gr01_relevance", E + _LPA + " SELECT id, round(score, 6) AS score FROM s6")
def relevance(spark: SparkSession, d: str) -> DataFrame:
    priors = _nodes(spark, d).select("id", F.least(F.lit(0.6), 0.25 * (F.col("p_size") % 4)).alias("prior"), (F.col("p_size") == 1).alias("seed"))
    return G.propagate_relevance(priors, _edges(spark, d)).select("id", F.round("score", 6).alias("score"))


_PR = ", r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n)" + "".join(
    f", r{i + 1} AS (SELECT id, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(got, 0) + coalesce((SELECT sum(rank) FROM r{i} WHERE id NOT IN (SELECT src FROM o)), 0) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN (SELECT dst, sum(rank / out_) AS got FROM e JOIN r{i} ON id = src JOIN o USING (src) GROUP BY 1) ON dst = id)" for i in range(4)
)


@query("gr05_pagerank", E + _PR + " SELECT id, round(rank, 9) AS rank FROM r4")
def pagerank(spark: SparkSession, d: str) -> DataFrame:
    return G.pagerank(_nodes(spark, d).select("id"), G.cut(_edges(spark, d)), rounds=4).select("id", F.round("rank", 9).alias("rank"))


@query("gr05_pagerank_converged")
def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    """The ranks themselves, where gr05_pagerank gives the four rounds of its SQL. No SQL: the number of rounds is open; the test holds numpy's."""
    return G.pagerank(_nodes(spark, d).select("id"), G.cut(_edges(spark, d)), rounds=None).select("id", F.round("rank", 9).alias("rank"))


_HITS = ", h0 AS (SELECT id, 1.0::DOUBLE AS hub FROM n)" + "".join(
    f", a{i} AS (SELECT dst AS id, sum(hub) AS a FROM e JOIN h{i} ON id = src GROUP BY 1), b{i} AS (SELECT id, a / (SELECT max(a) FROM a{i}) AS a FROM a{i}), h{i + 1} AS (SELECT src AS id, sum(a) AS hub FROM e JOIN b{i} ON id = dst GROUP BY 1)" for i in range(3)
)


@query("gr07_hits", E + _HITS + " SELECT n.id, round(coalesce(a, 0), 7) AS authority FROM n LEFT JOIN b2 ON b2.id = n.id")
def hits(spark: SparkSession, d: str) -> DataFrame:
    return G.hits(_nodes(spark, d).select("id"), G.cut(_edges(spark, d)), rounds=3).select("id", F.round("authority", 7).alias("authority"))


@query("gr07_hits_converged")
def hits_converged(spark: SparkSession, d: str) -> DataFrame:
    """The authorities themselves, where gr07_hits gives the three rounds of its SQL. No SQL, as above."""
    return G.hits(_nodes(spark, d).select("id"), G.cut(_edges(spark, d)), rounds=None).select("id", F.round("authority", 7).alias("authority"))


_GR02 = ", w AS (SELECT src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM both_), m0 AS (SELECT id, p_brand AS label, 1.0::DOUBLE AS mass FROM n)" + "".join(
    f", g{i} AS (SELECT src AS id, label, sum(share * mass) AS got FROM w JOIN m{i} ON id = dst GROUP BY 1, 2), m{i + 1} AS (SELECT id, label, CASE WHEN id IN (SELECT src FROM w) THEN 0.55::DOUBLE * coalesce(mass, 0) + 0.45::DOUBLE * coalesce(got, 0) ELSE coalesce(mass, 0) END AS mass FROM m0 FULL JOIN g{i} USING (id, label))" for i in range(6)
)


@query("gr02_membership", E + _GR02 + " SELECT id, label, round(mass, 6) AS mass FROM m6")
def membership(spark: SparkSession, d: str) -> DataFrame:
    """Shares of brands that reach each part in six rounds."""
    nodes = _nodes(spark, d).select("id", F.col("p_brand").alias("label"))
    return G.diffuse_membership(nodes, _links(spark, d), simple=True).select("id", "label", F.round("mass", 6).alias("mass"))


@query("gr11_modularity", E + """, l AS (SELECT u, v, a.p_brand AS la, b.p_brand AS lb FROM p JOIN n a ON a.id = u JOIN n b ON b.id = v),
m AS (SELECT count(*)::DOUBLE AS m FROM l), i AS (SELECT count(*)::DOUBLE AS i FROM l WHERE la = lb), dg AS (SELECT label, count(*)::DOUBLE AS k FROM (SELECT la AS label FROM l UNION ALL SELECT lb FROM l) GROUP BY 1)
SELECT round((SELECT i FROM i) / (SELECT m FROM m) - sum(k * k) / (4 * (SELECT m * m FROM m)), 7) AS modularity FROM dg""")
def modularity(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("w", F.lit(1.0))
    return G.modularity(_nodes(spark, d).select("id", F.col("p_brand").alias("label")), e).select(F.round("modularity", 7).alias("modularity"))


@query("gr12_components", """WITH RECURSIVE t AS (SELECT c_custkey AS id, (SELECT min(b.c_custkey) FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_mktsegment = a.c_mktsegment) AS component FROM customer a)
SELECT id, component FROM t WHERE component IN (SELECT component FROM t GROUP BY 1 HAVING count(*) > 1)""")
def components(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    chain = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(w).alias("dst")).filter("dst is not null")
    return G.components(chain)


@query("gr13_neighbourhood", E + """, h1 AS (SELECT DISTINCT dst AS id FROM both_ WHERE src = 1 AND dst <> 1), h2 AS (SELECT DISTINCT dst AS id FROM both_ WHERE src IN (SELECT id FROM h1) AND dst <> 1 AND dst NOT IN (SELECT id FROM h1))
SELECT 1::BIGINT AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""")
def neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return G.neighbourhood(spark.createDataFrame([(1,)], "id long"), _edges(spark, d), 2)


@query("gr14_undirected", E + " SELECT src, dst FROM both_")
def undirected(spark: SparkSession, d: str) -> DataFrame:
    return G.undirected(_edges(spark, d))


@query("gr18_adjacency", E + " SELECT src, list_sort(list(dst)) AS targets FROM e GROUP BY 1")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("targets"))


@query("gr04_fused_graph", E + """, c AS (SELECT least(src, dst) AS u, greatest(src, dst) AS v, count(*) AS c FROM e GROUP BY 1, 2),
s AS (SELECT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, max(l_discount) AS s FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2)
SELECT coalesce(c.u, s.u) AS u, coalesce(c.v, s.v) AS v, round(coalesce(c, 0) + 0.25 * coalesce(s, 0), 6)::DOUBLE AS w FROM c FULL JOIN s ON c.u = s.u AND c.v = s.v""")
def fused_graph(spark: SparkSession, d: str) -> DataFrame:
    similar = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("weight"))
    return G.fused(_edges(spark, d), similar, 0.25).select("u", "v", F.round("w", 6).alias("w"))


@query("agg17_agreement", """WITH c AS (SELECT p_brand AS a, p_size % 5 AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), x AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), y AS (SELECT b, sum(n) AS n FROM c GROUP BY 1), t AS (SELECT sum(n) AS n FROM c),
q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS p, (SELECT sum(n * (n - 1) / 2) FROM x) AS pa, (SELECT sum(n * (n - 1) / 2) FROM y) AS pb, (SELECT n * (n - 1) / 2 FROM t) AS pt,
(SELECT sum(c.n / t.n * ln(c.n * t.n / (x.n * y.n))) FROM c JOIN x USING (a) JOIN y USING (b), t) AS mi, (SELECT -sum(x.n / t.n * ln(x.n / t.n)) FROM x, t) AS ha, (SELECT -sum(y.n / t.n * ln(y.n / t.n)) FROM y, t) AS hb)
SELECT round((p - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 7) AS ari, round(mi / ((ha + hb) / 2), 7) AS nmi FROM q""")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_brand", (F.col("p_size") % 5).alias("b"))
    return G.partition_agreement(rows, "p_brand", "b").select(F.round("ari", 7).alias("ari"), F.round("nmi", 7).alias("nmi"))


@query("gr17_snowball", E + """, seed AS (SELECT id FROM n WHERE p_size = 50), back AS (SELECT DISTINCT dst AS id FROM e WHERE src IN (SELECT id FROM seed)), fwd AS (SELECT DISTINCT src AS id FROM e WHERE dst IN (SELECT id FROM seed)),
every_ AS (SELECT id, 0 AS via FROM seed UNION ALL SELECT id, 1 FROM back UNION ALL SELECT id, 2 FROM fwd) SELECT id, min(via) AS via FROM every_ GROUP BY 1""")
def snowball(spark: SparkSession, d: str) -> DataFrame:
    e = G.cut(_edges(spark, d))
    seeds = _nodes(spark, d).filter("p_size = 50").select("id")
    back = e.join(seeds.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(1).alias("via"))
    forward = e.join(seeds.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"), F.lit(2).alias("via"))
    return seeds.withColumn("via", F.lit(0)).unionByName(back).unionByName(forward).groupBy("id").agg(F.min("via").alias("via"))


@query("gr09_communities")
def communities(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: local moving isn't expressible; the test holds its modularity and plain cases."""
    from tessera.operators.communities import communities as find

    e = _links(spark, d).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("w", F.lit(1.0))
    return find(_nodes(spark, d).select("id"), e)


@query("ml03_subareas")
def subareas(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: Lloyd's steps; the test holds plain cases."""
    from tessera.operators.communities import kmeans

    return kmeans(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("g"), F.col("embedding").alias("v")), per=20)


@query("gr06_betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    """No SQL: counting shortest paths from every node isn't feasible there; the test counts them on small graphs."""
    return G.betweenness(_nodes(spark, d).select("id"), _links(spark, d)).select("id", F.round("betweenness", 4).alias("betweenness"))


@query("snk04_viewer", E + """, f AS (SELECT a.p_brand AS source, b.p_brand AS target, count(*) AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2)
SELECT 'meta' AS section, '' AS key, to_json({'n_papers': (SELECT count(*) FROM n), 'n_edges': (SELECT count(*) FROM e)})::VARCHAR AS json
UNION ALL SELECT 'clusters', p_brand, to_json({'id': p_brand, 'papers': count(*)})::VARCHAR FROM n GROUP BY p_brand
UNION ALL SELECT 'flows', source || ' ' || target, to_json({'source': source, 'target': target, 'n': n})::VARCHAR FROM f
UNION ALL SELECT 'papers', id::VARCHAR, to_json({'id': id, 'size': p_size, 'cluster_id': p_brand})::VARCHAR FROM n
UNION ALL SELECT 'edges', src::VARCHAR, to_json(list(dst ORDER BY dst))::VARCHAR FROM e GROUP BY src""")
def viewer(spark: SparkSession, d: str) -> DataFrame:
    """The viewer's document as lines (section, key, json), so that no task holds all of it."""
    nodes, e = _nodes(spark, d), G.cut(_edges(spark, d))
    line = lambda df, section, key, value: df.select(F.lit(section).alias("section"), key.cast("string").alias("key"), F.to_json(value).alias("json"))
    brand = nodes.select("id", "p_brand")
    flows = e.join(brand.select(F.col("id").alias("src"), F.col("p_brand").alias("source")), "src").join(brand.select(F.col("id").alias("dst"), F.col("p_brand").alias("target")), "dst").filter("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    totals = nodes.agg(F.count(F.lit(1)).alias("n_papers")).crossJoin(e.agg(F.count(F.lit(1)).alias("n_edges")))  # one row each
    parts = [
        line(totals, "meta", F.lit(""), F.struct("n_papers", "n_edges")),
        line(nodes.groupBy("p_brand").agg(F.count(F.lit(1)).alias("papers")), "clusters", F.col("p_brand"), F.struct(F.col("p_brand").alias("id"), "papers")),
        line(flows, "flows", F.concat_ws(" ", "source", "target"), F.struct("source", "target", "n")),
        line(nodes, "papers", F.col("id"), F.struct("id", F.col("p_size").alias("size"), F.col("p_brand").alias("cluster_id"))),
        line(e.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("to")), "edges", F.col("src"), F.col("to")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
