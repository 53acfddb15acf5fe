"""Filters, joins, aggregates, ranks, sets and stored state over the star-schema tables.

Stand-ins: customers are projects, orders their items, lines the evidence of an item, parts
the papers, events the command log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import state as S
from tessera.plans.registry import query
from tessera.session import table


@query("flt01_hygiene", "SELECT o_orderkey, year(o_orderdate) AS y FROM orders WHERE o_orderpriority <> '' AND o_orderdate IS NOT NULL AND year(o_orderdate) >= 1995")
def hygiene(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("y", F.year("o_orderdate").cast("long"))
    return o.filter((F.col("o_orderpriority") != "") & F.col("o_orderdate").isNotNull() & (F.col("y") >= 1995)).select("o_orderkey", "y")


@query("flt07_magnets", """WITH deg AS (SELECT l_partkey, count(*) AS indegree FROM lineitem GROUP BY 1)
SELECT p_partkey, indegree FROM part JOIN deg ON p_partkey = l_partkey WHERE indegree >= 30 AND p_retailprice >= 1200 AND p_size > 10""")
def magnets(spark: SparkSession, d: str) -> DataFrame:
    deg = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("indegree")).filter("indegree >= 30")
    return table(spark, d, "part").filter("p_retailprice >= 1200 AND p_size > 10").join(deg, F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "indegree")


@query("flt08_contained_links", """WITH bad AS (SELECT p_partkey FROM part WHERE p_size <= 25)
SELECT l_orderkey, count(*) AS n FROM lineitem LEFT JOIN bad ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) = count(p_partkey)""")
def contained_links(spark: SparkSession, d: str) -> DataFrame:
    bad = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("bad"))
    links = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(bad, "l_partkey", "left")
    return links.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("b")).filter("n = b").select("l_orderkey", "n")


@query("flt09_dynamic_where", "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' AND (p_name ILIKE '%steel%' OR p_type ILIKE '%steel%' OR p_brand ILIKE '%steel%')")
def dynamic_where(spark: SparkSession, d: str) -> DataFrame:
    return S.where(table(spark, d, "part"), equal={"p_brand": "Brand#13"}, words="steel", over=["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name")


@query("flt10_in_list", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def in_list(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("flt11_curated", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')")
def curated(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter((F.col("o_orderstatus") == "F") | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query("flt13_minimum_group", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 5")
def minimum_group(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


@query("flt18_highlight", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 1.0 ELSE 0.03 END::DOUBLE AS opacity FROM part")
def highlight(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 40, F.lit(1.0)).otherwise(F.lit(0.03)).alias("opacity"))


@query("jn01_references_in_pool", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def references_in_pool(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").join(pool, "l_partkey", "left_semi").select("l_orderkey", "l_partkey")


@query("jn02_unknown_candidates", "SELECT DISTINCT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unknown_candidates(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey").distinct().join(known, "c_custkey", "left_anti")


@query("jn04_names_with_fallback", "SELECT c_custkey, coalesce(n_name, 'Other') AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey")
def names_with_fallback(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, d, "customer").join(names, "c_nationkey", "left").select("c_custkey", F.coalesce("n_name", F.lit("Other")).alias("name"))


@query("jn05_evidence_by_item", """SELECT l_orderkey, string_agg(p_name, '|' ORDER BY p_partkey, l_quantity) AS names, count(*) AS n
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def evidence_by_item(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    rows = lines.join(table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    own = F.array_sort(F.collect_list(F.struct("p_partkey", "l_quantity", "p_name")))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(own, lambda x: x["p_name"]), "|").alias("names"), F.count(F.lit(1)).alias("n"))


@query("jn06_project_counts", """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders,
(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS n_open FROM customer""")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0)


@query("jn07_hybrid_search", """WITH s AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings WHERE embedding[1] > 0.15),
k AS (SELECT doc_id AS id, n_chars FROM documents WHERE contains(lower(text), 'tion of the'))
SELECT coalesce(s.id, k.id) AS id, CASE WHEN s.id IS NOT NULL AND k.id IS NOT NULL THEN 'both' WHEN s.id IS NOT NULL THEN 'semantic' ELSE 'keyword' END AS "match", score
FROM s FULL JOIN k ON s.id = k.id ORDER BY score IS NULL, score DESC, n_chars DESC NULLS LAST, 1 LIMIT 50""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    first = F.col("embedding")[0]
    s = table(spark, d, "embeddings").filter(first > 0.15).select(F.col("vec_id").alias("id"), F.round(first.cast("double"), 6).alias("score"))
    k = table(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("tion of the"))).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("weight"))
    return S.hybrid(s, k, 50)


@query("jn12_year_band", """WITH a AS (SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice AS p FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'),
b AS (SELECT c_custkey, 1992 + (c_custkey % 8)::INT AS y, c_acctbal AS q FROM customer)
SELECT o_orderkey, arg_max(c_custkey, (q, -c_custkey)) AS best FROM a JOIN b ON abs(a.y - b.y) <= 2 GROUP BY 1""")
def year_band(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select("o_orderkey", F.year("o_orderdate").alias("y"))
    b = table(spark, d, "customer").select("c_custkey", (1992 + F.col("c_custkey") % 8).cast("int").alias("y"), F.col("c_acctbal").alias("q"))
    # the best of a year's candidates is the same for all rows of the year: reduce before joining
    best = S.band_best(b, "y", F.struct("q", -F.col("c_custkey")), "c_custkey", 2)
    return a.join(best, "y").select("o_orderkey", "best")


@query("jn15_remap", """WITH m AS (SELECT p_partkey AS old, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS new FROM part)
SELECT DISTINCT l_orderkey AS src, coalesce(new, l_partkey) AS dst FROM lineitem LEFT JOIN m ON old = l_partkey""")
def remap(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    groups = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("new"))
    m = p.join(groups, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("old"), "new")
    return S.remap(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")), "dst", m).distinct()


@query("agg02_by_year", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def by_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count(F.lit(1)).alias("n")).orderBy("y")


@query("agg03_top_types", "SELECT coalesce(p_type, '?') AS t, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, t LIMIT 10")
def top_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.coalesce("p_type", F.lit("?")).alias("t")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "t").limit(10)


@query("agg05_foundational", "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) GROUP BY 1 HAVING count(*) >= 4 ORDER BY n DESC, l_partkey LIMIT 4000")
def foundational(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    return n.join(known, "l_partkey", "left_anti").orderBy(F.desc("n"), "l_partkey").limit(4000)


@query("agg11_growth", """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y FROM orders), m AS (SELECT max(y) AS m FROM y)
SELECT o_custkey, round((count(*) FILTER (y >= m - 1) / 2) / nullif(count(*) FILTER (y >= m - 3 AND y < m - 1) / 2, 0) - 1, 6) AS growth,
round(avg((y >= m - 1)::INT), 6) AS recent_share FROM y, m GROUP BY o_custkey""")
def growth(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"))
    y = y.crossJoin(F.broadcast(y.agg(F.max("y").alias("m"))))  # one row
    recent, prior = F.col("y") >= F.col("m") - 1, (F.col("y") >= F.col("m") - 3) & (F.col("y") < F.col("m") - 1)
    rate = (F.count_if(recent) / 2) / F.nullif(F.count_if(prior) / 2, F.lit(0.0)) - 1
    return y.groupBy("o_custkey").agg(F.round(rate, 6).alias("growth"), F.round(F.avg(recent.cast("int")), 6).alias("recent_share"))


@query("agg15_crosstab", """WITH n AS (SELECT c_nationkey AS f, c_mktsegment AS p, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT f, p, n, round(n / sum(n) OVER (PARTITION BY f), 6) AS share FROM n QUALIFY row_number() OVER (PARTITION BY f ORDER BY n DESC, p) <= 4""")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("f"), F.col("c_mktsegment").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("f")), 6)
    return n.withColumns({"share": share, "r": F.row_number().over(Window.partitionBy("f").orderBy(F.desc("n"), "p"))}).filter("r <= 4").drop("r")


@query("agg16_partition_shape", "WITH s AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT count(*) AS k, max(n) AS largest, round(max(n) / sum(n), 6) AS max_share, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n < 5) AS small FROM s")
def partition_shape(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("k"), F.max("n").alias("largest"), F.round(F.max("n") / F.sum("n"), 6).alias("max_share"), F.count_if(F.col("n") == 1).alias("singletons"), F.count_if(F.col("n") < 5).alias("small"))


@query("agg22_distinct_counts", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations FROM customer GROUP BY 1")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count_distinct("c_nationkey").alias("nations"))


@query("agg28_next_seq", "SELECT user_id, coalesce(max(event_id), 0) + 1 AS next FROM events GROUP BY 1")
def next_seq(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg((F.coalesce(F.max("event_id"), F.lit(0)) + 1).alias("next"))


@query("agg29_coverage", """SELECT source, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad, count(*) FILTER (quality IS NULL) AS unchecked
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    q = F.col("quality")
    return rows.groupBy("source").agg(F.count_if(q == 1).alias("good"), F.count_if(q == 0).alias("bad"), F.count_if(q.isNull()).alias("unchecked"))


@query("agg33_merged_small", "WITH s AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN n < 15 THEN 'other' ELSE p_type END AS name, sum(n)::BIGINT AS n, count(*) AS merged FROM s GROUP BY 1")
def merged_small(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy(F.when(F.col("n") < 15, "other").otherwise(F.col("p_type")).alias("name")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("merged"))


@query("agg36_progress", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) AS all_ FROM orders GROUP BY 1")
def progress(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count(F.lit(1)).alias("all_"))


@query("agg37_rates", "SELECT source, CASE WHEN count(*) = 0 THEN '0/0' ELSE printf('%d/%d (%.1f%%)', count(quality), count(*), 100.0::DOUBLE * count(quality) / count(*)) END AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("source").agg(F.count("quality").alias("n"), F.count(F.lit(1)).alias("d")).select("source", X.percent_of(F.col("n"), F.col("d")).alias("rate"))


@query("win01_metric_ranks", """WITH m AS (SELECT p_partkey, unnest(['price', 'size']) AS metric, unnest([p_retailprice, p_size::DOUBLE]) AS v FROM part)
SELECT p_partkey, metric, row_number() OVER (PARTITION BY metric ORDER BY v DESC, p_partkey) AS rank FROM m""")
def metric_ranks(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "part").select("p_partkey", F.expr("stack(2, 'price', p_retailprice, 'size', double(p_size)) AS (metric, v)"))
    return S.before(m, [F.desc("v"), "p_partkey"], by=["metric"]).select("p_partkey", "metric", (F.col("before") + 1).cast("int").alias("rank"))


@query("win02_top_per_group", "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) <= 5")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, d, "part").withColumn("r", F.row_number().over(w)).filter("r <= 5").select("p_brand", "p_partkey")


@query("win04_percentile", "SELECT p_partkey, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_retailprice) * 100)::INT AS percentile FROM part")
def percentile(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(F.cume_dist().over(Window.partitionBy("p_brand").orderBy("p_retailprice")) * 100).cast("int").alias("percentile"))


@query("prj11_percentile_rank", "SELECT p_partkey, round((rank() OVER (ORDER BY p_size) - 1 + (count(*) OVER (PARTITION BY p_size) - 1) / 2) / (count(*) OVER () - 1), 6) AS pr FROM part")
def percentile_rank(spark: SparkSession, d: str) -> DataFrame:
    return S.percentile_rank(table(spark, d, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", F.round("pr", 6).alias("pr"))


@query("win08_preceding_section", """SELECT event_id, last_value(CASE WHEN event_type = 'login' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section
FROM events""")
def preceding_section(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "login", F.col("event_id")), ignorenulls=True).over(w).alias("section"))


@query("win09_latest_job", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1, 2")
def latest_job(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("win10_first_seen", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_seen(spark: SparkSession, d: str) -> DataFrame:
    return S.keep_one(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("win12_even_sample", """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey FROM r WHERE i IN (SELECT CAST(round_even(j * (n - 1) / 19.0::DOUBLE, 0) AS BIGINT) FROM range(20) t(j))""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.even_sample(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 20)


@query("win13_positions", "SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_quantity, l_extendedprice) AS position FROM lineitem")
def positions(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_quantity", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.row_number().over(w).alias("position"))


@query("srt02_nulls_last", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance DESC NULLS LAST, c_custkey LIMIT 100")
def nulls_last(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return c.orderBy(F.desc_nulls_last("balance"), "c_custkey").limit(100)


@query("srt10_cap_per_item", "SELECT l_orderkey, list_sort(list(l_partkey))[1:3] AS parts FROM lineitem GROUP BY 1")
def cap_per_item(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.array_sort(F.collect_list("l_partkey")), 1, 3).alias("parts"))


EDGES_AB = "WITH a AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS t FROM lineitem WHERE l_linestatus = 'F') "


@query("set03_edge_sets", EDGES_AB + "SELECT count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS both_, count(*) FILTER (b.s IS NULL) AS only_a, count(*) FILTER (a.s IS NULL) AS only_b, count(*) AS union_ FROM a FULL JOIN b ON a.s = b.s AND a.t = b.t")
def edge_sets(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    pick = lambda f: l.filter(f).select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("t")).distinct()
    return S.compare_sets(pick("l_returnflag = 'R'"), pick("l_linestatus = 'F'"), ["s", "t"])


@query("set02_edge_union", EDGES_AB + "SELECT s, t FROM a UNION SELECT s, t FROM b")
def edge_union(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").filter("l_returnflag = 'R' OR l_linestatus = 'F'")
    return l.select(F.col("l_orderkey").alias("s"), F.col("l_partkey").alias("t")).distinct()


@query("dml02_insert_many", """WITH new AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
SELECT count(*) FILTER (r = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) AS inserted,
count(*) FILTER (NOT (r = 1 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))) AS duplicates FROM new""")
def insert_many(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return S.insert_counts(table(spark, d, "orders").select("o_orderkey", "o_custkey"), held, "o_custkey", "o_orderkey")


@query("dml04_cascade", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def cascade(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    items = table(spark, d, "orders").join(gone, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, d, "lineitem").join(items, "l_orderkey", "left_anti").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("dml05_conditional_delete", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'O' AND o_orderpriority = '5-LOW')")
def conditional_delete(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(~((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"))).select("o_orderkey")


@query("dml06_upsert", "SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_min(event_type, (ts, event_id)) AS first_type FROM events GROUP BY 1")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    order = F.struct("ts", "event_id")
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("value", order).alias("value"), F.min_by("event_type", order).alias("first_type"))


@query("dml13_quarantine", """SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'metadata' WHEN o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'single_seed' END AS reason FROM orders""")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    good = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("good"))
    o = table(spark, d, "orders").join(good, "o_custkey", "left")
    return o.select("o_orderkey", F.when(F.col("o_totalprice") < 1000, "metadata").when(F.col("good").isNull(), "single_seed").alias("reason"))
