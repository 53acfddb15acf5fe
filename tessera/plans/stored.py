"""Stored state and sinks: commands with sequences, partial updates, status derivation, nested exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import state as S
from tessera.plans.registry import query, shared_sql
from tessera.session import table


@query(
    "dml01_dispatch",
    """WITH half AS (SELECT max(event_id) // 2 AS h FROM events), old AS (SELECT user_id, count(*) AS seq FROM events, half WHERE event_id <= h GROUP BY user_id),
new AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events, half WHERE event_id > h AND event_type IN ('click', 'view', 'purchase') AND user_id IS NOT NULL)
SELECT event_id, new.user_id, event_type, coalesce(seq, 0) + n AS seq FROM new LEFT JOIN old ON old.user_id = new.user_id""",
)
def dispatch(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    half = events.agg(F.floor(F.max("event_id") / 2).alias("h"))
    dated = events.crossJoin(half)  # one row
    log = dated.filter("event_id <= h").groupBy("user_id").agg(F.count(F.lit(1)).alias("seq"))
    commands = dated.filter("event_id > h").select("event_id", "user_id", "event_type")
    return S.dispatch(commands, log, "user_id", "event_id", "event_type", ["click", "view", "purchase"])


@query(
    "dml03_partial_update",
    """WITH u AS (SELECT o_custkey AS id, max(o_orderpriority) AS seg, max(o_totalprice) AS bal FROM orders WHERE o_orderstatus = 'P' GROUP BY 1 UNION ALL SELECT -1, 'x', 0.0)
SELECT coalesce(c_custkey, u.id) AS c_custkey, CASE WHEN c_custkey IS NULL THEN NULL ELSE coalesce(seg, c_mktsegment) END AS c_mktsegment, c_acctbal, CASE WHEN c_custkey IS NULL THEN 'not found' WHEN u.id IS NULL THEN 'kept' ELSE 'updated' END AS outcome
FROM customer FULL OUTER JOIN u ON u.id = c_custkey""",
)
def partial_update(spark: SparkSession, d: str) -> DataFrame:
    changes = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("c_mktsegment"), F.max("o_totalprice").alias("c_acctbal"))
    changes = changes.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("x").alias("c_mktsegment"), F.lit(0.0).alias("c_acctbal")))
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return S.partial_update(rows, changes, "c_custkey", ["c_mktsegment"])


shared_sql(
    "dml07_enrichment",
    """WITH found AS (SELECT l_orderkey AS id, max(l_shipdate) AS shipped, count(*) AS n FROM {lineitem} WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderkey AS id, CASE WHEN found.id IS NULL AND o_orderstatus = 'O' THEN 'pending' WHEN found.id IS NULL THEN 'missing' WHEN n < 3 THEN 'partial' ELSE 'complete' END AS status FROM {orders} LEFT JOIN found ON found.id = o_orderkey""",
)


@query(
    "dml08_job_states",
    """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS steps, count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS done FROM events)
SELECT user_id, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'done' WHEN done > 0 THEN 'running' ELSE 'queued' END AS state, round(done / steps, 6) AS progress FROM r WHERE n = 1""",
)
def job_states(spark: SparkSession, d: str) -> DataFrame:
    done = F.count_if(F.col("event_type") == "purchase")
    jobs = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"), F.count(F.lit(1)).alias("steps"), done.alias("done"))
    state = F.when(F.col("last") == "error", "error").when(F.col("last") == "purchase", "done").when(F.col("done") > 0, "running").otherwise("queued")
    return jobs.select("user_id", state.alias("state"), F.round(F.col("done") / F.col("steps"), 6).alias("progress"))


@query("dml09_redaction", "SELECT event_id, event_type, json_extract(props, '$.k') IS NOT NULL AS k_set FROM events")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").isNotNull().alias("k_set"))


@query("dml10_migrations", "SELECT p_size::BIGINT AS version, count(*) AS steps FROM part WHERE p_size > (SELECT max(p_size) FROM part WHERE p_size <= 30) GROUP BY 1")
def migrations(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "part").select(F.col("p_size").cast("long").alias("version"), "p_partkey")
    return S.pending(steps, steps.filter("version <= 30"), "version").groupBy("version").agg(F.count(F.lit(1)).alias("steps"))


@query(
    "dml11_seed_workspace",
    """WITH c AS (SELECT p_partkey AS id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS n FROM part), own AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 48)
SELECT id, p_brand AS cluster FROM c WHERE n <= 10 AND id NOT IN (SELECT id FROM own)""",
)
def seed_workspace(spark: SparkSession, d: str) -> DataFrame:
    central = Window.partitionBy("cluster").orderBy(F.desc("p_retailprice"), "id")
    papers = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"), "p_retailprice")
    own = table(spark, d, "lineitem").filter("l_linenumber = 1 and l_quantity > 48").select(F.col("l_partkey").alias("id"))
    return papers.withColumn("n", F.row_number().over(central)).filter("n <= 10").join(own, "id", "left_anti").select("id", "cluster")


@query("dml14_projects", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 'updated' ELSE 'kept' END AS outcome FROM nation UNION ALL SELECT 100, 'new project', 'created'")
def projects(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    changed = S.partial_update(rows, rows.filter("n_regionkey = 1").select("id", F.lower("name").alias("name"), F.lit(9).alias("n_regionkey")), "id", ["name"])
    created = spark.range(1).select(F.lit(100).cast("long").alias("id"), F.lit("new project").alias("name"), F.lit("created").alias("outcome"))
    return changed.select("id", "name", "outcome").unionByName(created)


@query("snk03_map_json", "SELECT r_regionkey, to_json({'name': r_name, 'papers': list({'id': n_nationkey, 'title': n_name} ORDER BY n_nationkey)})::VARCHAR AS map FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name")
def map_json(spark: SparkSession, d: str) -> DataFrame:
    papers = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"))))
    rows = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_regionkey", "r_name").agg(papers.alias("papers")).select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("name"), "papers")).alias("map"))


shared_sql(
    "snk11_quarantine",
    """SELECT o_orderkey AS id, 'status' AS reason, o_orderstatus AS detail FROM {orders} WHERE o_orderstatus = 'P' UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM {orders} WHERE o_orderpriority = '5-LOW' AND o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'year', CAST(year(o_orderdate) AS VARCHAR(8)) FROM {orders} WHERE year(o_orderdate) < 1993 AND o_orderpriority <> '5-LOW' AND o_orderstatus <> 'P'""",
)


@query("win11_ordered_distinct", "SELECT conv_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS roles FROM (SELECT conv_id, list(lower(role) ORDER BY turn, role) AS l FROM conversations GROUP BY conv_id)")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_distinct(F.transform(turns, lambda t: F.lower(t["role"]))).alias("roles"))


@query("jn03_positional_zip", "SELECT conv_id, row_number() OVER w - 1 AS idx, turn, role, length(text) AS size, length(text) % 7 = 0 AS flag FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role)")
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "conversations").select("conv_id", F.struct("turn", "role", F.length("text").alias("size")).alias("x"))
    rows = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    arrays = [F.col(f"x.{c}").alias(c) for c in ("turn", "role", "size")] + [F.transform("x", lambda v: v["size"] % 7 == 0).alias("flag")]
    zipped = rows.select("conv_id", *arrays).select("conv_id", F.posexplode(F.arrays_zip("turn", "role", "size", "flag")).alias("idx", "z"))
    return zipped.select("conv_id", F.col("idx").cast("long").alias("idx"), "z.turn", "z.role", F.col("z.size").cast("long").alias("size"), "z.flag")


@query("srt05_index_search", "SELECT b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = (SELECT min(vec_id) FROM embeddings) ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id LIMIT 50")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    asked = vectors.agg(F.min_by("embedding", "vec_id").alias("q"))  # one row
    dot = F.aggregate(F.zip_with("embedding", "q", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return vectors.crossJoin(asked).select("vec_id", dot.alias("score")).orderBy(F.desc("score"), "vec_id").limit(50).select("vec_id", F.round("score", 5).alias("score"))


@query(
    "prj08_year_chain",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN year(o_orderdate)::VARCHAR WHEN 1 THEN (epoch_ms(o_orderdate::TIMESTAMP))::VARCHAR WHEN 2 THEN (epoch_ms(o_orderdate::TIMESTAMP) // 1000)::VARCHAR WHEN 3 THEN strftime(o_orderdate, '%Y-%m') ELSE 'n.d.' END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN try_cast(raw AS BIGINT) > 1000000000000 THEN year(make_timestamp(raw::BIGINT * 1000)) WHEN try_cast(raw AS BIGINT) > 1000000000 THEN year(make_timestamp(raw::BIGINT * 1000000)) WHEN try_cast(raw AS BIGINT) IS NOT NULL THEN raw::BIGINT ELSE try_cast(substr(raw, 1, 4) AS BIGINT) END AS y FROM r""",
)
def year_chain(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("o_orderdate").cast("timestamp")
    kind = F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.year(at).cast("string")).when(kind == 1, F.unix_millis(at).cast("string")).when(kind == 2, F.unix_seconds(at).cast("string")).when(kind == 3, F.date_format(at, "yyyy-MM")).otherwise("n.d.")
    return table(spark, d, "orders").select("o_orderkey", X.year_of(raw).alias("y"))
