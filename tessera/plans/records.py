"""Derived columns, predicates, lookups, summaries and gates in SQL that both engines run.

Stand-ins: parts are papers (p_size + 1980 their year, their lines their citations, brands
their clusters), suppliers the second provider, orders the items of a board, customers projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.graphs import cut
from tessera.operators.resolution import containing
from tessera.plans.registry import query, shared_sql
from tessera.session import table

#: Papers: id, title, cluster, kind, year, cited.
PAPERS = """papers AS (
  SELECT p_partkey AS id, p_name AS title, p_brand AS cluster, p_type AS kind, p_size + 1980 AS year, p_retailprice AS price, coalesce(n, 0) AS cited
  FROM {part} LEFT JOIN (SELECT l_partkey, count(*) AS n FROM {lineitem} GROUP BY l_partkey) c ON l_partkey = p_partkey)"""


def _papers(name: str, sql: str) -> None:
    shared_sql(name, f"WITH {PAPERS}{sql}")


# projections

shared_sql("prj03_provider_record", "SELECT concat('S2:', CAST(s_suppkey AS VARCHAR(20))) AS id, s_name AS title, CAST(2000 + s_nationkey AS BIGINT) AS year, CAST(floor(abs(s_acctbal)) AS BIGINT) AS cited FROM {supplier}")
shared_sql("prj05_compose_text", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 OR p_type = '' THEN p_name ELSE concat(p_name, '. ', p_type) END AS composed FROM {part}")
shared_sql("prj06_without_vector", "SELECT vec_id, label, embedding IS NOT NULL AS has_embedding FROM {embeddings}")
shared_sql(
    "prj10_palette",
    """WITH i AS (SELECT n_nationkey, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS idx FROM {nation})
SELECT n_nationkey, CASE idx % 4 WHEN 0 THEN '#5b8def' WHEN 1 THEN '#e9a23b' WHEN 2 THEN '#4fb286' ELSE '#c65b7c' END AS colour FROM i""",
)
_papers("prj12_velocity", " SELECT id, round(cited / CAST(greatest(2027 - coalesce(year, 2020), 1) AS DOUBLE), 6) AS velocity FROM papers")
_papers(
    "prj13_lens_sizes",
    """, seen AS (SELECT id, ln(1 + CAST(cited AS DOUBLE)) AS c, CASE WHEN id % 11 = 0 THEN NULL ELSE CAST(year AS DOUBLE) END AS y FROM papers),
r AS (SELECT min(c) AS c0, max(c) AS c1, min(y) AS y0, max(y) AS y1 FROM seen)
SELECT id, round(greatest(8 * (c - c0) / (c1 - c0), 1.5e0), 6) AS by_citations, round(greatest(7 * coalesce((y - y0) / (y1 - y0), 3e-1), 1.5e0), 6) AS by_year FROM seen CROSS JOIN r""",
)
shared_sql("prj14_world", "SELECT p_partkey AS id, round((p_size / 50e0 - 5e-1) * 600, 6) AS x, round((p_retailprice / 2e3 - 5e-1) * 600, 6) AS y, round(60 * sin(p_partkey * 1.7e0) * cos(p_partkey * 9e-1), 6) AS z FROM {part}")
shared_sql(
    "prj15_label_size",
    """WITH c AS (SELECT label, count(*) AS n FROM {embeddings} GROUP BY label), r AS (SELECT min(n) AS lo, max(n) AS hi FROM c WHERE label <> 0)
SELECT label, round(11 + 13 * coalesce((n - lo) / CAST(nullif(hi - lo, 0) AS DOUBLE), 5e-1), 6) AS size FROM c CROSS JOIN r WHERE label <> 0""",
)
shared_sql(
    "prj17_citation_chip",
    """SELECT p_partkey AS id, concat('[', split_part(p_name, ' ', 1), ' ', CAST(p_size + 1980 AS VARCHAR(4)), ']', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('(https://doi.org/10.1/', CAST(p_partkey AS VARCHAR(20)), ')') END) AS chip FROM {part}""",
)
shared_sql(
    "prj20_midpoints",
    """WITH c AS (SELECT p_brand AS b, avg(CAST(p_size AS DOUBLE)) AS x, avg(p_retailprice) AS y FROM {part} GROUP BY p_brand),
links AS (SELECT least(a.p_brand, b.p_brand) AS a, greatest(a.p_brand, b.p_brand) AS b, count(*) AS n
  FROM {lineitem} l JOIN {part} a ON a.p_partkey = l.l_partkey JOIN {part} b ON b.p_partkey = l.l_suppkey WHERE a.p_brand <> b.p_brand GROUP BY 1, 2),
top AS (SELECT a, b, n FROM links ORDER BY n DESC, a, b LIMIT 3)
SELECT top.a AS a, top.b AS b, n, round((p.x + q.x) / 2, 6) AS x, round((p.y + q.y) / 2, 4) AS y FROM top JOIN c p ON p.b = top.a JOIN c q ON q.b = top.b""",
)
_papers(
    "prj21_bubbles",
    """, s AS (SELECT cluster, count(*) AS n, avg(CASE WHEN year >= 2010 THEN 1e0 ELSE 0e0 END) AS recent FROM papers GROUP BY cluster)
SELECT cluster, round(24 + 30 * sqrt(n / CAST(max(n) OVER () AS DOUBLE)), 6) AS radius, recent >= 4e-1 AS rising FROM s""",
)

# filters

_papers("flt04_predicate_v3", " SELECT id FROM papers WHERE id % 100 = 0 OR title LIKE '%green%' OR cited / 60e0 >= 5e-1")
shared_sql("flt05_two_term_lists", "SELECT doc_id FROM {documents} WHERE (lower(text) LIKE '%the %' OR lower(text) LIKE '%der %') AND (lower(text) LIKE '% and %' OR lower(text) LIKE '% und %') ORDER BY doc_id LIMIT 60")
shared_sql(
    "flt14_feasible",
    """WITH sizes AS (SELECT l_linenumber AS alpha, l_returnflag AS g, count(*) AS n, avg(l_discount) AS q FROM {lineitem} GROUP BY 1, 2),
sweep AS (SELECT alpha, count(*) AS k, max(n) / CAST(sum(n) AS DOUBLE) AS max_share, min(n) AS smallest, avg(q) AS quality, max(q) - min(q) AS spread FROM sizes GROUP BY alpha),
ok AS (SELECT alpha FROM sweep WHERE k BETWEEN 2 AND 8 AND max_share <= 6e-1 AND smallest >= 5 AND quality >= 3e-2 AND spread <= 2e-1)
SELECT CAST(alpha AS BIGINT) AS alpha, k FROM sweep WHERE alpha IN (SELECT alpha FROM ok) OR (SELECT count(*) FROM ok) = 0""",
)
_papers("flt16_keyword_hits", " SELECT id, title FROM papers WHERE contains(lower(title), 'red') OR contains(lower(cluster), 'red') OR contains(lower(kind), 'red') ORDER BY id LIMIT 5")
_papers(
    "flt17_cross_source",
    """ SELECT id FROM papers WHERE id IN (SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'R' AND l_linenumber = 1) AND id NOT IN (SELECT l_partkey FROM {lineitem} WHERE l_returnflag = 'A' AND l_linenumber = 1)
AND (year > 2000 OR kind LIKE 'S%')""",
)
shared_sql(
    "flt19_tree",
    """WITH items AS (SELECT conv_id, turn, role, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM {conversations}),
roots AS (SELECT conv_id, min(turn) AS turn FROM items WHERE parent IS NULL GROUP BY conv_id)
SELECT items.conv_id AS conv_id, items.turn AS turn FROM items JOIN roots ON items.conv_id = roots.conv_id WHERE role = 'assistant' AND parent IS NOT DISTINCT FROM roots.turn""",
)
shared_sql(
    "flt20_retry_targets",
    """WITH retried AS (SELECT DISTINCT o_custkey, true AS again FROM {orders} WHERE o_orderpriority = '1-URGENT')
SELECT o_orderkey FROM {orders} o LEFT JOIN retried ON retried.o_custkey = o.o_custkey WHERE o_orderstatus IN ('F', 'P') AND NOT coalesce(again, false)""",
)

# joins

_papers(
    "jn08_client_merge",
    """, k AS (SELECT id, cited FROM papers WHERE title LIKE '%blue%' ORDER BY cited DESC, id LIMIT 6), s AS (SELECT id, price FROM papers ORDER BY price DESC, id LIMIT 12),
merged AS (SELECT id, 0 AS part, -CAST(cited AS DOUBLE) AS place FROM k UNION ALL SELECT id, 1, -price FROM s WHERE id NOT IN (SELECT id FROM k))
SELECT id, part FROM merged ORDER BY part, place, id LIMIT 10""",
)
_LANDMARKS = """, marks AS (SELECT id AS mark, CASE WHEN id % 2 = 0 THEN id END AS known, lower(CASE WHEN id % 3 = 0 THEN concat(title, ' ', kind) ELSE substring(title, 1, 12) END) AS title FROM papers WHERE id % 53 = 0),
exact AS (SELECT mark, papers.id AS id FROM marks JOIN papers ON papers.id = known),
loose AS (SELECT mark, min(papers.id) AS id FROM marks JOIN papers ON contains(lower(papers.title), marks.title) OR contains(marks.title, lower(papers.title)) WHERE known IS NULL GROUP BY mark)
SELECT marks.mark AS mark, coalesce(exact.id, loose.id) AS id, CASE WHEN exact.id IS NOT NULL THEN 'id' WHEN loose.id IS NOT NULL THEN 'title' ELSE 'none' END AS found_by
FROM marks LEFT JOIN exact ON exact.mark = marks.mark LEFT JOIN loose ON loose.mark = marks.mark"""


@query("jn09_landmarks", f"WITH {PAPERS}{_LANDMARKS}".format(part="part", lineitem="lineitem"))
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    """As its SQL, but titles meet by pieces of them: the SQL's join compares every landmark with every paper."""
    papers = cut(spark.sql(f"WITH {PAPERS} SELECT id, title, kind FROM papers", part=table(spark, d, "part"), lineitem=table(spark, d, "lineitem")))
    marks = cut(
        spark.sql(
            """SELECT id AS mark, CASE WHEN id % 2 = 0 THEN id END AS known, lower(CASE WHEN id % 3 = 0 THEN concat(title, ' ', kind) ELSE substring(title, 1, 12) END) AS title FROM {papers} WHERE id % 53 = 0""",
            papers=papers,
        )
    )
    asked = marks.filter("known IS NULL").select("mark", F.col("title").alias("name"))
    titles = cut(papers.groupBy(F.lower("title").alias("title")).agg(F.min("id").alias("id")))
    inside = containing(titles.select(F.col("title").alias("text")), asked.select(F.col("name").alias("part"))).select(F.col("text").alias("title"), F.col("part").alias("name"))
    around = containing(asked.select(F.col("name").alias("text")), titles.select(F.col("title").alias("part"))).select(F.col("part").alias("title"), F.col("text").alias("name"))
    best = inside.unionByName(around).join(titles, "title").groupBy("name").agg(F.min("id").alias("id"))
    loose = asked.join(best, "name").groupBy("mark").agg(F.min("id").alias("id"))
    exact = marks.join(papers.select("id"), F.col("known") == F.col("id")).select("mark", "id")
    return spark.sql(
        """SELECT marks.mark AS mark, coalesce(exact.id, loose.id) AS id, CASE WHEN exact.id IS NOT NULL THEN 'id' WHEN loose.id IS NOT NULL THEN 'title' ELSE 'none' END AS found_by
FROM {marks} AS marks LEFT JOIN {exact} AS exact ON exact.mark = marks.mark LEFT JOIN {loose} AS loose ON loose.mark = marks.mark""",
        marks=marks, exact=exact, loose=loose,
    )


_papers(
    "jn10_provider_merge",
    """, first AS (SELECT id, CASE WHEN id % 3 = 0 THEN id END AS eprint, CASE WHEN id % 2 = 0 THEN concat('10.1/', CAST(id AS VARCHAR(20))) END AS doi, lower(title) AS title, cited FROM papers WHERE id % 5 <> 0),
titles AS (SELECT title, min(id) AS id FROM first GROUP BY title),
second AS (SELECT id + 1000000 AS id, CASE WHEN id % 3 = 0 THEN id END AS eprint, CASE WHEN id % 2 = 0 THEN concat('10.1/', CAST(id AS VARCHAR(20))) END AS doi, lower(title) AS title, cited + id % 7 AS cited FROM papers WHERE id % 4 <> 0),
matched AS (SELECT s.id AS id, s.cited AS cited, coalesce(a.id, b.id, t.id) AS into_id, CASE WHEN a.id IS NOT NULL THEN 'eprint' WHEN b.id IS NOT NULL THEN 'doi' WHEN t.id IS NOT NULL THEN 'title' ELSE 'new' END AS method
  FROM second s LEFT JOIN first a ON a.eprint = s.eprint LEFT JOIN first b ON b.doi = s.doi LEFT JOIN titles t ON t.title = s.title)
SELECT matched.id AS id, into_id, method, greatest(matched.cited, coalesce(first.cited, 0)) AS cited FROM matched LEFT JOIN first ON first.id = into_id""",
)
shared_sql(
    "jn20_cited_keys",
    """WITH refs AS (SELECT DISTINCT l_suppkey AS work, l_partkey AS cite FROM {lineitem} WHERE l_returnflag = 'A'), contexts AS (SELECT DISTINCT l_suppkey AS work, l_partkey AS cite FROM {lineitem} WHERE l_returnflag = 'R')
SELECT contexts.work AS work, count(*) AS contexts, count(refs.cite) AS overlap FROM contexts LEFT JOIN refs ON refs.work = contexts.work AND refs.cite = contexts.cite GROUP BY contexts.work""",
)
_papers(
    "jn22_by_name",
    """, clusters AS (SELECT cluster AS name, count(*) AS n FROM papers GROUP BY cluster), projects AS (SELECT DISTINCT CASE WHEN id % 2 = 0 THEN cluster ELSE concat(cluster, '?') END AS name FROM papers WHERE year > 2025)
SELECT projects.name AS name, n FROM projects JOIN clusters ON clusters.name = projects.name""",
)
_GATE = """ranked AS (SELECT ref, cand, sim, overlap, y1, y2, row_number() OVER (PARTITION BY ref ORDER BY sim DESC, cand) AS place FROM cands)
SELECT ref, cand, sim FROM ranked WHERE place = 1 AND sim >= 92e-2 AND overlap >= 1 AND abs(y1 - y2) <= 2"""
shared_sql(
    "jn23_best_title_gate",
    f"""WITH cands AS (SELECT l_orderkey AS ref, l_partkey AS cand, max(1 - l_discount / 2) AS sim, max(l_linenumber % 3) AS overlap, max(CASE WHEN l_quantity > 45 THEN NULL ELSE l_suppkey % 6 END) AS y1, max(l_partkey % 5) AS y2
FROM {{lineitem}} GROUP BY l_orderkey, l_partkey), {_GATE}""",
)
shared_sql(
    "jn27_pooled_candidates",
    f"""WITH pool AS (SELECT l_orderkey AS ref, l_partkey AS cand, l_linenumber AS query, 1 - l_discount / 2 AS sim, l_linenumber % 3 AS overlap, l_suppkey % 6 AS y1, l_partkey % 5 AS y2 FROM {{lineitem}}),
first AS (SELECT ref, cand, sim, overlap, y1, y2, row_number() OVER (PARTITION BY ref, cand ORDER BY query, sim DESC, overlap, y1) AS n FROM pool), cands AS (SELECT * FROM first WHERE n = 1), {_GATE}""",
)
_papers("jn24_text_repair", ", source AS (SELECT id, upper(title) AS title FROM papers WHERE id % 7 = 0) SELECT papers.id AS id, coalesce(source.title, papers.title) AS title, source.id IS NOT NULL AS repaired FROM papers LEFT JOIN source ON source.id = papers.id")
_papers("jn25_saved", ", saved AS (SELECT DISTINCT o_custkey * 3 AS id FROM {orders}) SELECT papers.id AS id, title FROM saved JOIN papers ON papers.id = saved.id")
shared_sql(
    "jn26_remapped_similarity",
    """WITH kept AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 1 THEN p_partkey - 1 ELSE p_partkey END AS into_id FROM {part} WHERE p_size < 45),
s AS (SELECT a.into_id AS a, b.into_id AS b, l_discount AS w FROM {lineitem} JOIN kept a ON a.id = l_partkey JOIN kept b ON b.id = l_suppkey)
SELECT least(a, b) AS u, greatest(a, b) AS v, max(w) AS weight FROM s WHERE a <> b GROUP BY 1, 2""",
)
shared_sql(
    "jn28_edge_method",
    """WITH o AS (SELECT l_partkey, l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate, l_returnflag) AS n FROM {lineitem})
SELECT l_partkey AS src, l_suppkey AS dst, l_returnflag AS method FROM o WHERE n = 1""",
)

# aggregates

shared_sql(
    "agg19_stability",
    """WITH t AS (SELECT 1 AS seed, p_partkey AS id, p_size % 3 AS label FROM {part} UNION ALL SELECT 2, p_partkey, p_size % 6 FROM {part} UNION ALL SELECT 3, p_partkey, (p_size + p_partkey % 2) % 3 FROM {part}),
cells AS (SELECT a.seed AS s, b.seed AS t, a.label AS x, b.label AS y, CAST(count(*) AS DOUBLE) AS n FROM t a JOIN t b ON a.id = b.id AND a.seed < b.seed GROUP BY 1, 2, 3, 4),
rows_ AS (SELECT s, t, sum(n * (n - 1) / 2) AS pairs FROM (SELECT s, t, x, sum(n) AS n FROM cells GROUP BY s, t, x) r GROUP BY s, t),
cols_ AS (SELECT s, t, sum(n * (n - 1) / 2) AS pairs FROM (SELECT s, t, y, sum(n) AS n FROM cells GROUP BY s, t, y) c GROUP BY s, t),
both_ AS (SELECT s, t, sum(n * (n - 1) / 2) AS pairs, sum(n) AS n FROM cells GROUP BY s, t),
ari AS (SELECT both_.s AS s, (both_.pairs - r.pairs * c.pairs / (n * (n - 1) / 2)) / ((r.pairs + c.pairs) / 2 - r.pairs * c.pairs / (n * (n - 1) / 2)) AS v
  FROM both_ JOIN rows_ r ON r.s = both_.s AND r.t = both_.t JOIN cols_ c ON c.s = both_.s AND c.t = both_.t)
SELECT round(avg(v), 6) AS stability, count(*) AS pairs FROM ari""",
)
shared_sql(
    "agg20_mean_over_seeds",
    """WITH runs AS (SELECT l_returnflag AS alpha, l_linenumber AS seed, count(*) AS edges, avg(l_discount) AS modularity, avg(l_quantity) AS purity, max(l_tax) AS worst FROM {lineitem} GROUP BY 1, 2)
SELECT alpha, count(*) AS seeds, round(avg(edges), 4) AS edges, round(avg(modularity), 6) AS modularity, round(avg(purity), 6) AS purity, round(avg(worst), 6) AS worst FROM runs GROUP BY alpha""",
)
_RANKS = """, ranked AS (SELECT id, row_number() OVER (ORDER BY price DESC, id) AS by_price, row_number() OVER (ORDER BY cited DESC, id) AS by_citations, count(*) OVER () AS total FROM papers),
marks AS (SELECT 'price' AS metric, by_price AS rank_, total FROM ranked WHERE id % 40 = 0 UNION ALL SELECT 'citations', by_citations, total FROM ranked WHERE id % 40 = 0)"""
_papers(
    "agg21_landmark_ranks",
    _RANKS
    + """, placed AS (SELECT metric, rank_, total, row_number() OVER (PARTITION BY metric ORDER BY rank_) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM marks)
SELECT metric, CAST(max(CASE WHEN i = floor(n / 2e0) THEN rank_ END) AS BIGINT) AS upper_median, round(avg(rank_), 4) AS mean_rank, CAST(max(rank_) AS BIGINT) AS worst, count_if(rank_ <= 50) AS top50, count_if(rank_ <= total / 10e0) AS top_tenth FROM placed GROUP BY metric""",
)
_papers(
    "agg25_term_coverage",
    """, terms AS (SELECT cluster, split_part(title, ' ', 1) AS term, count(*) AS n FROM papers GROUP BY 1, 2), top AS (SELECT cluster, term FROM (SELECT cluster, term, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, term) AS place FROM terms) t WHERE place <= 3),
covered AS (SELECT papers.cluster AS cluster, id, max(CASE WHEN contains(title, term) THEN 1 ELSE 0 END) AS hit FROM papers JOIN top ON top.cluster = papers.cluster GROUP BY 1, 2),
shares AS (SELECT cluster, count(*) AS n, avg(hit) AS share FROM covered GROUP BY cluster HAVING count(*) >= 5)
SELECT count(*) AS clusters, round(sum(n * share) / sum(n), 6) AS coverage FROM shares""",
)
shared_sql("agg30_status_by_cluster", "SELECT c_mktsegment AS cluster, count(*) AS total, count_if(o_orderstatus = 'F') AS found, count_if(o_orderstatus = 'O') AS missing, count_if(o_orderstatus NOT IN ('F', 'O')) AS other FROM {customer} JOIN {orders} ON o_custkey = c_custkey GROUP BY c_mktsegment")
shared_sql("agg31_method_counters", "SELECT l_returnflag AS method, l_linestatus AS status, count(*) AS matches, count(DISTINCT concat(CAST(l_partkey AS VARCHAR(20)), '>', CAST(l_suppkey AS VARCHAR(20)))) AS edges FROM {lineitem} GROUP BY 1, 2")
_papers(
    "agg38_rewritten_corpus",
    """, canon AS (SELECT id, min(id) OVER (PARTITION BY lower(substring(title, 1, 14)), cluster) AS into_id FROM papers),
merged AS (SELECT into_id, CAST(sum(cited) AS BIGINT) AS cited, max(title) AS title, count(*) AS copies FROM papers JOIN canon ON canon.id = papers.id GROUP BY into_id),
edges AS (SELECT DISTINCT a.into_id AS src, b.into_id AS dst FROM {lineitem} JOIN canon a ON a.id = l_partkey JOIN canon b ON b.id = l_suppkey WHERE a.into_id <> b.into_id),
deg AS (SELECT dst, count(*) AS n FROM edges GROUP BY dst)
SELECT into_id AS id, title, cited, copies, coalesce(n, 0) AS in_corpus_cites FROM merged LEFT JOIN deg ON dst = into_id""",
)

# sorts and sets

_papers("srt01_by_citations", " SELECT id, cited FROM papers ORDER BY cited DESC, id LIMIT 25")
shared_sql("srt07_board_order", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS BIGINT) AS place FROM {conversations}")
shared_sql(
    "srt08_sweep_pick",
    """WITH sweep AS (SELECT l_linenumber AS alpha, round(avg(l_discount), 4) AS q, round(avg(l_tax), 4) AS r, count(*) AS n FROM {lineitem} GROUP BY 1) SELECT CAST(alpha AS BIGINT) AS alpha, q, r FROM sweep ORDER BY q DESC, r DESC, n, alpha LIMIT 1""",
)
_papers("srt09_quick_filters", " SELECT cluster, count(*) AS n FROM papers WHERE cluster <> 'Brand#11' GROUP BY cluster ORDER BY n DESC, cluster LIMIT 6")
_papers(
    "set01_first_of_lists",
    """, lists AS (SELECT id, 1 AS list FROM papers WHERE id % 100 = 0 UNION ALL SELECT id, 2 FROM papers WHERE cited > 30 UNION ALL SELECT id, 3 FROM papers WHERE year > 2020) SELECT id, min(list) AS list FROM lists GROUP BY id""",
)
shared_sql(
    "set04_parsed_universe",
    """WITH a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM {lineitem} WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM {lineitem} WHERE l_returnflag = 'N')
SELECT src, dst FROM b WHERE src IN (SELECT src FROM a)""",
)

# gates and reports

_papers(
    "ev01_landmark_gate",
    """, marks AS (SELECT id AS mark, CASE WHEN id % 3 = 0 THEN 'core' ELSE 'adjacent' END AS tier, kind AS class FROM papers WHERE id % 20 = 0), found AS (SELECT id FROM papers WHERE cited >= 25)
SELECT tier, class, count(*) AS total, count(found.id) AS present FROM marks LEFT JOIN found ON found.id = mark GROUP BY tier, class""",
)
_papers("ev02_purity_sample", ", top AS (SELECT id, cited, cluster FROM papers ORDER BY cited DESC, id LIMIT 50) SELECT cluster, count(*) AS n, CAST(sum(cited) AS BIGINT) AS cited FROM top GROUP BY cluster")
_papers("ev03_best_metric", _RANKS + ", means AS (SELECT metric, avg(rank_) AS mean_rank FROM marks GROUP BY metric) SELECT metric, round(mean_rank, 4) AS mean_rank FROM means ORDER BY mean_rank, metric LIMIT 1")
_papers(
    "ev04_cluster_profiles",
    """, top AS (SELECT cluster, id, row_number() OVER (PARTITION BY cluster ORDER BY cited DESC, id) AS place FROM papers)
SELECT papers.cluster AS cluster, count(*) AS size, count(DISTINCT kind) AS subclusters, median(CAST(year AS DOUBLE)) AS median_year, max(CASE WHEN place = 1 THEN papers.id END) AS first, max(CASE WHEN place = 2 THEN papers.id END) AS second, max(CASE WHEN place = 3 THEN papers.id END) AS third
FROM papers JOIN top ON top.id = papers.id GROUP BY papers.cluster""",
)
shared_sql(
    "ev05_three_way",
    """WITH a AS (SELECT l_partkey AS src, l_suppkey AS dst, min(l_linestatus) AS method FROM {lineitem} WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM {lineitem} WHERE l_returnflag = 'N'),
j AS (SELECT a.src IS NOT NULL AS in_a, b.src IS NOT NULL AS in_b, coalesce(method, '-') AS method FROM a FULL OUTER JOIN b ON a.src = b.src AND a.dst = b.dst)
SELECT CASE WHEN in_a AND in_b THEN 'both' WHEN in_a THEN 'a only' ELSE 'b only' END AS side, method, count(*) AS n FROM j GROUP BY 1, 2""",
)
_papers(
    "ev06_source_audit",
    """, one AS (SELECT DISTINCT l_partkey AS id FROM {lineitem} WHERE l_linenumber = 1), two AS (SELECT DISTINCT l_suppkey AS id FROM {lineitem})
SELECT kind, count(*) AS total, count(one.id) AS in_first, count(two.id) AS in_second, count_if(one.id IS NULL AND two.id IS NOT NULL) AS only_second, count_if(one.id IS NULL AND two.id IS NULL) AS nowhere
FROM papers LEFT JOIN one ON one.id = papers.id LEFT JOIN two ON two.id = papers.id GROUP BY kind""",
)
shared_sql(
    "ev07_frozen_vs_new",
    """WITH c AS (SELECT p_brand AS old, p_size % 4 AS new, CAST(count(*) AS DOUBLE) AS n FROM {part} GROUP BY 1, 2), o AS (SELECT old, sum(n) AS n FROM c GROUP BY old), w AS (SELECT new, sum(n) AS n FROM c GROUP BY new),
t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS pairs FROM c), mi AS (SELECT sum(c.n / t.n * ln(c.n * t.n / (o.n * w.n))) AS v FROM c JOIN o ON o.old = c.old JOIN w ON w.new = c.new CROSS JOIN t),
ho AS (SELECT -sum(o.n / t.n * ln(o.n / t.n)) AS v, sum(o.n * (o.n - 1) / 2) AS pairs FROM o CROSS JOIN t), hw AS (SELECT -sum(w.n / t.n * ln(w.n / t.n)) AS v, sum(w.n * (w.n - 1) / 2) AS pairs FROM w CROSS JOIN t)
SELECT round(mi.v / ((ho.v + hw.v) / 2), 6) AS nmi, round((t.pairs - ho.pairs * hw.pairs / (t.n * (t.n - 1) / 2)) / ((ho.pairs + hw.pairs) / 2 - ho.pairs * hw.pairs / (t.n * (t.n - 1) / 2)), 6) AS ari FROM t CROSS JOIN mi CROSS JOIN ho CROSS JOIN hw""",
)
shared_sql(
    "gr03_second_cluster",
    """WITH s AS (SELECT l_partkey AS a, l_suppkey AS b, l_discount + 1e-2 AS w FROM {lineitem}), e AS (SELECT a, b, w FROM s UNION ALL SELECT b, a, w FROM s),
m AS (SELECT e.a AS id, y.p_brand AS cluster, round(sum(w), 6) AS weight FROM e JOIN {part} x ON x.p_partkey = e.a JOIN {part} y ON y.p_partkey = e.b WHERE x.p_brand <> y.p_brand GROUP BY 1, 2),
r AS (SELECT id, cluster, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, cluster) AS place FROM m)
SELECT id, cluster, round(weight, 4) AS weight FROM r WHERE place = 1""",
)
