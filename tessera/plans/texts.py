"""Queries over document texts, page addresses and part names: normalising, terms, labels, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import terms as T
from tessera.plans.registry import query
from tessera.session import table

STOP = ["the", "and", "for", "with", "from", "der", "die", "und", "les", "des", "que", "una", "los"]
_STOP = ", ".join(f"'{w}'" for w in STOP)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


@query("fn01_norm_title", "SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS title FROM part")
def norm_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.norm_title(F.col("p_name")).alias("title"))


@query("fn02_fold", "SELECT doc_id, md5(strip_accents(text)) AS h FROM documents")
def fold(spark: SparkSession, d: str) -> DataFrame:
    from tessera.session import ship

    ship(spark)
    return _docs(spark, d).select("doc_id", F.md5(X.fold("text").cast("binary")).alias("h"))


@query("fn15_tokens", f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}'), lambda t: t NOT IN ({_STOP}))) AS n FROM documents")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.size(X.tokens(F.col("text"), STOP)).cast("long").alias("n"))


@query("fn16_collapse", "SELECT item_id, md5(trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS h FROM benchmark")
def collapse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.md5(X.collapse(F.col("text")).cast("binary")).alias("h"))


@query("fn11_urls", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_replace(url, '[?#].*$', '') AS bare FROM pages")
def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("bare"))


@query("fn23_content_hash", "SELECT source, md5(string_agg(text, '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return T.digest_of_texts(_docs(spark, d), "source", "doc_id", "text", "h")


@query("prj07_truncate", "SELECT doc_id, text[1:120] AS head, array_to_string(string_split_regex(text, '\\s+')[1:20], ' ') AS words FROM documents")
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.substring("text", 1, 120).alias("head"), F.array_join(F.slice(F.split("text", "\\s+"), 1, 20), " ").alias("words"))


@query("prj18_slug", "SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'untitled') AS slug FROM part")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", X.slug(F.col("p_type")).alias("slug"))


KEYWORDS = ["tion", "the", "ung", "eau", "ción"]


@query("flt02_keyword_score", "SELECT doc_id, " + " + ".join(f"contains(lower(text), '{k}')::INT" for k in KEYWORDS) + " AS hits, contains(lower(text), 'ung') AND contains(lower(text), 'der') AS strong FROM documents")
def keyword_score(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return _docs(spark, d).select("doc_id", X.keyword_hits(F.col("text"), KEYWORDS).alias("hits"), (low.contains("ung") & low.contains("der")).alias("strong"))


@query("flt03_corpus_predicate", "SELECT doc_id FROM documents WHERE (contains(lower(text), 'ung') AND contains(lower(text), 'der')) OR (" + " + ".join(f"contains(lower(text), '{k}')::INT" for k in KEYWORDS) + ") >= 2")
def corpus_predicate(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return _docs(spark, d).filter((low.contains("ung") & low.contains("der")) | (X.keyword_hits(F.col("text"), KEYWORDS) >= 2)).select("doc_id")


@query("flt06_corrupt_metadata", "SELECT doc_id, source IN ('src3', 'src7') AS corrupt FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def corrupt_metadata(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "labels").filter("quality = 1").select("doc_id")
    return _docs(spark, d).join(seeds, "doc_id", "left_anti").select("doc_id", F.col("source").isin("src3", "src7").alias("corrupt"))


@query("flt15_quote_validity", """WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS q FROM benchmark), t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id FROM q JOIN t ON contains(t, q)""")
def quote_validity(spark: SparkSession, d: str) -> DataFrame:
    return T.quoted(table(spark, d, "benchmark"), _docs(spark, d))


_TOK = f"WITH t AS (SELECT doc_id, lang AS g, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z\\-]{{2,}}'), lambda t: t NOT IN ({_STOP})))) AS term FROM documents)"


@query("agg23_document_frequency", _TOK + " SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING count(*) >= 5")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text"), STOP))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5")


@query("agg24_distinctive_terms", _TOK + """, n AS (SELECT count(*)::DOUBLE AS n FROM documents), s AS (SELECT lang AS g, count(*)::DOUBLE AS size FROM documents GROUP BY 1),
w AS (SELECT term, count(*) AS df FROM t GROUP BY 1), c AS (SELECT g, term, count(*) AS dfc FROM t GROUP BY 1, 2),
x AS (SELECT g, term, round(dfc / size * ln(n / (1 + df)), 6) AS score FROM c JOIN w USING (term) JOIN s USING (g), n WHERE dfc >= 2)
SELECT g, term, score FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, term) <= 8""")
def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", F.col("lang").alias("g"), F.array_distinct(X.tokens(F.col("text"), STOP)).alias("terms"))
    return T.distinctive(rows, 8)


@query("agg26_ngram_labels", """WITH t AS (SELECT p_brand AS g, p_partkey, string_split(p_name, ' ') AS w FROM part), u AS (SELECT g, p_partkey, unnest(w) AS term, 0.7 AS k FROM t UNION ALL SELECT g, p_partkey, w[i] || ' ' || w[i + 1], 1.0 FROM t, range(1, 10) r(i) WHERE i < len(w)),
c AS (SELECT g, term, k, count(*) AS c FROM u GROUP BY 1, 2, 3), a AS (SELECT term, sum(c) AS c_all FROM c GROUP BY 1),
x AS (SELECT g, term, round(k * (c + 0.5) / (c_all + 1), 6)::DOUBLE AS score FROM c JOIN a USING (term) WHERE c >= 2)
SELECT g, term, score FROM x QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, term) <= 3""")
def ngram_labels(spark: SparkSession, d: str) -> DataFrame:
    return T.ngram_labels(table(spark, d, "part").select(F.col("p_brand").alias("g"), F.split("p_name", " ").alias("words")), 3)


@query("snk08_bibtex", """SELECT c_custkey, '@article{' || lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) || chr(10) || '  title = {' || c_mktsegment || '},' || chr(10) || '  year = {' || (1990 + c_nationkey) || '}' || chr(10) || '}' AS entry FROM customer""")
def bibtex(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", "")).alias("key"), F.col("c_mktsegment").alias("title"), (F.col("c_nationkey") + 1990).cast("string").alias("year"))
    return c.select("c_custkey", T.bibtex_entry(F.col("key"), {"title": F.col("title"), "year": F.col("year")}).alias("entry"))


@query("snk09_markdown", """SELECT c_mktsegment AS section, '## ' || c_mktsegment || chr(10) || string_agg('- ' || c_name, chr(10) ORDER BY c_custkey) AS md FROM customer GROUP BY 1""")
def markdown(spark: SparkSession, d: str) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("c_custkey", "c_name")))
    lines = F.array_join(F.transform(own, lambda x: F.concat(F.lit("- "), x["c_name"])), "\n")
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("section")).agg(lines.alias("lines")).select("section", F.concat(F.lit("## "), "section", F.lit("\n"), "lines").alias("md"))


@query("agg27_nested_collect", """SELECT c_nationkey, string_agg(c_custkey || ':' || c_mktsegment, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY 1""")
def nested_collect(spark: SparkSession, d: str) -> DataFrame:
    own = F.array_sort(F.collect_list(F.struct("c_custkey", "c_mktsegment")))
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["c_custkey"].cast("string"), x["c_mktsegment"])), ",").alias("members"))


@query("fn27_json", "SELECT event_id, (props->>'k')::INT AS k FROM events")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("jn13_duplicate_candidates", """WITH n AS (SELECT doc_id, n_chars, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.k = b.k AND a.doc_id < b.doc_id AND abs(a.n_chars - b.n_chars) <= 1""")
def duplicate_candidates(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select("doc_id", "n_chars", F.md5(X.norm_title(F.col("text")).cast("binary")).alias("k"))
    m = n.select(F.col("doc_id").alias("b"), F.col("n_chars").alias("m"), "k")
    return n.join(m, "k").filter((F.col("doc_id") < F.col("b")) & (F.abs(F.col("n_chars") - F.col("m")) <= 1)).select(F.col("doc_id").alias("a"), "b")


@query("win14_canonical", """WITH n AS (SELECT doc_id, n_chars, source, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY k ORDER BY n_chars DESC, source, doc_id) AS canonical, count(*) OVER (PARTITION BY k) AS size FROM n""")
def canonical(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select("doc_id", "n_chars", "source", F.md5(X.norm_title(F.col("text")).cast("binary")).alias("k"))
    best = n.groupBy("k").agg(F.min_by("doc_id", F.struct(-F.col("n_chars"), "source", "doc_id")).alias("canonical"), F.count(F.lit(1)).alias("size"))
    return n.join(best, "k").select("doc_id", "canonical", "size")


@query("agg34_merge_groups", """WITH n AS (SELECT doc_id, n_chars, source, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS k FROM documents)
SELECT min(doc_id) AS id, sum(n_chars)::BIGINT AS total, max(n_chars) AS most, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(*) AS n FROM n GROUP BY k HAVING count(*) > 1""")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    n = _docs(spark, d).select("doc_id", "n_chars", "source", F.md5(X.norm_title(F.col("text")).cast("binary")).alias("k"))
    return n.groupBy("k").agg(F.min("doc_id").alias("id"), F.sum("n_chars").alias("total"), F.max("n_chars").alias("most"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("k")


@query("ext_tumbling_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    from tessera.streaming.events import tumbling_counts as run

    return run(spark, f"{d}/events.parquet")


@query("ext_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM h GROUP BY user_id, session""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


@query("prj16_short_abstract", """WITH t AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS raw FROM documents),
s AS (SELECT doc_id, raw, trim(array_to_string(regexp_extract_all(raw, '[^.!?]+[.!?]+')[1:3], ' ')) AS three FROM t)
SELECT doc_id, CASE WHEN length(three) > 320 THEN three[1:317] || '…' WHEN three = '' AND raw <> '' THEN raw[1:317] || '…' ELSE three END AS short FROM s""")
def short_abstract(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.short_abstract(F.col("text")).alias("short"))
