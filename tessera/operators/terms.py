"""Terms that set groups apart, labels from n-grams, quotes in texts, text exports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def _top(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("g").orderBy(F.desc("score"), "term")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).select("g", "term", "score")


def distinctive(rows: DataFrame, k: int, least: int = 2) -> DataFrame:
    """g, term and score of the k terms with most weight in each group of (g, terms)."""
    pairs = rows.select("g", F.explode("terms").alias("term"))
    # counts by group and term are summed once more for the counts by term: one pass over the tokens
    own = pairs.groupBy("g", "term").agg(F.count(F.lit(1)).alias("dfc"))
    df = own.groupBy("term").agg(F.sum("dfc").alias("df"))
    size = rows.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("size"))
    n = rows.agg(F.count(F.lit(1)).cast("double").alias("n"))
    scored = own.filter(F.col("dfc") >= least).join(df, "term").join(size, "g").crossJoin(F.broadcast(n))  # one row
    return _top(scored.select("g", "term", F.round(F.col("dfc") / F.col("size") * F.ln(F.col("n") / (1 + F.col("df"))), 6).alias("score")), k)


def ngram_labels(rows: DataFrame, k: int) -> DataFrame:
    """g, term and score of the k best words (weight 0.7) and word pairs of each group of (g, words)."""
    words = F.transform("words", lambda w: F.struct(w.alias("term"), F.lit(0.7).alias("k")))
    heads, tails = F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words"))
    pairs = F.transform(F.arrays_zip(heads.alias("a"), tails.alias("b")), lambda x: F.struct(F.concat_ws(" ", x["a"], x["b"]).alias("term"), F.lit(1.0).alias("k")))
    terms = rows.select("g", F.inline(F.concat(words, pairs)))
    own = terms.groupBy("g", "term", "k").agg(F.count(F.lit(1)).alias("c"))
    every = own.groupBy("term").agg(F.sum("c").alias("all"))
    return _top(own.filter("c >= 2").join(every, "term").select("g", "term", F.round(F.col("k") * (F.col("c") + 0.5) / (F.col("all") + 1), 6).alias("score")), k)


def quoted(quotes: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """(item_id, doc_id) where a document holds the quote, white space and case apart.

    Candidates share n words of the quote, without its first and last one, which a word boundary may
    hide (a quote that begins or ends inside a word); or all that are left of a shorter quote. So
    these are equi-joins. Only quotes of one or two words, which have no inner word, meet every text.
    """
    def grams(words: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))

    q = quotes.select("item_id", X.collapse(F.col("text")).alias("q")).withColumn("w", F.split("q", " "))
    q = q.withColumn("inner", F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))))
    t = docs.select("doc_id", X.collapse(F.col("text")).alias("t"))
    q = q.withColumn("k", F.least(F.size("inner"), F.lit(n)))
    found = q.filter("k = 0").join(t, F.contains("t", F.col("q"))).select("item_id", "doc_id")
    for k in sorted(r["k"] for r in q.select("k").distinct().collect()):  # n + 1 sizes at most
        if k:
            own = q.filter(F.col("k") == k).select("item_id", "q", F.array_join(F.slice("inner", 1, k), " ").alias("gram"))
            split = t.select("doc_id", F.split("t", " ").alias("w"))  # once a text, not once a gram
            keys = split.select("doc_id", F.explode(F.array_distinct(grams(F.col("w"), k))).alias("gram"))
            found = found.unionByName(keys.join(own, "gram").select("doc_id", "item_id", "q").join(t, "doc_id").filter(F.contains("t", F.col("q"))).select("item_id", "doc_id"))
    return found.distinct()


def bibtex_entry(key: Column, fields: dict[str, Column]) -> Column:
    """A BibTeX article; fields that are null are left out."""
    lines = F.array_join(F.filter(F.array(*[F.concat(F.lit(f"  {n} = {{"), c, F.lit("}")) for n, c in fields.items()]), lambda x: x.isNotNull()), ",\n")
    return F.concat(F.lit("@article{"), key, F.lit("\n"), lines, F.lit("\n}"))


def digest_of_texts(df: DataFrame, group: str, order: str, text: str, name: str) -> DataFrame:
    """md5 of each group's texts in order, one after the other (nulls left out).

    The digest of a concatenation is taken in sequence by its definition, so a group is read by
    one task; but as a sorted stream of batches, never held or concatenated.
    """
    schema = df.select(F.col(group), F.lit("").alias(name)).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        done = lambda: pa.RecordBatch.from_pylist([{group: current, name: digest.hexdigest()}], schema=target)
        for batch in batches:
            target = pa.schema([batch.schema.field(group), pa.field(name, pa.string())])
            for key, value in zip(batch.column(group).to_pylist(), batch.column(text), strict=True):
                if digest is None or key != current:
                    if digest is not None:
                        yield done()
                    current, digest = key, hashlib.md5(usedforsecurity=False)
                digest.update((value.as_py() or "").encode())
        if digest is not None:
            yield done()

    rows = df.select(group, order, text).repartition(group).sortWithinPartitions(group, order)
    return rows.select(group, text).mapInArrow(run, schema)
