"""Entity resolution: references to known works, and duplicates among works.

Both are cascades of joins from definite evidence to weak one. Fuzzy comparisons only meet
rows of near years whose titles share a token, or a piece of characters: without a common
token the set ratio is the one of the sorted tokens' texts, of m and n characters. At
TITLE_MIN these are at most 0.08 (m + n) <= 0.1741 m (rounding included) insertions and deletions apart, so of one
more pieces of the one text, at least one is in the other, at most so many places off.
Ratios run as one pandas UDF on what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.graphs import components, cut
from tessera.session import ship

#: Least set and sort ratio of a title match, and years apart.
TITLE_MIN, SORT_MIN, YEARS = 0.92, 0.85, 2


def _extra(a: Column, b: Column) -> Column:
    """Tokens of b that a lacks."""
    return F.size(F.array_except(F.split(b, " "), F.split(a, " ")))


def _sorted_tokens(t: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.split(t, " "))), " ")


def _edits(m: Column) -> Column:
    """Most insertions and deletions of a text of m characters at TITLE_MIN."""
    return F.floor(0.1741 * m).cast("int")


def _by_pieces(left: DataFrame, a: str, right: DataFrame, b: str, keys: list[str]) -> DataFrame:
    """Rows of both tables with equal keys, whose titles ``a`` and ``b`` may reach TITLE_MIN without a common token."""
    gram = lambda at, q: F.struct(F.substring(F.col("_x"), at + 1, q).alias("gram"), at.cast("int").alias("at"))
    m, q = F.col("_m"), F.when(F.col("_m") < 12, F.lit(3)).otherwise(F.lit(4))
    one = left.withColumn("_x", _sorted_tokens(a)).withColumn("_m", F.length("_x")).filter("_m >= 6")
    pieces = F.transform(F.sequence(F.lit(0), _edits(m)), lambda i: gram(F.floor(i * m / (_edits(m) + 1)).cast("int"), q))
    one = one.select(*left.columns, "_m", F.explode(pieces).alias("_p")).select(*left.columns, "_m", F.col("_p.gram").alias("_gram"), F.col("_p.at").alias("_at"))
    two = right.withColumn("_x", _sorted_tokens(b)).withColumn("_n", F.length("_x")).filter("_n >= 6")
    all_of = lambda size: F.transform(F.sequence(F.lit(0), F.col("_n") - size), lambda i: gram(i, F.lit(size)))
    grams = F.concat(all_of(3), all_of(4))
    two = two.select(*right.columns, "_n", F.explode(grams).alias("_p")).select(*right.columns, "_n", F.col("_p.gram").alias("_gram"), F.col("_p.at").alias("_to"))
    near = (F.abs(F.col("_at") - F.col("_to")) <= _edits(m)) & (F.abs(m - F.col("_n")) <= _edits(m))
    return one.join(two, [*keys, "_gram"]).filter(near).drop("_m", "_n", "_gram", "_at", "_to").distinct()


def resolve_references(refs: DataFrame, works: DataFrame) -> DataFrame:
    """citing, idx, status, work and method of refs (citing, idx, arxiv_ids, doi, title, year) against works (id, arxiv_id, doi, title, year).

    Preprint ids go before DOIs before titles. A title needs a year at most YEARS away and is
    compared with the most similar work only (of equal ones the earliest year, then the smallest id); it fails where the work's title has two or
    more tokens that the reference lacks while years differ, and where the sorted tokens
    are too different, unless the work's title is contained in the reference's and years agree.
    A reference to the citing work itself has status ``self``.
    """
    ship(refs.sparkSession)
    refs = refs.select("citing", "idx", "arxiv_ids", X.norm_doi(F.col("doi")).alias("doi"), X.match_title(F.col("title")).alias("q"), "year")
    by_id = refs.select("citing", "idx", F.posexplode("arxiv_ids").alias("place", "arxiv_id")).join(works.filter("arxiv_id is not null").select("arxiv_id", F.col("id").alias("work")), "arxiv_id")
    by_id = by_id.groupBy("citing", "idx").agg(F.min(F.struct("place", "work")).alias("x")).select("citing", "idx", F.col("x.work").alias("by_id"))
    dois = works.select(X.norm_doi(F.col("doi")).alias("doi"), F.col("id").alias("work")).filter("doi is not null").groupBy("doi").agg(F.min("work").alias("by_doi"))
    known = refs.join(by_id, ["citing", "idx"], "left").join(dois, "doi", "left")
    open_ = known.filter("by_id is null and by_doi is null and year is not null and q <> ''").select("citing", "idx", "q", "year")
    titles = works.filter("year is not null").select(F.col("id").alias("work"), X.match_title(F.col("title")).alias("t"), F.col("year").alias("y")).filter("t <> ''")
    near = open_.select("*", F.explode(F.array_distinct(F.split("q", " "))).alias("token"), F.col("year").alias("ry")).withColumn("y", F.explode(F.sequence(F.col("ry") - YEARS, F.col("ry") + YEARS)))
    pairs = near.join(titles.withColumn("token", F.explode(F.array_distinct(F.split("t", " ")))), ["y", "token"]).select("citing", "idx", "q", "ry", "work", "t", "y")
    years = open_.withColumn("ry", F.col("year")).withColumn("y", F.explode(F.sequence(F.col("ry") - YEARS, F.col("ry") + YEARS))).drop("year")
    pairs = pairs.unionByName(_by_pieces(years, "q", titles, "t", ["y"]).select(pairs.columns)).distinct()
    best = pairs.withColumn("set", X.token_set_ratio("q", "t")).filter(F.col("set") >= TITLE_MIN)
    w = Window.partitionBy("citing", "idx").orderBy(F.desc("set"), "y", "work")
    best = best.withColumn("r", F.row_number().over(w)).filter("r = 1").withColumn("sort", X.token_sort_ratio("q", "t"))
    same_year = F.col("ry") == F.col("y")
    trap = (_extra(F.col("t"), F.col("q")) == 0) & (_extra(F.col("q"), F.col("t")) >= 2) & ~same_year
    contained = (_extra(F.col("q"), F.col("t")) == 0) & (_extra(F.col("t"), F.col("q")) > 0) & same_year
    by_title = best.filter(((F.col("sort") >= SORT_MIN) | contained) & ~trap).select("citing", "idx", F.col("work").alias("by_title"))
    found = known.join(by_title, ["citing", "idx"], "left")
    work = F.coalesce("by_id", "by_doi", "by_title")
    method = F.when(F.col("by_id").isNotNull(), "eprint").when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title")
    status = F.when(work.isNull(), "unmatched").when(work == F.col("citing"), "self").otherwise("matched")
    return found.select("citing", "idx", status.alias("status"), F.when(work != F.col("citing"), work).alias("work"), method.alias("method"))


def duplicate_pairs(works: DataFrame) -> DataFrame:
    """a, b, tier, accepted of candidate duplicates among works (id, arxiv_id, doi, title, year, authors).

    Equal DOIs and preprint ids are definite. Titles, equal within a year or similar in the
    same year, are rejected by different preprint ids and by the authors: an overlap is
    needed, or half of all surnames where only one title contains the other. A work
    without authors passes.
    """
    ship(works.sparkSession)
    own = works.select("id", "arxiv_id", X.norm_doi(F.col("doi")).alias("doi"), X.match_title(F.col("title")).alias("t"), "year", X.surnames(F.coalesce("authors", F.array().cast("array<string>"))).alias("s"))
    other = own.select([F.col(c).alias(f"{c}_2") for c in own.columns])
    own = own.filter("t <> '' or doi is not null or arxiv_id is not null")
    ordered = F.col("id") < F.col("id_2")
    definite = lambda c, tier: own.join(other, own[c] == other[f"{c}_2"]).filter(ordered).withColumn("tier", F.lit(tier))
    by_doi = definite("doi", "doi").filter(~F.col("doi").startswith("10.48550/arxiv"))
    exact = own.filter("t <> ''").join(other, F.col("t") == F.col("t_2")).filter(ordered & (F.abs(F.col("year") - F.col("year_2")) <= 1)).withColumn("tier", F.lit("title_exact"))
    tokens = own.filter("t <> ''").withColumn("token", F.explode(F.array_distinct(F.split("t", " "))))
    tokens_2 = other.filter("t_2 <> ''").withColumn("token", F.explode(F.array_distinct(F.split("t_2", " "))))
    shared = tokens.join(tokens_2, (F.col("year") == F.col("year_2")) & (tokens["token"] == tokens_2["token"])).filter(ordered & (F.col("t") != F.col("t_2"))).drop("token")
    by_pieces = _by_pieces(own.filter("t <> ''").withColumn("y", F.col("year")), "t", other.filter("t_2 <> ''").withColumn("y", F.col("year_2")), "t_2", ["y"])
    shared = shared.unionByName(by_pieces.filter(ordered & (F.col("t") != F.col("t_2"))).select(shared.columns)).distinct()
    fuzzy = shared.filter(X.token_set_ratio("t", "t_2") >= TITLE_MIN).withColumn("sort", X.token_sort_ratio("t", "t_2"))
    subset = (_extra(F.col("t"), F.col("t_2")) == 0) | (_extra(F.col("t_2"), F.col("t")) == 0)
    fuzzy = fuzzy.filter((F.col("sort") >= SORT_MIN) | subset).withColumn("tier", F.lit("title_fuzzy"))
    pairs = by_doi.unionByName(definite("arxiv_id", "arxiv")).unionByName(exact).withColumn("sort", F.lit(1.0)).unionByName(fuzzy)
    rank = F.array_position(F.array(*[F.lit(x) for x in ("doi", "arxiv", "title_exact", "title_fuzzy")]), F.col("tier"))
    pairs = pairs.withColumn("r", F.row_number().over(Window.partitionBy("id", "id_2").orderBy(rank))).filter("r = 1")
    overlap, every = F.size(F.array_intersect("s", "s_2")), F.size(F.array_union("s", "s_2"))
    missing = (F.size("s") == 0) | (F.size("s_2") == 0)
    gate = missing | F.when((F.col("tier") == "title_fuzzy") & (F.col("sort") < SORT_MIN), overlap / every >= 0.5).otherwise(overlap > 0)
    conflict = F.coalesce(F.col("arxiv_id") != F.col("arxiv_id_2"), F.lit(False))
    accepted = ~F.col("tier").startswith("title") | (~conflict & gate)
    return pairs.select(F.col("id").alias("a"), F.col("id_2").alias("b"), "tier", "sort", accepted.alias("accepted"))


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(id, component) of works tied by accepted pairs."""
    return components(pairs.filter("accepted").select(F.col("a").alias("src"), F.col("b").alias("dst")))


def near_misses(edges: DataFrame, titles: DataFrame, references: DataFrame) -> DataFrame:
    """citing, cited, similarity (3 decimals) and title of the unmatched reference of the citing work
    whose title is most like the cited one's; 0 and an empty title where there is none.

    Edges are (citing, cited), titles (id, title), references (citing, idx, title, status); of
    equally similar references the first by idx.
    """
    ship(edges.sparkSession)
    pool = references.filter("status = 'unmatched'").select("citing", "idx", F.col("title").alias("original"), X.match_title(X.clean_title(F.col("title"))).alias("t")).filter("t <> ''")
    asked = edges.select("citing", "cited").distinct().join(titles.select(F.col("id").alias("cited"), X.match_title(F.col("title")).alias("q")), "cited", "left")
    rated = asked.join(pool, "citing").withColumn("s", X.token_set_ratio(F.coalesce("q", F.lit("")), F.col("t"))).filter("s > 0")
    best = rated.groupBy("citing", "cited").agg(F.max_by(F.struct("s", "original"), F.struct("s", -F.col("idx"))).alias("b"))
    both = asked.join(best, ["citing", "cited"], "left")
    return both.select("citing", "cited", F.coalesce(F.round("b.s", 3), F.lit(0.0)).alias("similarity"), F.substring(F.coalesce("b.original", F.lit("")), 1, 80).alias("title"))


_HIT = ("id", "title", "year")


def title_lookup(pubs: DataFrame, definite: DataFrame, search: DataFrame, years: int | None = YEARS, trusted: bool = True) -> DataFrame:
    """pub, found, via, id, title, year, corrupt_title, rejected_year and near_miss of pubs (pub, title, year)
    in one source's answers: ``definite`` by identifier, ``search`` by title (both: pub, place, id, title, year).

    A definite answer is taken whatever its title, and flagged where that doesn't match
    (``trusted``), or only if it does. Else the first search answer whose title matches and whose year is at most
    ``years`` away (any year if None); where only the year speaks against it, it is the near miss.
    A pub without a row in ``search`` wasn't checked: ``found`` is null, not false.
    """
    own = pubs.select("pub", F.col("title").alias("wanted"), F.col("year").alias("wanted_year"))
    hit = F.struct(*_HIT)

    def first(answers: DataFrame, name: str, when: Column) -> DataFrame:
        rows = answers.join(own, "pub").withColumn("same", X.title_matches(F.col("wanted"), F.col("title"))).filter(when)
        return rows.groupBy("pub").agg(F.min_by(F.struct(hit.alias("hit"), "same"), "place").alias(name))

    near_year = F.lit(True) if years is None else F.coalesce(F.abs(F.col("year") - F.col("wanted_year")) <= years, F.lit(False))
    sure = first(definite, "sure", F.lit(True) if trusted else F.col("same"))
    good = first(search, "good", F.col("same") & near_year)
    near = first(search, "near", F.col("same"))
    asked = search.select("pub").distinct().withColumn("asked", F.lit(True))
    rows = own
    for part in (sure, good, near, asked):
        rows = rows.join(part, "pub", "left")
    taken = F.coalesce("sure.hit", "good.hit")
    by_id, by_title = F.col("sure").isNotNull(), F.col("good").isNotNull()
    missed = ~by_id & ~by_title & F.col("near").isNotNull()
    return rows.select(
        "pub",
        F.when(by_id | by_title, F.lit(True)).when(F.col("asked"), F.lit(False)).alias("found"),
        F.when(by_id, "identifier").when(by_title, "title").alias("via"),
        *[taken[c].alias(c) for c in _HIT],
        (by_id & ~F.coalesce("sure.same", F.lit(True))).alias("corrupt_title"),
        missed.alias("rejected_year"),
        F.when(missed, F.col("near.hit")).alias("near_miss"),
    )


#: Characters of the pieces that texts are met by.
PIECE = 4


def _pieces(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters."""
    n = F.char_length(text) - size + 1
    return F.array_distinct(F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>")))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(text, part): all pairs of distinct texts (text) and parts (part) that they contain, as contains() has it.

    A part meets the texts that have the rarest of its pieces, one shorter than a piece those that have it as a whole.
    """
    texts, parts = cut(texts.select("text").filter("text is not null").distinct()), cut(parts.select("part").filter("part is not null").distinct())
    pieces = texts.select("text", F.explode(_pieces(F.col("text"), PIECE)).alias("piece"))
    often = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    asked = parts.filter(F.char_length("part") >= PIECE).select("part", F.explode(_pieces(F.col("part"), PIECE)).alias("piece"))
    # a piece that no text has rules its part out
    rarest = asked.join(often, "piece", "left").groupBy("part").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("piece"))
    found = pieces.join(rarest, "piece").filter(F.contains("text", "part")).select("text", "part")
    short = parts.withColumn("size", F.char_length("part")).filter(F.col("size") < PIECE)
    for size in range(PIECE):
        whole = texts.select("text", F.explode(_pieces(F.col("text"), size) if size else F.array(F.lit(""))).alias("part"))
        found = found.unionByName(whole.join(short.filter(F.col("size") == size).select("part"), "part").select("text", "part"))
    return found
