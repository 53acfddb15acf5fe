"""Published decisions on duplicates, and the stated rules of reference resolution."""

from tessera.operators import resolution as R

WORKS = [
    (1, None, None, '"Why Should I Trust You?"', 2016, ["Marco Ribeiro", "Sameer Singh"]),
    (2, None, None, "“Why Should I Trust You?”: Explaining the Predictions of Any Classifier", 2016, ["M. Ribeiro", "S. Singh"]),
    (3, None, None, "UMAP: Uniform Manifold Approximation and Projection for Dimension Reduction", 2018, ["Leland McInnes", "John Healy"]),
    (4, None, None, "UMAP: Uniform Manifold Approximation and Projection", 2018, ["Leland McInnes", "A Saul", "B Grossberger"]),
    (5, "2302.00001", None, "Augmented Language Models: a Survey", 2023, None),
    (6, "2312.00002", None, "Retrieval-Augmented Generation for Large Language Models: A Survey", 2023, None),
    (7, None, "10.1/X", "One title", 2001, ["A B"]),
    (8, None, "https://doi.org/10.1/x.", "Another thing", 2005, ["C D"]),
    (9, None, None, "Same words here", 2010, []),
    (10, None, None, "same Words, here", 2011, ["E F"]),
]
SCHEMA = "id long, arxiv_id string, doi string, title string, year int, authors array<string>"


def test_duplicates(spark):
    got = {(r.a, r.b): (r.tier, r.accepted) for r in R.duplicate_pairs(spark.createDataFrame(WORKS, SCHEMA)).collect()}
    assert got == {(1, 2): ("title_fuzzy", True), (3, 4): ("title_fuzzy", False), (7, 8): ("doi", True), (9, 10): ("title_exact", True)} | ({(5, 6): ("title_fuzzy", False)} if (5, 6) in got else {})


def test_references(spark):
    refs = [
        (100, 0, ["2302.00001"], None, "anything", None),
        (100, 1, [], "doi:10.1/X", "anything", None),
        (100, 2, [], None, "same words HERE", 2009),
        (100, 3, [], None, "Uniform Manifold Approximation and Projection for Dimension", 2017),
        (100, 4, [], None, "Why should I trust you? Explaining the predictions of any classifier", None),
        (1, 5, [], None, "Why should I trust you", 2016),
        (100, 6, [], None, "Nothing like it", 2016),
        (100, 7, [], None, "One title with very much more to say", 2001),
        (100, 8, [], None, "One title with very much more to say", 2002),
    ]
    df = spark.createDataFrame(refs, "citing long, idx int, arxiv_ids array<string>, doi string, title string, year int")
    got = {r.idx: (r.status, r.work, r.method) for r in R.resolve_references(df, spark.createDataFrame(WORKS, SCHEMA)).collect()}
    assert got[0] == ("matched", 5, "eprint")
    assert got[1][0] == "matched" and got[1][2] == "doi"
    assert got[2] == ("matched", 9, "title")
    assert got[4][0] == "unmatched"  # no year
    assert got[5] == ("self", None, "title")
    assert got[6][0] == "unmatched"
    assert got[7] == ("matched", 7, "title")  # the work's title is contained, years agree
    assert got[8][0] == "unmatched"


def test_titles_without_a_common_token(spark):
    pairs = [("transformers", "transformer"), ("pre training", "pretraining"), ("auto encoders", "autoencoders"), ("word embeddings", "words embedding"), ("nothing", "different")]
    works = [(2 * k + j, None, None, t, 1990 + 5 * k, []) for k, two in enumerate(pairs) for j, t in enumerate(two)]
    got = {(r.a, r.b): (r.tier, r.accepted) for r in R.duplicate_pairs(spark.createDataFrame(works, SCHEMA)).collect()}
    assert got == {(2 * k, 2 * k + 1): ("title_fuzzy", True) for k in range(4)}
    refs = [(100, k, [], None, two[1], 1991 + 5 * k) for k, two in enumerate(pairs)]
    df = spark.createDataFrame(refs, "citing long, idx int, arxiv_ids array<string>, doi string, title string, year int")
    found = R.resolve_references(df, spark.createDataFrame(works[::2], SCHEMA)).collect()
    assert {r.idx: (r.status, r.work) for r in found} == {k: ("matched", 2 * k) for k in range(4)} | {4: ("unmatched", None)}


def test_near_misses(spark):
    edges = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "citing long, cited long")
    titles = spark.createDataFrame([(10, "Deep residual learning"), (11, "Quantum foam")], "id long, title string")
    refs = spark.createDataFrame([(1, 0, "Deep residual learning", "matched"), (1, 1, "Deep residual learnin", "unmatched"), (1, 2, "Deep residual learnin", "unmatched"), (1, 3, None, "unmatched")], "citing long, idx int, title string, status string")
    got = {(r.citing, r.cited): (r.similarity, r.title) for r in R.near_misses(edges, titles, refs).collect()}
    assert got[(1, 10)][0] > 0.95 and got[(1, 10)][1] == "Deep residual learnin"
    assert got[(1, 11)][0] < 0.6
    assert got[(2, 10)] == (0.0, "")


def test_title_lookup(spark):
    pubs = spark.createDataFrame([(1, "Toy models of superposition", 2022), (2, "Scaling monosemanticity", 2024), (3, "A real paper", 2020), (4, "Absent", 2020), (5, "Unchecked", 2020)], "pub long, title string, year int")
    schema = "pub long, place int, id string, title string, year int"
    definite = spark.createDataFrame([(1, 0, "W1", "Governance of neural things", 2022)], schema)
    search = spark.createDataFrame([(1, 0, "W9", "Toy models of superposition", 2022), (2, 0, "W2", "Scaling Monosemanticity", 2027), (3, 0, "W3", "Something else entirely", 2020), (3, 1, "W4", "A real paper", 2021), (4, 0, "W5", "Other", 2020)], schema)
    got = {r.pub: r for r in R.title_lookup(pubs, definite, search).collect()}
    assert (got[1].found, got[1].via, got[1].id, got[1].corrupt_title) == (True, "identifier", "W1", True)
    assert (got[2].found, got[2].rejected_year, got[2].near_miss.id) == (False, True, "W2")
    assert (got[3].via, got[3].id, got[3].rejected_year, got[3].near_miss) == ("title", "W4", False, None)
    assert got[4].found is False and got[5].found is None
    second = {r.pub: r for r in R.title_lookup(pubs, definite, search, years=None, trusted=False).collect()}
    assert second[1].id == "W9" and second[2].id == "W2"


def test_containing(spark):
    """Every pair that contains() finds, by pieces only: no join without an equal key."""
    words = ["", "a", "ab", "abc", "abcd", "bcde", "abcdeabcd", "xxabcdyy", "ÄÖab", "öab", "ab\U0001f600cd", "\U0001f600cd", "zzzz", "zz", None]
    texts = spark.createDataFrame([(w,) for w in words + ["abcd"]], "text string")
    parts = spark.createDataFrame([(w,) for w in words + ["absent", "abcdZ"]], "part string")
    found = R.containing(texts, parts)
    known = [w for w in words if w is not None]
    assert sorted(tuple(r) for r in found.collect()) == sorted((t, p) for t in known for p in known if p in t)
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_landmarks_without_comparing_all(spark):
    from tessera.plans import records  # noqa: F401
    from tessera.plans.registry import queries

    plan = queries()["jn09_landmarks"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
