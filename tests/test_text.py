"""Normalisers, extractors and fuzzy ratios on inline cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.latex import flatten_latex, group, plain


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("why should i trust you", "why should i trust you explaining the predictions of any classifier", 0.4944),
        ("umap uniform manifold approximation and projection for dimension reduction", "umap uniform manifold approximation and projection", 0.8065),
        ("massive editing for large language models via meta learning", "editing large language models", 0.6591),
        ("editing large language models problems methods and opportunities", "editing large language models", 0.6237),
    ],
)
def test_published_ratios(a, b, want):
    assert X.sort_ratio(a, b) == want
    assert X.set_ratio(a, b) == 1.0


def test_ids(spark):
    lit = F.lit
    assert one(spark, X.norm_doi(lit("https://doi.org/10.1/AbC."))) == "10.1/abc"
    assert one(spark, X.norm_doi(lit(" "))) is None
    assert one(spark, X.preprint_id(lit("arXiv:1602.04938v3"))) == "1602.04938"
    assert one(spark, X.preprint_id(lit("hep-th/9901001"))) == "hep-th/9901001"
    assert one(spark, X.preprint_id(lit("nonsense"))) is None
    assert one(spark, X.preprint_ids_in(lit("see arXiv:1602.04938 and https://arxiv.org/abs/1706.03762v5."))) == ["1602.04938", "1706.03762"]
    assert one(spark, X.urls_in(lit("at https://a.b/c). and https://a.b/c"))) == ["https://a.b/c"]
    assert one(spark, X.doi_in(lit("doi 10.1000/XYZ.1, 2019"))) == "10.1000/xyz.1"
    assert one(spark, X.year_in(lit("1999 ... 2021."))) == 2021
    assert one(spark, X.year_in(lit("none"))) is None


def test_names(spark):
    lit = F.lit
    assert one(spark, X.flip_author(lit("Ada B Lovelace"))) == "Lovelace, Ada B"
    assert one(spark, X.surnames(F.array(lit("Harris, CR"), lit("Ada Lovelace")))) == ["harris", "lovelace"]
    assert one(spark, X.fold(lit("Marín"))) == "Marin"
    assert one(spark, X.cite_key(lit("Ada Lovelace"), lit(1843), lit("x"))) == "lovelace1843"
    assert one(spark, flatten_latex(lit(r"{C}lever {H}ans \emph{and \textbf{B}} \& co"))) == "Clever Hans and B & co"
    assert one(spark, X.slug(lit(" Hello, World! "))) == "hello-world"
    assert one(spark, X.signed_percent(lit(0.256))) == "+26%"
    assert one(spark, X.percent_of(lit(1), lit(0))) == "0/0"
    assert one(spark, X.salvage_json(lit('noise {"a": {"b": 1}} tail'))) == '{"a": {"b": 1}}'
    assert one(spark, X.from_inverted_index(F.create_map(lit("b"), F.array(lit(1)), lit("a"), F.array(lit(0), lit(2))))) == "a b a"
    assert one(spark, X.title_matches(lit("A Survey"), lit("a survey: of things")))
    assert not one(spark, X.title_matches(lit(""), lit("a")))


def test_surnames_and_titles(spark):
    lit = F.lit
    names = F.array(lit("José Marín"), lit("van der Berg, X"), lit("Harris, CR"), lit("J. Marin"), lit(" "))
    assert one(spark, X.surnames(names)) == ["marin", "berg", "harris"]
    assert one(spark, X.clean_title(lit('https://a.b/c, doi:10.1000/x1. "A Title", May 2019.'))) == "A Title"
    assert one(spark, X.match_title(lit("Naïve Bayes’ rule (2001)"))) == "naive bayes rule"
    assert one(spark, X.local_id(lit(None).cast("string"), lit("nonsense"), lit("10.48550/arXiv.1602.04938"))) == "1602.04938"
    assert one(spark, X.search_box_id(lit("see arxiv:1602.04938v2"))) == "1602.04938"
    assert one(spark, X.search_box_id(lit("https://arxiv.org/abs/1602.04938v2?x"))) == "1602.04938"
    assert one(spark, X.search_box_id(lit("1602.04938 and more"))) is None
    assert one(spark, X.phrase_query(lit("Cats &amp; Dogs: a Tale"))) == '"cats dogs a tale"'
    assert one(spark, X.head_query(lit("Cats &amp; Dogs: a Tale"))) == "cats dogs"
    assert one(spark, X.words_query(lit("a b c d e f g h i j"))) == "a AND b AND c AND d AND e AND f AND g AND h"
    got = [one(spark, X.year_of(lit(x))) for x in ("1995", "1577836800000", "1577836800", "2003-05", "n.d.", None)]
    assert got == [1995, 2020, 2020, 2003, None, None]


def test_sentences():
    text = "First one. As Smith et al. show in Fig. 2 (e.g. here), it works! Next."
    assert X.sentence_at(text, text.index("show")) == "As Smith et al. show in Fig. 2 (e.g. here), it works!"
    long = "a " * 500 + "X" + " b" * 500
    assert len(X.sentence_at(long, 1000)) <= X.SENTENCE and "X" in X.sentence_at(long, 1000)
    assert X.sentence_at("", 0) == ""


def test_latex():
    assert group("x {a {b} \\} c} d", 1) == ("a {b} \\} c", 14)
    assert group("[p.~2 {]}]{k}", 0, "[", "]") == ("p.~2 {]}", 10)
    assert group("{open", 0) == (None, 0)
    assert plain(r"Erd\H{o}s, Marty \'Emile \c{c}a \ss{} \o re \textbf[x]{b {c}} 50\% a\\b {\em d}") == "Erdos, Marty Emile ca ss ore b c 50% a b d"
