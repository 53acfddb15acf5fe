"""Readers and parsers on inline cases."""

from pyspark.sql import functions as F

from tessera.sources import bibliography as B
from tessera.sources import readers as R


def test_bibitems(spark):
    text = r"""\begin{thebibliography}{9}
\bibitem[Ribeiro et~al.(2016)]{lime} Ribeiro, M. \newblock ``Why {S}hould I Trust You?''. \newblock arXiv:1602.04938, 2015.
\bibitem{b2} Someone. \newblock A title. \newblock doi 10.1000/XYZ.1, 1999. \url{https://a.b/c}
\end{thebibliography} tail"""
    rows = B.split_bibitems(spark.createDataFrame([(1, text), (2, "nothing")], "id long, text string")).orderBy("idx").collect()
    assert [(r.id, r.key, r.year) for r in rows] == [(1, "lime", 2016), (1, "b2", 1999)]
    assert rows[0].arxiv_ids == ["1602.04938"] and rows[1].doi == "10.1000/xyz.1" and rows[1].title == "A title"
    assert rows[1].urls == ["https://a.b/c"] and "tail" not in rows[1].raw


def test_bibtex(spark):
    text = '@string{x = "y"}\n@article{a1, title = {The {B}ig \\emph{one}}, year = 2020, doi = "https://doi.org/10.1/X"}\n@book{ b2 , Title="Quoted", year={1999}}'
    rows = B.parse_bibtex(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("idx").collect()
    assert [(r.kind, r.key, r.title, r.year, r.doi) for r in rows] == [("article", "a1", "The Big one", 2020, "10.1/x"), ("book", "b2", "Quoted", 1999, None)]


def test_citations(spark):
    text = r"As \cite{z} said. \section{Intro} See \citep[p.~2]{a, b}. \subsection*{More} And \Citet{c}."
    rows = B.citations(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("idx", "key").collect()
    assert [(r.section, r.command, r.key) for r in rows] == [(None, "cite", "z"), ("Intro", "citep", "a"), ("Intro", "citep", "b"), ("More", "Citet", "c")]
    assert rows[0].sentence == "As z said." and rows[3].sentence.startswith("More And c")


def test_other_bibliographies(spark):
    text = r"\entry{k1}{article}{} \field{title}{A {B} of C} \field{year}{2011} \verb{doi} \endverb \endentry \entry{k2}{book}{}\field{title}{D}\endentry"
    rows = B.parse_biblatex(spark.createDataFrame([(1, text)], "id long, text string")).orderBy("idx").collect()
    assert [(r.kind, r.key, r.title, r.year) for r in rows] == [("article", "k1", "A B of C", 2011), ("book", "k2", "D", None)]
    ris = "TY  - JOUR\nTI  - A Title\nAU  - Doe, J\nAU  - Roe, R\nPY  - 2001/02\nDO  - 10.1/Z\nER  - \nTY  - BOOK\nT1  - Two\nER  - \n"
    files = [("a.ris", ris), ("b.txt", ris), ("c.bib", "@misc{m, title={T}}"), ("d", "no records")]
    rows = B.parse_uploads(spark.createDataFrame(files, "name string, text string")).orderBy("name", "idx").collect()
    assert [(r.name, r.title) for r in rows] == [("a.ris", "A Title"), ("a.ris", "Two"), ("b.txt", "A Title"), ("b.txt", "Two"), ("c.bib", "T")]
    assert (rows[0].author, rows[0].year, rows[0].doi) == ("Doe, J and Roe, R", 2001, "10.1/z")
    shapes = [("\\bibitem{a}", "", ""), ("", "\\bibitem{a}", ""), ("\\entry{a}", "", "@a{b}"), ("", "", "@a{b}"), ("", "\\includepdf{x}", ""), (None, None, None)]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(shapes)], "i int, bbl string, tex string, bib string").select("i", B.source_shape(F.col("bbl"), F.col("tex"), F.col("bib")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == ["bbl", "inline", "biblatex", "bib", "pdf_wrapper", "no_bib"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": broken\n{"a": 2}\n')
    assert sorted(r.a for r in R.json_lines(spark, str(tmp_path / "a.jsonl"), "a int").collect() if r.a) == [1, 2]
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": 3}]')
    assert sorted(r.a for r in R.json_document(spark, str(tmp_path / "b.json"), "a int").collect()) == [1, 3]
    keyed = R.keyed_object(spark.createDataFrame([('{"1": {"n": 2}, "other": {"n": 3}}',)], "x string"), "x", "struct<n: int>")
    assert {r.key: r.value.n for r in keyed.collect()} == {"1": 2, "other": 3}


def test_works(spark):
    work = '{"id": "https://openalex.org/W1", "title": "T", "publication_year": 2020, "authorships": [{"author": {"display_name": "A B"}}], "concepts": [{"display_name": "c1"}, {"display_name": "c2"}], "abstract_inverted_index": {"world": [1], "hello": [0]}, "doi": "https://doi.org/10.1/X", "primary_location": {"landing_page_url": "https://arxiv.org/abs/1602.04938v2", "source": {"display_name": "V"}}, "referenced_works": ["https://openalex.org/W2"]}'
    row = R.flatten_works(spark.createDataFrame([(work,)], "x string").select(F.from_json("x", R.WORK).alias("w")).select("w.*")).head()
    assert (row.id, row.authors, row.abstract, row.categories, row.doi, row.venue, row.arxiv_id, row.edges) == ("W1", ["A B"], "hello world", "c1, c2", "10.1/x", "V", "1602.04938", ["W2"])


def test_addresses(spark):
    urls = ["https://openalex.org/works/W12", "https://arxiv.org/pdf/1602.04938v1.pdf", "https://doi.org/10.1000/A", "https://x.y"]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", R.resolve_address(F.col("u")).alias("x")).orderBy("i").collect()
    assert [tuple(r.x) for r in rows] == [("work", "W12"), ("preprint", "1602.04938"), ("doi", "10.1000/a"), ("other", None)]
