"""Parsers that turn one text into many rows: bibliographies, uploads, citations with their sections."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import latex
from tessera.functions import text as X
from tessera.session import ship

#: Characters of an entry's text that are kept.
RAW = 600


def _table(texts: DataFrame, key: str, work: Callable[[str], Iterable[tuple]], columns: str) -> DataFrame:
    """``key``, idx and ``columns`` of what ``work`` finds in each text, in order."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, i, *x) for k, t in zip(f.iloc[:, 0], f.iloc[:, 1], strict=True) for i, x in enumerate(work(t or ""))]
            yield pd.DataFrame(rows, columns=["_of", "idx", *names], dtype=object)

    ship(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"_of {kind}, idx int, {columns}")


def bibitems(text: str) -> Iterator[tuple[str, str, str]]:
    r"""Label, cite key and body of each ``\bibitem``; a body ends at the next one or at the list's end."""
    marks = [(name, a, b) for name, a, b in latex.commands(text) if name == "bibitem" or (name == "end" and latex.group(text, b)[0] == "thebibliography")]
    for (name, _, at), following in zip(marks, [*[m[1] for m in marks[1:]], len(text)], strict=False):
        if name == "bibitem":
            label, at = latex.group(text, at, "[", "]")
            cite, at = latex.group(text, at)
            if cite is not None:
                yield label or "", cite.strip(), text[at:following]


def _title(body: str) -> str:
    blocks = [b for name, _, b in latex.commands(body) if name == "newblock"]
    if blocks:
        behind = body.find("\\newblock", blocks[0])
        title = body[blocks[0] : behind if behind >= 0 else len(body)]
    else:
        start = body.find("``")
        end = body.find("''", start)
        title = body[start + 2 : end] if 0 <= start < end else ""
    return latex.plain(title).rstrip("., ").removeprefix("``").removesuffix("''")


def split_bibitems(texts: DataFrame, key: str = "id") -> DataFrame:
    r"""One row per ``\bibitem``: cite key, label year, title, ids, DOI, URLs and the plain text."""
    found = _table(texts, key, lambda t: [(label, cite, body, _title(body), latex.plain(body)) for label, cite, body in bibitems(t)], "label string, key string, body string, title string, raw string")
    year = F.coalesce(X.year_in(F.col("label")), X.year_in(F.col("raw")))
    body = F.col("body")
    return found.select(F.col("_of").alias(key), "idx", "key", "title", year.alias("year"), X.preprint_ids_in(body).alias("arxiv_ids"), X.doi_in(body).alias("doi"), X.urls_in(body).alias("urls"), F.substring("raw", 1, RAW).alias("raw"))


def biblatex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    r"""Kind, cite key and fields of each ``\entry`` of a list that biblatex wrote."""
    entry = None
    for name, _, at in latex.commands(text):
        one, behind = latex.group(text, at)
        two, _ = latex.group(text, behind)
        if name == "entry" and one is not None:
            entry = (two or "", one.strip(), {})
        elif name in ("field", "verb") and entry and one and two is not None:
            entry[2].setdefault(one.strip().lower(), latex.plain(two))
        elif name == "endentry" and entry:
            yield entry
            entry = None


def bibtex_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Kind, cite key and fields of each BibTeX entry; values are groups, quoted or bare."""
    at = text.find("@")
    while at >= 0:
        name = latex.name_at(text, at + 1)
        kind, (body, behind) = text[at + 1 : name].lower(), latex.group(text, name)
        if kind and body is not None and kind not in ("string", "comment", "preamble"):
            cite, _, rest = body.partition(",")
            fields, i = {}, 0
            while (equals := rest.find("=", i)) >= 0:
                field = rest[i:equals].strip(" \t\r\n,").lower()
                value, i = latex.group(rest, equals + 1)
                if value is None:
                    value = rest[equals + 1 :].lstrip()
                    start = len(rest) - len(value)
                    end = value.find('"', 1) if value.startswith('"') else value.find(",")
                    end = len(value) if end < 0 else end
                    i, value = start + end + 1, value[:end].strip('" \t\r\n')
                fields.setdefault(field, latex.plain(value))
            if cite.strip():
                yield kind, cite.strip(), fields
        at = text.find("@", behind if body is not None else at + 1)


def ris_entries(text: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Kind, id and fields (names as in BibTeX) of each RIS record; authors are joined by `` and ``."""
    names = {"TI": "title", "T1": "title", "AU": "author", "A1": "author", "PY": "year", "Y1": "year", "DO": "doi", "AB": "abstract", "N2": "abstract", "JO": "journal", "JF": "journal", "T2": "journal", "ID": "id"}
    kind, fields = "", {}
    for line in text.splitlines():
        tag, dash, value = line[:2], line[2:6].strip(), line[6:].strip()
        if dash != "-" or len(tag.strip()) != 2:
            continue
        if tag == "TY":
            kind, fields = value.lower(), {}
        elif tag == "ER":
            yield kind, fields.pop("id", ""), fields
            kind, fields = "", {}
        elif tag in names:
            own = names[tag]
            fields[own] = f"{fields[own]} and {value}" if own == "author" and own in fields else fields.get(own, value)


def _entries(texts: DataFrame, key: str, entries: Callable) -> DataFrame:
    get = lambda t: [(kind, cite, *[f.get(x) or None for x in ("title", "author", "year", "doi", "journal", "abstract")]) for kind, cite, f in entries(t)]
    found = _table(texts, key, get, "kind string, key string, title string, author string, said string, doi string, venue string, abstract string")
    return found.select(F.col("_of").alias(key), "idx", "kind", "key", "title", "author", X.year_in(F.col("said")).alias("year"), X.norm_doi(F.col("doi")).alias("doi"), "venue", "abstract")


def parse_bibtex(texts: DataFrame, key: str = "id") -> DataFrame:
    """One row per BibTeX entry: kind, cite key, title, author, year, DOI, venue and abstract."""
    return _entries(texts, key, bibtex_entries)


def parse_biblatex(texts: DataFrame, key: str = "id") -> DataFrame:
    """The same of a list that biblatex wrote."""
    return _entries(texts, key, biblatex_entries)


def parse_ris(texts: DataFrame, key: str = "id") -> DataFrame:
    """The same of RIS records."""
    return _entries(texts, key, ris_entries)


def upload_kind(name: Column, text: Column) -> Column:
    """``bibtex`` or ``ris`` by a file's extension, else by its content."""
    ending = F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1))
    return F.when(ending.isin("bib", "bibtex"), "bibtex").when(ending == "ris", "ris").when(text.rlike(r"(?m)^TY  - "), "ris").otherwise("bibtex")


def parse_uploads(files: DataFrame) -> DataFrame:
    """Records of uploaded files (name, text) of either kind, with the file's name."""
    kinds = files.withColumn("_kind", upload_kind(F.col("name"), F.col("text")))
    return parse_bibtex(kinds.filter("_kind = 'bibtex'"), "name").unionByName(parse_ris(kinds.filter("_kind = 'ris'"), "name"))


def source_shape(bbl: Column, tex: Column, bib: Column) -> Column:
    """Where a paper's references are read from: the first source that holds any."""
    return (
        F.when(bbl.contains("\\bibitem"), "bbl").when(tex.contains("\\bibitem"), "inline").when(bbl.contains("\\entry{"), "biblatex").when(bib.rlike(r"@[A-Za-z]+\s*\{"), "bib").when(tex.contains("\\includepdf"), "pdf_wrapper").otherwise("no_bib")
    )


def cited(text: str) -> Iterator[tuple[str | None, str, str, str]]:
    """Section, command, key and sentence of each cited key, in order."""
    section = None
    for name, start, at in latex.commands(text):
        if name in ("section", "subsection", "subsubsection"):
            section = latex.plain(latex.group(text, at)[0] or "") or None
        elif name.lower().startswith("cite"):
            for _ in range(2):
                _, at = latex.group(text, at, "[", "]")
            keys, _ = latex.group(text, at)
            for k in (keys or "").split(","):
                if k.strip():
                    yield section, name, k.strip(), latex.plain(X.sentence_at(text, start))


def citations(texts: DataFrame, key: str = "id") -> DataFrame:
    """One row per citation command and key, with the section it stands in and its sentence."""
    found = _table(texts, key, cited, "section string, command string, key string, sentence string")
    return found.withColumnRenamed("_of", key)
