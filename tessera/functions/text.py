"""Normalisers and extractors for titles, names, identifiers and free text.

Everything is a Column expression, but for :func:`fold` and the fuzzy ratios, which need
Unicode decomposition and an edit distance that Spark lacks; those run as Arrow-batched
pandas UDFs.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Prefixes under which a DOI may be written.
DOI_PREFIX = r"^(https?://(dx\.)?doi\.org/|doi:\s*)"
#: Shapes of preprint ids, new and old style.
PREPRINT_ID = r"(\d{4}\.\d{4,5}|[a-z\-]+(\.[a-z]{2})?/\d{7})"


def norm_title(s: Column) -> Column:
    """Lower case, everything but ASCII letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def collapse(s: Column) -> Column:
    """Lower case with white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(s), r"\s+", " "))


def tokens(s: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words of three or more letters and hyphens, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(s), F.lit(r"([a-z][a-z\-]{2,})"), 1)
    return F.filter(found, lambda t: ~t.isin(stop)) if stop else found


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def title_matches(a: Column, b: Column) -> Column:
    """Normalised titles that are equal, or one a prefix of the other, or share 60 % of their tokens."""
    x, y = norm_title(a), norm_title(b)
    filled = (F.length(x) > 0) & (F.length(y) > 0)
    return filled & ((x == y) | x.startswith(y) | y.startswith(x) | (token_jaccard(x, y) >= 0.6))


def norm_doi(s: Column) -> Column:
    """Lower case without URL prefix and trailing dots; empty becomes null."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), DOI_PREFIX, ""), r"\.+$", ""), F.lit(""))


def preprint_id(s: Column) -> Column:
    """A cleaned preprint id without prefix and version, or null if it has another shape."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(s)), r"^(https?://arxiv\.org/(abs|pdf)/|arxiv:\s*)", ""), r"(v\d+)?(\.pdf)?$", "")
    return F.when(x.rlike(f"^{PREPRINT_ID}$"), x)


def preprint_ids_in(s: Column) -> Column:
    """Ids that follow a preprint prefix in free text, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(rf"arxiv(?:\.org/(?:abs|pdf)/|[:\s]+)({PREPRINT_ID})"), 1))


def urls_in(s: Column) -> Column:
    """URLs without trailing punctuation, in order of first appearance."""
    found = F.regexp_extract_all(s, F.lit(r"""(https?://[^\s<>"'{}|\\^`]+)"""), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:)\]]+$", "")))


def doi_in(s: Column) -> Column:
    return F.nullif(F.regexp_replace(F.regexp_extract(F.lower(s), r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)]+$", ""), F.lit(""))


def year_in(s: Column) -> Column:
    """The last year (1900 to 2099) in a text."""
    return F.try_element_at(F.regexp_extract_all(s, F.lit(r"\b((?:19|20)\d\d)\b"), 1), F.lit(-1)).cast("int")


def surnames(authors: Column) -> Column:
    """Distinct folded lower-case surnames of an author array: the last word before a comma, else the last word."""

    def one(a: Column) -> Column:
        words = F.split(F.trim(F.substring_index(a, ",", 1)), r"\s+")
        return F.regexp_replace(F.lower(F.element_at(words, -1)), "[^a-z]+", "")

    folded = F.split(fold(F.array_join(authors, "\x1f")), "\x1f")
    return F.filter(F.array_distinct(F.transform(folded, one)), lambda x: F.length(x) > 0)


def clean_title(s: Column) -> Column:
    """A title without addresses and DOIs before it, a date behind it, and quotes."""
    s = F.regexp_replace(s, r"^(?:\s*(?:https?://\S+|(?:doi:?\s*)?10\.\d{4,9}/\S+)[\s,.;:]*)+", "")
    month = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    s = F.regexp_replace(s, rf"[\s,.]+(?:\(?(?:{month}\.?,?\s+)?(?:\d{{1,2}},?\s+)?(?:19|20)\d{{2}}\)?)[.\s]*$", "")
    return F.trim(F.translate(s, "\"'`\u201c\u201d\u2018\u2019\u201e\u00ab\u00bb", ""))


def match_title(s: Column) -> Column:
    """The form in which titles are compared: cleaned, folded, normalised."""
    return norm_title(fold(clean_title(s)))


def local_id(first: Column, second: Column, doi: Column) -> Column:
    """Preprint id of the first field that has one, else of the DOI that names one."""
    in_doi = F.nullif(F.regexp_extract(F.lower(doi), r"10\.48550/arxiv\.(\S+)$", 1), F.lit(""))
    return F.coalesce(preprint_id(first), preprint_id(second), preprint_id(in_doi))


def search_box_id(s: Column) -> Column:
    """Preprint id typed as such at the end of a search, or within an abstract's address."""
    found = F.coalesce(F.nullif(F.regexp_extract(s, r"arxiv\.org/(?:abs|pdf)/" + PREPRINT_ID, 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(s), r"(?:^|\s|:)" + PREPRINT_ID + r"(?:v\d+)?$", 1), F.lit("")))
    return found


def unescape_html(s: Column) -> Column:
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(c))
    return s


def phrase_query(title: Column) -> Column:
    """The title as a phrase in quotes."""
    return F.concat(F.lit('"'), norm_title(unescape_html(title)), F.lit('"'))


def head_query(title: Column) -> Column:
    """The title up to its first colon."""
    return norm_title(F.substring_index(unescape_html(title), ":", 1))


def words_query(title: Column, most: int = 8) -> Column:
    """The title's first words, all of them wanted."""
    return F.array_join(F.slice(F.split(norm_title(unescape_html(title)), " "), 1, most), " AND ")


#: Abbreviations behind which a sentence goes on.
_GOES_ON = ("al", "e.g", "i.e", "fig", "figs", "eq", "eqs", "sec", "tab", "cf", "vs", "resp", "ref", "refs", "approx", "dr", "no")
SENTENCE = 350


def _ends(text: str, i: int) -> bool:
    """Whether a sentence ends with the character at i."""
    if text[i] not in ".!?" or not (text[i + 1 : i + 2].isspace() or i + 1 == len(text)):
        return False
    if text[i] != ".":
        return True
    words = text[max(0, i - 12) : i].replace("~", " ").split()
    last = words[-1].lstrip("([").lower() if words else ""
    return last not in _GOES_ON and not (len(last) == 1 and last.isalpha())


def sentence_at(text: str, at: int) -> str:
    """The sentence around an index, SENTENCE characters at most, the index among them."""
    start, end = at, at
    while start > 0 and not _ends(text, start - 1):
        start -= 1
    while end < len(text) and not _ends(text, end):
        end += 1
    found = text[start : end + 1]
    if len(found.strip()) > SENTENCE:
        cut = max(0, min(at - start - SENTENCE // 2, len(found) - SENTENCE))
        found = found[cut : cut + SENTENCE]
    return found.strip()


def flip_author(name: Column) -> Column:
    """``First Last`` to ``Last, First``; names with a comma or one word stay."""
    name = F.trim(name)
    parts = F.split(name, r"\s+")
    flipped = F.concat(F.element_at(parts, -1), F.lit(", "), F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " "))
    return F.when(name.contains(",") | (F.size(parts) < 2), name).otherwise(flipped)


def cite_key(first_author: Column, year: Column, fallback: Column) -> Column:
    family = F.regexp_replace(F.substring_index(flip_author(first_author), ",", 1), "[^A-Za-z0-9]", "")
    key = F.concat(F.lower(family), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.nullif(key, F.lit("")), fallback.cast("string"))


def year_of(raw: Column) -> Column:
    """Year of a number as text (a year, epoch seconds or epoch milliseconds by its size), else of its first four characters."""
    n = raw.try_cast("long")
    epoch = F.when(n > 10**12, F.year(F.timestamp_millis(n))).when(n > 10**9, F.year(F.timestamp_seconds(n)))
    return F.coalesce(epoch.cast("long"), n, F.substring(raw, 1, 4).try_cast("long"))


def slug(s: Column, default: str = "untitled") -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(s), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(out, F.lit("")), F.lit(default))


def percent_of(n: Column, d: Column) -> Column:
    """``n/d (x.x%)``, or ``0/0`` without a denominator."""
    return F.when(d == 0, F.lit("0/0")).otherwise(F.format_string("%d/%d (%.1f%%)", n, d, 100.0 * n / d))


def signed_percent(x: Column) -> Column:
    """Whole percent with its sign; a dash for null."""
    r = F.round(x * 100).cast("int")
    return F.when(x.isNull(), F.lit("\u2014")).otherwise(F.concat(F.when(r >= 0, "+").otherwise(""), r.cast("string"), F.lit("%")))


def from_inverted_index(index: Column) -> Column:
    """Text of a map from word to positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def short_abstract(s: Column, n: int = 3, most: int = 320) -> Column:
    """The first n sentences, or else the text's beginning; what is cut ends in an ellipsis."""
    raw = F.trim(F.replace(s, F.lit("\n"), F.lit(" ")))
    found = F.trim(F.array_join(F.slice(F.regexp_extract_all(raw, F.lit(r"([^.!?]+[.!?]+)"), 1), 1, n), " "))
    cut_ = lambda x: F.concat(F.substring(x, 1, most - 3), F.lit("…"))
    return F.when(F.length(found) > most, cut_(found)).when((found == "") & (raw != ""), cut_(raw)).otherwise(found)


def salvage_json(s: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, or null."""
    return F.nullif(F.regexp_extract(s, r"(?s)(\{.*\})", 1), F.lit(""))


def keyword_hits(s: Column, keywords: list[str]) -> Column:
    """How many of the keywords a text contains, in any case."""
    low = F.lower(F.coalesce(s, F.lit("")))
    total = F.lit(0)
    for k in keywords:
        total = total + low.contains(k.lower()).cast("int")
    return total


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Without combining marks, after Unicode decomposition."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def indel_ratio(a: str, b: str) -> float:
    return 1.0 if not a and not b else 2 * common_subsequence(a, b) / (len(a) + len(b))


def sort_ratio(a: str, b: str) -> float:
    """Similarity of the sorted tokens."""
    return round(indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), 4)


def set_ratio(a: str, b: str) -> float:
    """1 where one token set holds the other, else the best ratio of shared and differing tokens."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    one, two = (" ".join(filter(None, (both, " ".join(sorted(z))))) for z in (x - y, y - x))
    return round(max(indel_ratio(one, two), *((indel_ratio(both, one), indel_ratio(both, two)) if both else (0.0,))), 4)


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sort_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])
