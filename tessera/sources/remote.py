"""Records of remote providers: cursors, offsets, batched lookups, polite retries.

The provider's call is a parameter, ``fetch``, so nothing here knows an address; tests pass
recorded answers. Calls run in Python workers, a batch of ids each; the number of partitions
bounds how many run at once.
"""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Ids of a lookup, ids of a forward-citation call.
LOOKUP, CITING = 50, 40
#: Namespaces of an Atom feed of preprints.
ATOM, PREPRINT = "{http://www.w3.org/2005/Atom}", "{http://arxiv.org/schemas/atom}"


class Missing(Exception):
    """The provider has no such record."""


class Busy(Exception):
    """The provider asks to come back later, after ``wait`` seconds if it says so."""

    def __init__(self, wait: float | None = None):
        super().__init__(wait)
        self.wait = wait


def retried(call: Callable, *args, times: int = 5, first: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """What ``call`` returns; None if the record is missing. A busy provider is asked again, each
    time after twice the wait or the one it names; the last failure is raised."""
    wait = first
    for n in range(times):
        try:
            return call(*args)
        except Missing:
            return None
        except (Busy, OSError) as e:
            if n + 1 == times:
                raise
            sleep(getattr(e, "wait", None) or wait)
            wait *= 2


def paced(call: Callable, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, at least so many seconds after its last one."""
    last: list[float] = []

    def run(*args):
        if last and (left := last[0] + seconds - clock()) > 0:
            sleep(left)
        last[:] = [clock()]
        return call(*args)

    return run


def by_cursor(fetch: Callable[[str], tuple[list, str | None]], start: str = "*", **retry) -> Iterator:
    """All records of a paged answer; ``fetch(cursor)`` gives records and the next cursor, None at the end."""
    cursor: str | None = start
    while cursor is not None:
        records, cursor = retried(fetch, cursor, **retry) or ([], None)
        yield from records
        if not records:
            return


def by_offset(fetch: Callable[[int, int], list], size: int = 100, cap: int | None = None, **retry) -> Iterator:
    """All records of an answer paged by offset, ``cap`` at most."""
    at = 0
    while cap is None or at < cap:
        records = retried(fetch, at, size, **retry) or []
        yield from records if cap is None else records[: cap - at]
        if len(records) < size:
            return
        at += size


def looked_up(ids: DataFrame, column: str, fetch: Callable[[list], list[dict]], schema: str, size: int = LOOKUP, **retry) -> DataFrame:
    """Rows of the records that ``fetch`` gives for the distinct ids, ``size`` ids a call."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), size):
                found = retried(fetch, f[column].iloc[a : a + size].tolist(), **retry) or []
                yield pd.DataFrame([[r.get(c) for c in names] for r in found], columns=names, dtype=object)

    ship(ids.sparkSession)
    return ids.select(column).filter(F.col(column).isNotNull()).distinct().mapInPandas(run, schema)


def fetched(ids: DataFrame, column: str, fetch: Callable, **retry) -> DataFrame:
    """id, status (ok, missing, empty, busy, failed) and body of each document."""

    def one(x) -> tuple[str, str | None]:
        try:
            body = retried(fetch, x, **retry)
        except Busy:
            return "busy", None
        except OSError:
            return "failed", None
        return ("missing", None) if body is None else ("ok", body) if body else ("empty", None)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(x, *one(x)) for x in f[column]], columns=[column, "status", "body"], dtype=object)

    ship(ids.sparkSession)
    kind = ids.schema[column].dataType.simpleString()
    return ids.select(column).distinct().mapInPandas(run, f"{column} {kind}, status string, body string")


def atom_entries(feed: str) -> list[dict]:
    """id, title, abstract, year, authors and DOI of an Atom feed's entries."""
    own = lambda e, tag: " ".join((e.findtext(tag) or "").split()) or None
    out = []
    for e in ET.fromstring(feed).iter(ATOM + "entry"):
        published = own(e, ATOM + "published") or ""
        out.append({"id": (own(e, ATOM + "id") or "").rsplit("/abs/", 1)[-1], "title": own(e, ATOM + "title"), "abstract": own(e, ATOM + "summary"), "year": int(published[:4]) if published[:4].isdigit() else None, "authors": [own(a, ATOM + "name") for a in e.iter(ATOM + "author")], "doi": own(e, PREPRINT + "doi")})
    return out


def seed(candidates: list[dict], title: str, year: int | None, similar: Callable[[str, str], float], least: float = 0.9, years: int = 1) -> dict | None:
    """The candidate whose title and year fit a seed's, the most similar first; None if none does."""
    fit = [(similar(c["title"] or "", title), c) for c in candidates if year is None or c.get("year") is None or abs(c["year"] - year) <= years]
    best = max(fit, key=lambda x: x[0], default=(0.0, None))
    return best[1] if best[0] >= least else None


def survey_ids(references: DataFrame) -> DataFrame:
    """What each reference (doi, title) is looked up by: its DOI, else its title."""
    return references.select("*", F.when(F.col("doi").isNotNull(), "doi").otherwise("title").alias("by"), F.coalesce("doi", "title").alias("asked"))


def sqlite_rows(spark: SparkSession, path: str, name: str, schema: str, parts: int = 8) -> DataFrame:
    """A SQLite table by ranges of rowid; the file must be readable where tasks run."""
    import sqlite3

    names = [c.split()[0] for c in schema.split(", ")]
    quoted = '"' + name.replace('"', '""') + '"'

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
            for part in (p for f in frames for p in f["id"]):
                if low is not None:
                    step = (high - low) // parts + 1
                    rows = db.execute(f"SELECT {', '.join(names)} FROM {quoted} WHERE rowid >= ? AND rowid < ?", (low + part * step, low + (part + 1) * step)).fetchall()
                    yield pd.DataFrame(rows, columns=names, dtype=object)

    ship(spark)
    return spark.range(0, parts, 1, parts).mapInPandas(run, schema)
