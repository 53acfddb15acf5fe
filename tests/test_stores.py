"""Sinks read back, and remote sources over recorded answers."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import remote, sinks


def test_checkpoints(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.write_checkpoint(df, "k", path)
    sinks.write_checkpoint(spark.createDataFrame([("b", 5)], "k string, n int"), "k", path)
    (tmp_path / "c" / "k=a" / "broken.json").write_text('{"n": 1\nnonsense\n{"n": 7}\n')
    assert sorted((r.k, r.n) for r in sinks.read_checkpoints(spark, path, "n int, k string").collect()) == [("a", 1), ("a", 7), ("b", 5)]
    sinks.write_lines(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, v array<double>")
    one, two = sinks.write_vectors(df, "id", str(tmp_path / "a")), sinks.write_vectors(df.repartition(3).orderBy(F.desc("id")), "id", str(tmp_path / "b"))
    assert one == two != sinks.write_vectors(df.filter("id <> 7"), "id", str(tmp_path / "c"))
    np.save(tmp_path / "x.npy", np.eye(3))
    np.savez(tmp_path / "y.npz", a=np.ones((2, 3)), b=np.zeros((1, 3)))
    got = sorted((r.name, r.row, list(r.vector)) for r in sinks.read_arrays(spark, str(tmp_path / "*.np[yz]")).collect())
    assert got == [("", 0, [1, 0, 0]), ("", 1, [0, 1, 0]), ("", 2, [0, 0, 1]), ("a", 0, [1, 1, 1]), ("a", 1, [1, 1, 1]), ("b", 0, [0, 0, 0])]


def test_graph(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "a", 0.5, 2), (2, "b", None, 3)], "id long, cluster string, rank double, deg int").withColumn("run_id", F.lit("r0"))
    edges = spark.createDataFrame([(1, 2, "x")], "src long, dst long, source string")
    sinks.write_graph(nodes, edges, edges.limit(0), str(tmp_path), ["rank", "deg"])
    back, cites, similar = sinks.read_graph(spark, str(tmp_path))
    assert {r.id: r.scores for r in back.collect()} == {1: {"rank": 0.5, "deg": 2.0}, 2: {"rank": None, "deg": 3.0}}
    assert cites.count() == 1 and similar.count() == 0
    frozen = sinks.freeze(back, spark.createDataFrame([(2, "z"), (9, "q")], "id long, cluster string"), "r1")
    assert sorted((r.id, r.cluster, r.run_id) for r in frozen.collect()) == [(1, "a", "r0"), (2, "z", "r1")]


def test_archives_and_audit(spark):
    tar = b"\0" * 257 + b"ustar"
    kinds = spark.createDataFrame([(0, b"%PDF-1"), (1, b"\x1f\x8b\x08"), (2, tar), (3, b""), (4, b"PK\x03\x04")], "i int, c binary").select("i", sinks.archive_kind(F.col("c")).alias("k"))
    assert {r.i: r.k for r in kinds.collect()} == {0: "pdf", 1: "gzip", 2: "tar", 3: "other", 4: "zip"}
    files = spark.createDataFrame([(1, "b.TEX", "two"), (1, "a.tex", "one"), (1, "r.bbl", "refs"), (2, "x.bib", "@a")], "paper int, name string, text string")
    assert {r.paper: (r.bbl, r.tex, r.bib) for r in sinks.gathered_sources(files).collect()} == {1: ("refs", "one\ntwo", ""), 2: ("", "", "@a")}
    report = sinks.audit(spark.createDataFrame([(1, "old"), (4, "old"), (2, None)], "id int, reason string"), "reason", "Removed").collect()
    assert {r.reason: (r.n, "from 1 to 4" in r.markdown) for r in report} == {"old": (2, True), None: (1, False)}


def test_retries():
    waits, answers = [], [remote.Busy(7), remote.Busy(), OSError(), "fine"]

    def call():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert remote.retried(call, sleep=waits.append) == "fine" and waits == [7, 2.0, 4.0]
    answers[:] = [remote.Missing()]
    assert remote.retried(call, sleep=waits.append) is None
    answers[:] = [remote.Busy()] * 2
    with pytest.raises(remote.Busy):
        remote.retried(call, times=2, sleep=waits.append)
    now, slept = [0.0], []
    ask = remote.paced(lambda x: x, 3.0, clock=lambda: now[0], sleep=slept.append)
    assert ask(1) == 1 and ask(2) == 2 and slept == [3.0]


def test_pages():
    book = {"*": ([1, 2], "c1"), "c1": ([3], "c2"), "c2": ([], None)}
    assert list(remote.by_cursor(book.__getitem__)) == [1, 2, 3]
    every = list(range(25))
    assert list(remote.by_offset(lambda at, n: every[at : at + n], 10)) == every
    assert list(remote.by_offset(lambda at, n: every[at : at + n], 10, cap=12)) == every[:12]


def test_lookups(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def fetch(ids):
        with open(calls, "a") as f:
            f.write(f"{len(ids)}\n")
        return [{"id": i, "title": f"t{i}"} for i in ids if i % 2]

    ids = spark.range(120).union(spark.range(5)).withColumnRenamed("id", "work").coalesce(1)
    got = remote.looked_up(ids, "work", fetch, "id long, title string").collect()
    assert sorted(r.id for r in got) == list(range(1, 120, 2))
    assert max(map(int, open(calls))) <= remote.LOOKUP

    def body(x):
        if x == 1:
            raise remote.Missing
        if x == 2:
            raise remote.Busy
        if x == 3:
            raise OSError
        return "" if x == 4 else f"b{x}"

    status = remote.fetched(spark.range(6), "id", body, times=1)
    assert {r.id: r.status for r in status.collect()} == {0: "ok", 1: "missing", 2: "busy", 3: "failed", 4: "empty", 5: "ok"}
    asked = remote.survey_ids(spark.createDataFrame([("10.1/a", "T"), (None, "U")], "doi string, title string")).collect()
    assert sorted((r.by, r.asked) for r in asked) == [("doi", "10.1/a"), ("title", "U")]


def test_feed_and_seed():
    feed = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1602.04938v3</id><title>A\n Title</title><summary>S</summary><published>2016-02-16T00:00:00Z</published><author><name>A B</name></author><x:doi>10.1/z</x:doi></entry></feed>'
    (one,) = remote.atom_entries(feed)
    assert one == {"id": "1602.04938v3", "title": "A Title", "abstract": "S", "year": 2016, "authors": ["A B"], "doi": "10.1/z"}
    same = lambda a, b: float(a.lower() == b.lower())
    found = [{"title": "a title", "year": 2010}, {"title": "A title", "year": 2017}]
    assert remote.seed(found, "A Title", 2016, same) is found[1]
    assert remote.seed(found, "Other", 2016, same) is None and remote.seed([], "x", None, same) is None


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE papers (id INTEGER PRIMARY KEY, title TEXT)")
        db.executemany("INSERT INTO papers VALUES (?, ?)", [(i, f"t{i}") for i in range(3, 40)])
        db.execute("CREATE TABLE none_ (id INTEGER)")
    assert sorted(r.id for r in remote.sqlite_rows(spark, path, "papers", "id long, title string", 4).collect()) == list(range(3, 40))
    assert remote.sqlite_rows(spark, path, "none_", "id long").count() == 0
