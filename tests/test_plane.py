"""Neighbours in a plane, positions in ranges and silhouettes against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import plane, state, terms, vectors


def brute(points, k, grouped):
    out = {}
    for i, x, y, g in points:
        near = sorted((round((x - x2) ** 2 + (y - y2) ** 2, 9), j) for j, x2, y2, g2 in points if j != i and (g == g2 or not grouped))
        out[i] = [j for _, j in near[:k]]
    return out


@pytest.mark.parametrize("grouped", [False, True])
def test_plane_knn(spark, grouped):
    rng = np.random.default_rng(3)
    points = [(i, *map(float, rng.normal(0, 1, 2)), i % 3) for i in range(150)]
    points += [(200 + i, 40.0 + i % 2, 40.0, 0) for i in range(30)]  # far off, many on two spots
    points += [(300, -90.0, 5.0, 7), (301, -90.0, 5.0, 7)]  # a group of two
    df = spark.createDataFrame(points, "id long, x double, y double, g int")
    got = {}
    for r in plane.knn(df, 4, by="g" if grouped else None).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append(r.dst)
    want = brute(points, 4, grouped)
    assert got == {i: js for i, js in want.items() if js}


def test_plane_knn_of_few(spark):
    schema = "id long, x double, y double"
    assert plane.knn(spark.createDataFrame([], schema), 3).count() == 0
    assert plane.knn(spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], schema), 3).count() == 0
    assert [(r.src, r.dst) for r in plane.knn(spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], schema), 3).orderBy("src").collect()] == [(1, 2), (2, 1)]


def test_pushed(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 0.0, 0.0)], "id long, x double, y double")
    near = spark.createDataFrame([(1, 2), (1, 3)], "src long, dst long")
    got = {r.dst: (round(r.x, 9), round(r.y, 9)) for r in plane.pushed(near, points, 5.0).collect()}
    assert got == {2: (6.0, 8.0), 3: (0.0, 0.0)}


def test_sums_ahead(spark):
    rows = [(i % 2, i, i % 5) for i in range(101)]
    df = spark.createDataFrame(rows, "g int, i long, n long").repartition(7)
    for r in state.before(df, [F.desc("i")], by=["g"], weight=F.col("n")).collect():
        assert r.before == sum(n for g, i, n in rows if g == r.g and i > r.i)
    assert sorted(r.before for r in state.before(df, ["i"]).collect()) == list(range(101))


def test_digest_of_texts(spark):
    import hashlib

    rows = [("a", 2, "é"), ("a", 1, "x"), ("b", 1, None), (None, 5, "z"), ("a", 3, None)]
    got = {r.g: r.h for r in terms.digest_of_texts(spark.createDataFrame(rows, "g string, i long, t string"), "g", "i", "t", "h").collect()}
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert got == {"a": md5("xé"), "b": md5(""), None: md5("z")}


def test_cosine_silhouette(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (40, 6))
    labels = [0] * 19 + [1] * 20 + [2]  # a label of one member scores 0
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = 1 - u @ u.T
    got = {r.id: r.silhouette for r in vectors.cosine_silhouette(spark.createDataFrame([(i, labels[i], v[i].tolist()) for i in range(40)], "id long, label int, v array<double>"), "v").collect()}
    for i in range(40):
        mean = {c: np.mean([d[i, j] for j in range(40) if labels[j] == c and j != i] or [np.nan]) for c in set(labels)}
        a, b = mean[labels[i]], min(x for c, x in mean.items() if c != labels[i])
        assert abs(got[i] - (0 if np.isnan(a) else (b - a) / max(a, b))) < 1e-9


@pytest.mark.parametrize("group_bytes, wide", [(4096, 16), (1 << 20, 4096)])
def test_cosine_knn(spark, monkeypatch, group_bytes, wide):
    """One or several groups and tiles, ties among equal vectors, a zero vector and a row without one."""
    monkeypatch.setattr(vectors, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(vectors, "WIDE", wide)
    rng = np.random.default_rng(6)
    v = [*rng.normal(0, 1, (120, 8)), *[np.ones(8)] * 9, np.zeros(8)]
    df = spark.createDataFrame([(3 * i - 50, x.tolist()) for i, x in enumerate(v)] + [(9999, None)], "id long, v array<double>")
    got = {}
    for r in vectors.knn(df, "id", "v", 5).orderBy("src", "rank").collect():
        got.setdefault(r.src, []).append((r.dst, round(r.cosine, 6)))
    u = np.array([x / (np.linalg.norm(x) or 1) for x in v])
    near = np.round(u @ u.T, 6)
    want = {3 * i - 50: [(3 * j - 50, near[i, j]) for j in sorted((j for j in range(130) if j != i), key=lambda j: (-near[i, j], j))[:5]] for i in range(130)}
    assert got == want
    assert vectors.knn(df.limit(0), "id", "v", 5).count() == 0


def test_quotes(spark):
    texts = ["The quick  brown fox jumps over the lazy dog again", "quick brown\nfox", "overjumping foxes", "", None, "a b c d e f g h i"]
    quotes = ["quick brown fox", "ick brown fo", "fox", "x jumps over t", "ox jumps over the lazy dog ag", "b c d e f g", "A B", "nowhere to be found", "jumps over the lazy dog again and more", "the quick brown fox jumps over the lazy dog again"]
    squeeze = lambda s: " ".join((s or "").lower().split())
    got = {(r.item_id, r.doc_id) for r in terms.quoted(spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string"), spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {(i, d) for i, q in enumerate(quotes) for d, t in enumerate(texts) if squeeze(q) in squeeze(t)}
