"""Each operator against a brute-force version, on a fixture with every awkward case."""

import hashlib
import os
import random
import re
import subprocess
import sys
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, exact_dedup, lang_id, lines, mixing, near_dedup, quality, substrings, warc, words, zipped
from tessera.llm.common import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, digest string, __at string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    base, passage = prose(120), prose(60)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, base.replace(" ", "\n", 7)), (5, ""), (6, None), (7, " \t\n"), (8, "one"), (9, "one"), (10, "ONE two"), (11, "one TWO")]
    for i in range(12, 30):
        own = base.split()
        for p in rng.integers(0, 120, i % 7):
            own[p] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, prose(30) + " " + passage + " " + prose(30)) for i in range(30, 36)]
    rows += [(36, prose(5000) + " éü漢字 " + "a" * 20000), (37, "the cat\nthe dog\nthe cat\n"), (38, passage), (None, base), (40, "é" * 50)]
    rows += [(38, passage), (41, "\n".join(prose(8) for _ in range(30)))]
    rows.append((42, "new line\n" + rows[-1][1]))
    return [(i, t, ("en", "de", None)[n % 3], ("b", None, "a", "c")[n % 4], "clash", "clash") for n, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def strip(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


@pytest.mark.parametrize("digest_length", [64, 1])
def test_exact_dedup(docs, rows, digest_length):
    """A key of one digit collides all the time; bytes tell the groups apart."""
    got = exact_dedup.exact_dedup(docs, digest_length).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0))
    assert len(got) == len(rows)
    want = sorted((str(i), str(min(groups[strip(t)])[2] if not min(groups[strip(t)])[1] else None), len(groups[strip(t)]), sha(strip(t))) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns(docs, rows, nothing):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({strip(t) for _, t, *_ in rows})
    assert kept.filter("__at = 'clash' and digest = 'clash'").count() == kept.count()
    assert exact_dedup.keep_first(docs.select("doc_id", "text")).count() == kept.count()
    assert exact_dedup.exact_dedup(nothing).count() == 0


CLASH = {"_metadata": "m", "__tessera_at": "a", "__tessera_copies": 3, "tessera_at": 1, "Tessera_Copies": "x", "tessera_gone": 2.5, "at": 1, "a.b": "dot", "n": 0, "size": 9}


@pytest.mark.parametrize("stored", [False, True])
def test_clashing_columns(spark, rows, stored):
    """Columns of any name stay as they are, whether the rows come from a file or not."""
    df = spark.createDataFrame([(i, t, s) for i, t, _, s, *_ in rows], "doc_id long, text string, source string")
    for name, value in CLASH.items():
        df = df.withColumn(name, F.lit(value))
    if stored:
        path = fresh_path(spark, "test-clash")
        df.write.parquet(path)
        df = spark.read.parquet(path)
    for kept in (exact_dedup.keep_first(df), near_dedup.keep_one(df), mixing.apply_mix(df), lang_id.language_filter(df.withColumn("lang", F.lit("en")))):
        assert [c for c in kept.columns if c != "lang"] == df.columns
        assert {tuple(r[c] for c in CLASH) for r in kept.collect()} == {tuple(CLASH.values())}
    assert exact_dedup.keep_first(df).count() == len({strip(t) for _, t, *_ in rows})
    assert exact_dedup.exact_dedup(df).count() == mixing.mix_sources(df).count() == near_dedup.near_dedup(df).count() == len(rows)


def test_state_survives(spark, monkeypatch, rows):
    """Several micro-batches, and a stream that starts again over its checkpoint: new rows hit the state kept."""
    monkeypatch.setattr(exact_dedup, "BYTES_PER_TRIGGER", "1")
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    at = F.struct(F.lit("f").alias("file"), F.col("row").alias("row"))
    log = exact_dedup.digest_log(spark.createDataFrame([(i, t, n) for n, (i, t, *_) in enumerate(rows)], "doc_id long, text string, row long").withColumn("at", at))
    path, check, out = (fresh_path(spark, f"test-{x}") for x in ("log", "check", "out"))
    for part in (log.filter("at.row % 3 = 0"), log.filter("at.row % 3 = 1"), log.filter("at.row % 3 = 2")):
        part.repartition(2).write.mode("append").parquet(path)
        exact_dedup.stream_state(spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path), check, out)
    changes = spark.read.option("recursiveFileLookup", "true").parquet(out).groupBy("key").agg(F.max(F.struct("size", "best")).alias("x"))
    got = {r.key: (None if r.x.best.no_id else r.x.best.id, r.x["size"]) for r in changes.collect()}
    assert got == whole


def test_without_shared_folder(tmp_path):
    """A local session without spark.checkpoint.dir gets a folder; a cluster without it is an error."""
    code = """
from tessera.session import get_session, shared_folder
from tessera.llm.common import staged
spark = get_session("bare", "2")
context = spark.sparkContext
assert spark.conf.get("spark.checkpoint.dir", None) is None and not context._jsc.sc().getCheckpointDir().isDefined()
class Cluster:
    conf = spark.conf
    class sparkContext:
        master, _jsc = "spark://far:7077", context._jsc
try:
    shared_folder(Cluster)
except RuntimeError as e:
    assert "spark.checkpoint.dir" in str(e)
else:
    raise AssertionError
assert staged(spark.range(3), "x").count() == 3 and shared_folder(spark) == shared_folder(spark)
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"SPARK_CONF_DIR": str(tmp_path)}
    env["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), env.get("PYTHONPATH", "")])
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=300)


def test_encoder_memory():
    """16 MB of tokens that occur once take less than 400 MB."""
    code = """
import random, resource
import pyarrow as pa
from tessera.llm import bpe
r = random.Random(1)
text = " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range((16 << 20) // 6))
own = bpe.encoder(bpe.default_vocabulary())
n = sum(len(u) for _, u in bpe._steps(pa.array([text]), own))
assert n == text.count(" ") + 1, n
peak = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
assert peak < 400, peak
"""
    env = os.environ | {"PYTHONPATH": os.pathsep.join([os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), *sys.path])}
    subprocess.run([sys.executable, "-c", code], env=env, check=True, timeout=300)


def shingle_set(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs, rows, nothing):
    own = [(i, shingle_set(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in own}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in own:
        for j, b in own:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == find(r.doc_id), r
            assert r.n_shingles == len(dict(own)[r.doc_id])
            assert r.kept == (r.doc_id == r.component_id)
    assert near_dedup.keep_one(docs).columns == docs.columns
    assert near_dedup.near_dedup(nothing).count() == 0


def test_minhash_estimate(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for shared in (950, 889, 600):
        b = np.concatenate((a[:shared], rng.integers(0, 2**63, 1000 - shared).astype(np.uint64)))
        _, packed = near_dedup.sketch(near_dedup.minima(np.concatenate((a, b)), np.array([0, 1000])))
        x, y = packed.tolist()
        got = spark.createDataFrame([(x, y)], "x array<long>, y array<long>").select(near_dedup.estimate(F.col("x"), F.col("y")).alias("e")).head()["e"]
        assert abs(got - shared / (2000 - shared)) < 0.1


def test_recall_of_bands_and_estimate():
    """Pairs at the threshold itself, over sets of several sizes: how many share a bucket and pass the estimate."""
    rng = np.random.default_rng(9)
    found = pairs = 0
    for size in (9, 18, 90, 900):
        for _ in range(250):
            both = rng.integers(0, 2**63, size + size // 9).astype(np.uint64)  # 8/9 of each are shared: similarity 0.8
            a, b = both[:size], both[size // 9 :]
            keys, packed = near_dedup.sketch(near_dedup.minima(np.concatenate((a, b)), np.array([0, size])))
            low = (packed[0] ^ packed[1]).view(np.uint64)
            equal = sum(near_dedup.MINIMA // packed.shape[1] - len({i // near_dedup.BITS for i in range(64) if int(x) >> i & 1}) for x in low)
            chance = 2.0**-near_dedup.BITS
            likely = (equal / near_dedup.MINIMA - chance) / (1 - chance) >= near_dedup.least_estimate()
            found += likely and (keys[0] == keys[1]).any()
            pairs += 1
    assert found == pairs == 1000


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(i, i + 2) for i in range(100, 130)] + [(7, 7)]
    got = {r.doc_id: r.component for r in near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 100 + i % 2 for i in range(100, 132))
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
PAGES = [(1, "u", "x" * 200), (2, "u", "x" * 200), (3, None, None), (4, "a\nb", "pre " + INNER + " post"), (5, "v", INNER), (6, "v", "WARC/1.0\r\n"), (7, "z", "é" * 60), (8, "z", "é" * 60), (9, "z", "short"), (10, "z", "short"), (11, "q", INNER * 2 + "\r\n\r\n")]


@pytest.mark.parametrize(("codec", "split", "segment"), [("gzip", "128m", 26), ("uncompressed", "200b", 7), ("uncompressed", "97b", 9)])
def test_warc_round_trip(spark, monkeypatch, codec, split, segment):
    monkeypatch.setattr(warc, "SEGMENT", segment)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        path = fresh_path(spark, "test-archives")
        warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), path, codec)
        records = warc.read_archives(spark, path, with_payload=True)
        got = sorted(tuple(r) for r in warc.page_records(records).collect())
        payloads = {r.fields["warc-record-id"]: bytes(r.payload) for r in records.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    want = []
    for i, _, h in PAGES:
        b = (h or "").encode()
        first = min(j for j, _, g in PAGES if (g or "").encode() == b)
        again = len(b) >= 100 and first != i
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
        if not again:
            assert payloads[f"<urn:page:{i}>"] == b
    assert got == want


def test_warc_repeated_page_ids(spark):
    """A revisit is told by page_id and digest; extra columns don't matter."""
    a, b = "a" * 200, "b" * 300
    pages = [(1, None, a, "x", 1, 2), (1, None, b, "x", 1, 2), (2, None, a, "x", 1, 2), (3, None, b, None, 1, 2), (3, None, b, "x", 1, 2), (None, "u", a, "x", 1, 2)]
    path = fresh_path(spark, "test-archives")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string, digest string, n int, first int"), path)
    got = sorted(map(str, (tuple(r) for r in warc.page_records(warc.read_archives(spark, path)).collect())))
    one = lambda i, text, kind, to: str((i, len(text), sha(text), kind, to))
    assert got == sorted([one(1, a, "response", None), one(1, b, "response", None), one(2, a, "revisit", 1), one(3, b, "revisit", 1), one(3, b, "revisit", 1), one(None, a, "response", None)])


def test_warc_empty(spark):
    path = fresh_path(spark, "test-archives")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.page_records(warc.read_archives(spark, path)).count() == 0


def test_language_id(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_id.fit(docs.filter(~lang_id.held_out()))
    found = lang_id.predict(docs.filter(lang_id.held_out()), model).select("row.lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "the and of thing ")], "doc_id long, text string")
    got = {r.row.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert lang_id.fit(nothing) is None
    assert [r.lang_pred for r in lang_id.predict(odd, None).collect()] == ["und"] * 4
    assert lang_id.language_filter(nothing).columns == nothing.columns


def _packed_model(texts_by_lang):
    """A model of whole texts, through the counting and packing that fit uses."""
    blobs = {}
    for lang, texts in texts_by_lang.items():
        counts = defaultdict(int)
        for x in lang_id.count_ngrams([pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts)], ["lang", "text"])]):
            for code, n in zip(x.column("code").to_pylist(), x.column("n").to_pylist(), strict=True):
                counts[code] += n
        codes = sorted(counts)
        half = len(codes) // 2
        for part in (codes[:half], codes[half:]):
            batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.int64()), pa.array([counts[c] for c in part], pa.int64())], ["lang", "code", "n"])
            for x in lang_id._pack([batch]):
                blobs.setdefault(lang, []).extend(x.column("blob").to_pylist())
    return lang_id.Model(blobs)


def test_code_lengths_are_exact(monkeypatch):
    """The tables give what a walk down each language's context tree gives, over several scripts."""
    monkeypatch.setattr(lang_id, "GROUP", 2)
    order = lang_id.ORDER
    said = {
        "a": ["abracadabra", "banana band"],
        "b": ["тук тук, кто там", "там кто"],
        "c": ["漢字かな交じり文", "字字字"],
        "d": ["".join(map(chr, range(1, 256))), "\U0001f600\U0010ffff"],
        "e": ["xyz"],
    }
    model = _packed_model(said)
    trees = {}
    for lang, texts in said.items():
        seen = defaultdict(lambda: defaultdict(int))
        for t in texts:
            padded = [256] * order + [*t.encode()]
            for i in range(order, len(padded)):
                for k in range(order + 1):
                    seen[tuple(padded[i - k : i])][padded[i]] += 1
        trees[lang] = seen

    def bits(seen, context, symbol):
        if context in seen:
            n, d = sum(seen[context].values()), len(seen[context])
            if symbol in seen[context]:
                return np.log2((n + d) / seen[context][symbol])
            return np.log2((n + d) / d) + (bits(seen, context[1:], symbol) if context else 8.0)
        return bits(seen, context[1:], symbol)

    odd = ["bandana", "abc", "", "кто字banana", "\x01\x02é\U0001f601 тут", "".join(map(chr, range(255, 0, -1)))]
    got = model.code_lengths(pa.array(odd))
    for i, t in enumerate(odd):
        padded = [256] * order + [*t.encode()]
        for k, lang in enumerate(sorted(said)):
            want = sum(bits(trees[lang], tuple(padded[j - order : j]), padded[j]) for j in range(order, len(padded)))
            assert abs(got[i, k] - want) < 1e-3, (t, lang)


def test_held_out(spark, docs):
    for r in docs.select("doc_id", lang_id.held_out().alias("h")).collect():
        assert r.h == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2)


def test_language_id_awkward(spark):
    """Clashing columns, repeated rows, nulls; and scoring in several broadcasts gives the same."""
    rows = [(i, t, lang, "x", "y", 1.5) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), (None, "en"), ("und der", None), ("", "de")] * 3)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string, lang string, lang_pred string, row string, score double")
    model = lang_id.fit(docs)
    assert model.languages == ["de", "en", "fr"]
    whole = sorted((r.row.doc_id, r.lang_pred, round(r.score, 9)) for r in lang_id.predict(docs, model).collect())
    assert len(whole) == len(rows) + 2 and {p for i, p, _ in whole if i % 6 in (3, 5)} == {"und"} and {p for i, p, _ in whole if i % 6 == 4} == {"de"}
    before, lang_id.BROADCAST_BYTES = lang_id.BROADCAST_BYTES, 1
    try:
        assert sorted((r.row.doc_id, r.lang_pred, round(r.score, 9)) for r in lang_id.predict(docs, model).collect()) == whole
    finally:
        lang_id.BROADCAST_BYTES = before
    assert lang_id.language_filter(docs).columns == docs.columns


def test_substring_dedup(docs, rows, nothing):
    first, want = {}, {}
    for i, t in sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda x: x[0]):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        want[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    got = substrings.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert substrings.substring_dedup(nothing).count() == 0


def test_unitigs_compact(spark):
    """A passage of many edges is one unitig with one row per occurrence; a branch ends it."""
    rng = np.random.default_rng(5)
    own = iter(rng.permutation(10000))
    fresh = lambda n: [f"u{next(own)}" for _ in range(n)]
    passage = fresh(60)
    bucket = {r.id: r.b for r in spark.range(1, 200).select("id", F.expr("pmod(hash(id), 4)").alias("b")).collect()}
    ids = sorted(min(i for i in bucket if bucket[i] == b) for b in range(4))  # a task each
    texts = [fresh(20) + passage + fresh(20), fresh(5) + passage + fresh(9), fresh(7) + passage[:30] + fresh(30), fresh(70)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    stored = zipped.stored(docs, "test-texts")
    anchors = substrings.repeated_anchors(stored, 3)
    got = {tuple(r) for r in substrings.unitig_occurrences(stored, anchors, 3).collect()}
    a, b, c, _ = ids
    # edges 0 to 17 are whole in the first 30 words; those from 18 on are only in the longer passage
    assert got == {(a, 20, 37, a, 20), (b, 5, 22, a, 20), (c, 7, 24, a, 20), (a, 38, 67, a, 38), (b, 23, 52, a, 38)}
    # a unitig whose words aren't its representative's is not removed
    paths = spark.createDataFrame([(a, 20, 37, a, 20), (b, 5, 22, a, 20), (c, 8, 25, a, 20)], "doc_id long, first int, last int, rep_doc long, rep_first int")
    assert [tuple(r) for r in substrings.verified(stored, paths).collect()] == [(b, 5, 22)]


def test_substrings_settled_in_a_task(spark, monkeypatch):
    """Occurrences within one task, over several tasks, and in chunks cut short give the same."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{k}x{i}" for i in rng.integers(0, 30, 40)) for k in range(4)]
    rows = [(i, " ".join([f"a{i}", passages[i % 4], f"b{i}", passages[(i // 4) % 4], passages[0] if i % 5 == 0 else "z"])) for i in range(1, 60)]
    rows += [(70, " ".join(["same line again"] * 40)), (71, " ".join(["same line again"] * 20)), (72, None)]
    want, first = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first.setdefault(tuple(w[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        want[i] = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for held, part in ((32 << 20, 2048), (1, 2048), (1, 2)):
        monkeypatch.setattr(substrings, "HELD_BYTES", held)
        monkeypatch.setattr(substrings, "PART", part)  # occurrences of a passage in several parts
        assert {r.doc_id: r.kept_text for r in substrings.substring_dedup(docs).collect()} == want


def test_bpe(spark, docs, rows, nothing):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    odd = ["<|endoftext|>a <|endoftext|>", "it's we'll   x\n\n  y ", "\x1c\x85  a", "aaaaaaaaaaaaaaaa" * 9, " lead", "tail ", "a  b", "👩‍👩‍👧 é"]
    texts = [t for _, t, *_ in rows] + odd
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [x.ids for x in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoded = bpe.encode(df)
    assert {r.doc_id: r.ids for r in encoded.collect()} == dict(enumerate(want))
    decoded = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert decoded == {i: reference.decode(x, skip_special_tokens=False) for i, x in enumerate(want)}
    for r in bpe.round_trip(df).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(want[r.doc_id]), sha(",".join(map(str, want[r.doc_id]))), sha(decoded[r.doc_id]))
    assert bpe.round_trip(nothing).count() == 0


def test_bpe_pretokens(monkeypatch):
    """Short mixtures of kinds of characters get the library's ids, at once, cut into pieces, and in small steps and chunks."""
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(bpe.default_vocabulary())
    r = random.Random(3)
    alphabet = [*" \n\t\r\x1c\x85\u00a0\u3000'''''stmdrevlLS1²٣é中#.\u0301\u200d👩", "  ", " '", "'s", "'re", "'ll", "<|endoftext|>"]
    texts = ["", None, *["".join(r.choices(alphabet, k=r.randint(0, 16))) for _ in range(6_000)], "".join(r.choices(alphabet, k=40_000))]
    want = [x.ids for x in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    own = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary()))
    decimal = lambda ids: "".join(f",{i}" for i in ids).encode()
    for step, piece, chunk, cache in ((bpe.STEP, bpe.PIECE, bpe.CHUNK, bpe.CACHE), (500, 100, 7, 20_000), (1, 1, 1, 1)):
        for name, value in (("STEP", step), ("CHUNK", chunk), ("CACHE", cache)):
            monkeypatch.setattr(bpe, name, value)
        monkeypatch.setattr(own.vocabulary, "pieces", lambda text, piece=piece: bpe.Vocabulary.pieces(own.vocabulary, text, piece))
        got, decoded = [b""] * len(texts), [b""] * len(texts)
        for x in bpe._coded(pa.array(texts), own):
            ids, cuts = x.joined(own.vocabulary.decimal)
            own_bytes, ends = x.joined(own.vocabulary.own_bytes)
            for k, row in enumerate(x.rows):
                got[row] += ids[cuts[k] : cuts[k + 1]]
                decoded[row] += own_bytes[ends[k] : ends[k + 1]]
        assert got == [decimal(x) for x in want]
        assert decoded == [(t or "").encode() for t in texts]


def test_bpe_work():
    """Pretokens are learnt once, not once for each way in which they stand beside each other."""
    r = random.Random(1)
    words = ["".join(r.choices("abcdefgh", k=8)) for _ in range(300)]
    text = " ".join(f"{r.choice(words)}.\n{r.choice(words)}" for _ in range(50_000))
    own = bpe.Encoder(bpe.Vocabulary(bpe.default_vocabulary()))
    assert [row for row, _ in bpe._steps(pa.array([text]), own)] == [0] * len(list(own.vocabulary.pieces(text)))
    assert len(own.known) <= 2 * len(words) + 2 + len(own.vocabulary.special)


def test_quality_statistics(docs, rows):
    got = {r.doc_id: r for r in quality.statistics(docs).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[p : p + 3]) for p in range(len(w) - 2)]
        covered = {p + k for p, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)} if len(w) < 1000 else None
        own = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(own) - len(set(own)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t or ""))
        if covered is not None:
            assert r.n_repeat_words == len(covered)
        assert r.n_distinct_words == len(set(w))


def test_quality_rules_learn(spark, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    kept, rules = quality.quality_rules(docs, labels)
    assert rules
    counts = {tuple(r)[:3]: r["n"] for r in kept.join(labels, "doc_id").groupBy("quality", "base_failed", "kept").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean = sum(n for (q, b, _), n in counts.items() if q == 1 and not b)
    assert counts.get((1, False, True), 0) >= 0.97 * clean
    assert counts.get((0, False, True), 0) <= 0.1 * sum(n for (q, *_), n in counts.items() if q == 0)
    none, rules = quality.quality_rules(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert not rules and none.filter("not base_failed and not kept").isEmpty()


def test_mixing(spark, docs, rows, nothing):
    got = mixing.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # share, cap, and share what is left again
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - target[s]) <= largest for s in sizes)
    again = mixing.mix_sources(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.word_count())).head()[0] == sum(taken.values())
    assert mixing.mix_sources(nothing).count() == 0


def test_chat_events(spark):
    log = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", None), (1, 3, "delta", 2, None, "first "), (1, 4, "delta", 2, None, "try"),
        (1, 5, "regenerate", 2, None, None), (1, 6, "delta", 2, None, "a <|im_end|>"), (1, 7, "delta", 2, None, "\\<|b"), (1, 8, "edit", 1, None, "hello"),
        (2, 1, "message", 1, "we\nird<|", ""), (2, 2, "message", 2, "assistant", "<\\|x"), (None, 1, "message", 1, None, "null"),
    ]
    talks = chat.render(chat.fold_events(spark.createDataFrame(log, "conv_id long, seq long, kind string, turn long, role string, text string").repartition(3)))
    back = talks.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in back}
    assert got == {1: ([("user", "hello"), ("assistant", "a <|im_end|>\\<|b")], "a <|im_end|>\\<|b"), 2: ([("we\nird<|", ""), ("assistant", "<\\|x")], "<\\|x"), None: ([("", "null")], "")}
    assert all(r.formatted.count("<|im_end|>") == len(r.turns) for r in back)


def repeated_lines(texts):
    """(doc_id, line) of all lines in a run of two or more that repeats an earlier one: texts are (doc_id, text) by doc_id."""
    seen, gone = {}, set()
    for i, t in texts:
        own = t.split("\n") if t else []
        for at in range(len(own) - 1):
            pair = tuple(own[at : at + 2])
            if WORD.search("".join(pair)):
                doc, first = seen.setdefault(pair, (i, at))
                if (doc, first) != (i, at):
                    gone |= {(i, k) for k in (at, at + 1) if doc != i or k not in (first, first + 1)}
    return gone


def check_lines(df, texts, recall):
    """Nothing goes that isn't repeated; most of what is does; what is left is in order."""
    gone = {(r.doc_id, k) for r in lines.repeated_chunks(df).collect() for k in range(r.line, r.line + r.lines)}
    want = repeated_lines(texts)
    assert gone <= want
    assert len(gone) >= recall * len(want)
    own = {i: t.split("\n") if t else [] for i, t in texts}
    for r in lines.line_dedup(df).collect():
        if r.doc_id is not None:
            kept = [x for k, x in enumerate(own[r.doc_id]) if (r.doc_id, k) not in gone]
            assert (r.n_lines, r.n_removed, r.kept_text) == (len(own[r.doc_id]), len(own[r.doc_id]) - len(kept), "\n".join(kept))
    left = {x for i, t in own.items() for k, x in enumerate(t) if (i, k) not in gone}
    assert left == {x for t in own.values() for x in t}


def test_line_dedup(docs, rows, nothing):
    texts = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda x: x[0])
    check_lines(docs, texts, 0.9)
    assert lines.line_dedup(nothing).count() == 0


def test_line_dedup_recall(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    check_lines(docs, sorted((r.doc_id, r.text) for r in docs.collect()), 0.9)


def test_repeated_runs_of_lines(spark):
    """Short runs among lines of their own, lines said many times, blank lines."""
    rng = np.random.default_rng(11)
    unique = iter(range(10**6))
    own = lambda n: [f"own line {next(unique)}" for _ in range(n)]
    shared = [[f"shared {k} line {j}" for j in range(2 + k % 5)] for k in range(30)]
    texts = [own(3) + shared[k] + own(2) for k in range(30)]
    texts += [own(int(rng.integers(0, 4))) + shared[int(rng.integers(30))] + own(int(rng.integers(0, 4))) + [shared[k % 30][0]] + own(1) for k in range(60)]
    texts += [["said"] * 3, ["said"] * 5, ["said"] * 5000, ["a", "b", "a", "b", "a"], [" ", "\t"], [" ", "\t"], ["é"], ["é"], own(2) + [""], [""]]
    texts = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    check_lines(df, texts, 0.8)
    # a line put in front moves no boundary behind it
    ((_, _, block),) = words.blocks(pa.array(["\n".join(own(40))]))
    ((_, _, moved),) = words.blocks(pa.array([b"new line\n" + block.text(0)]))
    a, b = (set(lines.chunk_spans(x)["hash"].tolist()) for x in (block, moved))
    assert len(a - b) <= 2


def test_more_languages_than_tables(spark):
    """Every labelled language is learnt and can be predicted, however many there are."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    said = {f"l{k:03d}": f"{letters[k % 26]}{letters[k // 26]}" * 40 for k in range(100)}
    rows = [(2 * k + j, text, lang) for k, (lang, text) in enumerate(said.items()) for j in range(2 if k < 70 else 1)]
    model = lang_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(said)
    odd = spark.createDataFrame([(lang, text[:30]) for lang, text in said.items()], "lang string, text string")
    assert all(r.row.lang == r.lang_pred for r in lang_id.predict(odd, model).collect())
