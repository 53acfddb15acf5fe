"""The registered queries over awkward tables: against their SQL where there is one, else against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tessera.llm import bpe, quality
from tessera.llm.oracle import oracle_sql
from tessera.llm.queries import queries
from tests.llm.test_operators import corpus, repeated_lines, shingle_set

WORD = re.compile(r"[^\x20\x09-\x0D]+")
INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def documents():
    rng = np.random.default_rng(9)
    said = {"en": "the cat and the dog of this house were there", "de": "der hund und die katze sind nicht im haus", "fr": "le chat et le chien ne sont pas dans la maison"}
    rows = [(i, t, lang) for i, t, lang, *_ in corpus() if i is not None and i != 38]
    for i in range(100, 220):
        lang = ("en", "de", "fr")[i % 3]
        words = said[lang].split()
        rows.append((i, " ".join(rng.choice(words, 60 + i % 40)) + ("\n" + "#$% buy <now> " * 6 if i % 4 == 0 else "") + ("\nsame line here\nand this too" * (i % 3)), None if i % 10 == 0 else lang))
    rows += [(300, "𝔘𝔫𝔦 漢字 тест <|endoftext|> end", "en"), (301, "12 34 !!", "de")]
    return [(i, t, lang, ("b", None, "a", "c")[i % 4]) for i, t, lang in rows]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = documents()
    column = lambda rows, k, t: pa.array([r[k] for r in rows], t)
    clash = {"at": pa.array([1] * len(docs)), "digest": pa.array(["x"] * len(docs)), "n": pa.array([0] * len(docs)), "_metadata": pa.array(["m"] * len(docs))}
    pq.write_table(pa.table({"doc_id": column(docs, 0, pa.int64()), "text": column(docs, 1, pa.string()), "lang": column(docs, 2, pa.string()), "source": column(docs, 3, pa.string()), **clash}), d / "documents.parquet")
    pages = [(1, "u", "x" * 200), (2, None, "x" * 200), (3, "a\nb", None), (4, "u", "pre " + INNER + " post " + "y" * 100), (5, "u", "pre " + INNER + " post " + "y" * 100), (6, "v", "short"), (7, "v", "short"), (8, "v", "")]
    pq.write_table(pa.table({"page_id": column(pages, 0, pa.int64()), "url": column(pages, 1, pa.string()), "html": column(pages, 2, pa.string()), "file": pa.array(["z"] * len(pages))}), d / "pages.parquet")
    talks = [(1, 0, "user", "hi <|im_end|> \\<| x"), (1, 1, "assistant", "yes\n\\\\"), (1, 1, "assistant", "again"), (2, 5, None, None), (2, 6, "assistant", None), (3, 0, "assistant", "z" * 50000), (3, 0, "assistant", "z" * 50000), (4, 2, "odd\nrole", "<|im_start|>"), (4, 1, "user", "")]
    pq.write_table(pa.table({"conv_id": column(talks, 0, pa.int64()), "turn": column(talks, 1, pa.int64()), "role": column(talks, 2, pa.string()), "text": column(talks, 3, pa.string()), "seq": pa.array([7] * len(talks))}), d / "conversations.parquet")
    labels = [(i, int("buy" not in (t or ""))) for i, t, *_ in docs if i % 7]
    pq.write_table(pa.table({"doc_id": column(labels, 0, pa.int64()), "quality": column(labels, 1, pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), d / "labels.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = duck.sql(oracle_sql()[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    df = queries()[name](spark, folder)
    assert set(columns) <= set(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_op2(spark, folder):
    own = {i: shingle_set(t) for i, t, *_ in documents()}
    component = {i: i for i in own}
    for i, a in own.items():
        for j, b in own.items():
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b) and component[i] != component[j]:
                x, y = sorted((component[i], component[j]))
                component = {k: x if v == y else v for k, v in component.items()}
    got = queries()["op2_near_dedup"](spark, folder).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(own[i]), component[i], component[i] == i) for i in own}
    assert len(got) == len(own)


def test_op4(spark, folder):
    docs = {i: (t, lang) for i, t, lang, _ in documents()}
    got = {r.doc_id: r for r in queries()["op4_language_id"](spark, folder).collect()}
    assert set(got) == set(docs)
    learnt = {lang for i, (t, lang) in docs.items() if lang and zlib.crc32(str(i).encode()) % 4 != 2}
    for i, (t, lang) in docs.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert got[i].lang_pred in learnt | {"und"} and 0 <= got[i].score <= 1
        if i >= 100 and i < 300:
            assert got[i].lang_pred == ("en", "de", "fr")[i % 3]


def test_op6(spark, folder):
    reference = Tokenizer.from_file(bpe.default_vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for i, t, *_ in documents():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op6_bpe"](spark, folder).collect()} == want


def counts(t):
    w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines), "n_digits": sum(c in "0123456789" for c in t or ""), "n_distinct_words": len(set(w))}


def test_op7(spark, folder):
    _, rules = quality.quality_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert rules
    got = {r.doc_id: r for r in queries()["op7_quality_rules"](spark, folder).collect()}
    assert len(got) == len(documents())
    for i, t, *_ in documents():
        c, r = counts(t), got[i]
        assert all(c[k] == r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), i
        failed = c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]
        per = lambda a, b, c=c: c[a] / c[b] if c[b] else 0.0
        features = {"n_words": c["n_words"], "n_lines": c["n_lines"], "word_length": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "digits_per_word": per("n_digits", "n_words")}
        features |= {"dup_line_share": per("n_dup_lines", "n_lines"), "repeat_share": per("n_repeat_words", "n_words"), "distinct_share": per("n_distinct_words", "n_words"), "words_per_line": per("n_words", "n_lines")}
        rejected = any(all(features[n] <= x if below else features[n] > x for n, below, x in rule.conditions) for rule in rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected), i


def test_op10(spark, folder):
    docs = sorted((i, t) for i, t, *_ in documents())
    repeated = defaultdict(int)
    for i, _ in repeated_lines(docs):
        repeated[i] += 1
    got = {r.doc_id: r for r in queries()["op10_line_dedup"](spark, folder).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        assert got[i].n_lines == (len(t.split("\n")) if t else 0)
        assert got[i].n_removed <= repeated[i]
        if not repeated[i]:
            assert got[i].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert sum(r.n_removed for r in got.values()) >= 0.8 * sum(repeated.values())


def test_all_are_registered():
    assert set(queries()) | {"pipeline"} <= set(entry.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries()] == list(range(1, 11))
