"""The pipeline against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from tokenizers import Tokenizer

from tessera.llm import bpe

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if re.search(r"[^\W\d_]", r.text or "")]
    best = {}
    for r in docs:
        k = re.sub(r"[\x20\x09-\x0D]+", "", r.text)
        if k not in best or (-len(r.text), r.doc_id) < (-len(best[k].text), best[k].doc_id):
            best[k] = r
    docs = sorted(best.values(), key=lambda r: r.doc_id)
    sets = {}
    for r in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)}
    component = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and component[i] != component[j]:
                a, b = sorted((component[i], component[j]))
                component = {k: a if v == b else v for k, v in component.items()}
    docs = {r.doc_id: r for r in docs if component[r.doc_id] == r.doc_id}
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= set(docs)
    size = {i: len(WORD.findall(r.text)) for i, r in docs.items()}
    per_source = defaultdict(int)
    for i, r in docs.items():
        per_source[r.source] += size[i]
    taken = defaultdict(int)
    for i, n in copies.items():
        assert n <= 2
        taken[docs[i].source] += n * size[i]
    assert abs(sum(taken.values()) - 1.5 * sum(per_source.values())) <= sum(max(size[i] for i in docs if docs[i].source == s) for s in per_source)
    reference = Tokenizer.from_file(bpe.default_vocabulary())
    for r in got:
        ids = reference.encode(docs[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
