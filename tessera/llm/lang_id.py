"""Language ID by prediction by partial matching (PPM, escape method C, frozen statistics).

Each language has a tree of byte contexts of orders 0 to ORDER. A byte seen in a context
costs -log2(n / (N + d)) bits there, with N bytes and d distinct ones seen in that context;
an unseen one costs the escape -log2(d / (N + d)) plus its cost in the next shorter
context, and below order 0 it is one of 256. A context never seen costs nothing to leave.
The statistics are frozen while scoring, so the cost of a byte is a function of itself and
the ORDER bytes before it, and the exact code length of a whole text is a sum. All byte values
are told apart. A text starts behind ORDER boundary symbols.

The trees are grown from a bounded sample: at most about ``sample_docs`` labelled documents
of each language (every one that has a label), chosen by a hash of doc_id, whole texts. Byte
n-grams are counted on the executors and summed by Spark; a language's sums, of the sample
only, reach the driver as one packed row. Every document is scored, over its whole text, in
one pass without a shuffle.

A worker holds the trees of up to GROUP languages at a time as one table: of each n-gram that
one of them has seen, its cost under all of them; of each context, the costs to leave it. A
text is looked up in the longest table first and falls to the next where no language of the
group has seen the n-gram, so the sums are those of a walk through each tree. The packed
model is broadcast in parts of BROADCAST_BYTES at most, and texts are scored part after part
where there are several. Every labelled language is learnt and scored, however many.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every
text when there is nothing to learn from; an empty table gives an empty result; rows that
repeat are predicted alike. Of equal code lengths the language first in code point order wins.
The score is the posterior of the language under equal priors. Further columns of the input
stay in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed, words
from tessera.llm.common import bound_batches, staged

SAMPLE_DOCS = 1500
#: The longest context, in bytes.
ORDER = 4
#: Languages whose trees share a table.
GROUP = 8
#: Bytes of tables that a worker keeps; further groups are made anew for each batch of texts.
TABLE_BYTES = 384 << 20
#: Bytes of packed trees that are broadcast at a time.
BROADCAST_BYTES = 256 << 20
_BITS = 9
_TILE = 1 << 18
_BOUNDARY = 256
UNKNOWN = "und"


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def ngrams(block: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Code of each byte with the ORDER symbols before it (the byte is lowest), and the index of each text's first (and the end)."""
    n = np.diff(block.row_start)
    symbols = np.full(len(block.data) + ORDER * len(n), _BOUNDARY, dtype=np.int64)
    place = np.arange(len(block.data)) + ORDER * (np.repeat(np.arange(len(n)), n) + 1)
    symbols[place] = block.data
    code = np.zeros(len(place), dtype=np.int64)
    for i in range(ORDER, -1, -1):
        code = code << _BITS | symbols[place - i]
    return code, block.row_start


def count_ngrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to (lang, code, n)."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            for _, _, block in words.blocks(batch.column("text").filter(pa.array(langs == lang))):
                codes, n = np.unique(ngrams(block)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, code, n), those of a language together and in order, to packed pieces of a language's tree."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        cuts = [0, *(np.flatnonzero(langs[1:] != langs[:-1]) + 1).tolist(), len(langs)]
        code, n = batch.column("code").to_numpy(), batch.column("n").to_numpy()
        rows = [(langs[a], packed.pack(code[a:b].view(np.uint64), n[a:b])) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.binary())], ["lang", "blob"])


class _Lookup:
    """Index of codes among sorted distinct ones, by a hash table of open addresses."""

    def __init__(self, codes: np.ndarray):
        self.codes, bits = codes, max(4, (2 * len(codes)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        at, left = self._home(codes), np.arange(len(codes), dtype=np.int32)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            more = self.slots[at] != left
            at, left = (at[more] + 1) & self.mask, left[more]

    def _home(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Index of each code, or -1."""
        at = self._home(codes)
        out = self.slots[at]
        left = np.flatnonzero((out >= 0) & (self.codes[out] != codes)) if len(self.codes) else []
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            out[left] = self.slots[at[left]]
            left = left[(out[left] >= 0) & (self.codes[out[left]] != codes[left])]
        return out

    def nbytes(self) -> int:
        return self.codes.nbytes + self.slots.nbytes


class Trees:
    """Costs of n-grams and escapes of contexts, of each order, under several languages."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        k = len(counts)
        below_codes, below = None, None
        self.levels: list[tuple[_Lookup, np.ndarray, _Lookup, np.ndarray]] = []
        for order in range(ORDER + 1):
            own = []
            for code, n in counts:
                codes, group = np.unique(code & ((1 << _BITS * (order + 1)) - 1), return_inverse=True)
                own.append((codes, np.bincount(group, weights=n, minlength=len(codes))))
            grams = np.unique(np.concatenate([c for c, _ in own]))
            contexts = np.unique(grams >> _BITS)
            escapes = np.zeros((len(contexts), k), dtype=np.float32)
            costs = np.full((len(grams), k), np.nan, dtype=np.float32)
            for i, (codes, n) in enumerate(own):
                context, first, group = np.unique(codes >> _BITS, return_index=True, return_inverse=True)
                distinct = np.diff(np.append(first, len(codes)))
                room = np.log2(np.bincount(group, weights=n, minlength=len(context)) + distinct)
                escapes[np.searchsorted(contexts, context), i] = room - np.log2(distinct)
                costs[np.searchsorted(grams, codes), i] = room[group] - np.log2(n)
            shorter = 8.0 if below is None else below[np.searchsorted(below_codes, grams & ((1 << _BITS * order) - 1))]
            full = escapes[np.searchsorted(contexts, grams >> _BITS)] + shorter
            costs = np.where(np.isnan(costs), full, costs).astype(np.float32)
            self.levels.append((_Lookup(grams), costs, _Lookup(contexts), escapes))
            below_codes, below = grams, costs
        self.size = sum(a.nbytes() + b.nbytes + c.nbytes() + d.nbytes for a, b, c, d in self.levels)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Cost of each n-gram's last byte: (codes, languages)."""
        out = np.zeros((len(codes), self.levels[0][1].shape[1]), dtype=np.float32)
        left = None
        for order in range(ORDER, -1, -1):
            grams, costs, contexts, escapes = self.levels[order]
            own = (codes if left is None else codes[left]) & ((1 << _BITS * (order + 1)) - 1)
            place = grams.find(own)
            hit = place >= 0
            if left is None:
                out[hit] = costs[place[hit]]
                left = np.flatnonzero(~hit)
            else:
                out[left[hit]] += costs[place[hit]]
                left = left[~hit]
            if not len(left):
                break
            place = contexts.find(own[~hit] >> _BITS)
            known = place >= 0
            out[left[known]] += escapes[place[known]]
        else:
            out[left] += 8.0
        return out


class Model:
    """Packed n-gram counts by language; tables are made where they are used."""

    def __init__(self, blobs: dict[str, list[bytes]]):
        self.languages = sorted(blobs)
        self.blobs = blobs
        self._trees: dict[int, Trees] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trees": {}}

    def counts(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*map(packed.unpack, self.blobs[lang]), strict=True))
        return code.view(np.int64), n

    def trees(self) -> Iterator[tuple[int, Trees]]:
        """The first language of each group and its table. TABLE_BYTES of them are kept."""
        for a in range(0, len(self.languages), GROUP):
            own = self._trees.get(a)
            if own is None:
                own = Trees([self.counts(x) for x in self.languages[a : a + GROUP]])
                if own.size + sum(x.size for x in self._trees.values()) <= TABLE_BYTES:
                    self._trees[a] = own
            yield a, own

    def parts(self, most: int) -> list[Model]:
        """Models of some of the languages each, of ``most`` bytes or one language."""
        out, size = [], 0
        for x in self.languages:
            own = sum(map(len, self.blobs[x]))
            if not out or size + own > most:
                out, size = [*out, {}], 0
            out[-1][x] = self.blobs[x]
            size += own
        return [Model(x) for x in out]

    def code_lengths(self, texts: pa.Array) -> np.ndarray:
        """Bits of each text under each language: (texts, languages)."""
        out = np.zeros((len(texts), len(self.languages)))
        for start, trees in self.trees():
            width = trees.levels[0][1].shape[1]
            for a, b, block in words.blocks(texts):
                codes, first = ngrams(block)
                for lo in range(0, len(codes), _TILE):  # a long text in parts; its bits are summed up
                    hi = min(lo + _TILE, len(codes))
                    bits = trees.bits(codes[lo:hi])
                    cuts = np.clip(first, lo, hi) - lo
                    for i in range(width):
                        total = np.concatenate(([0.0], np.cumsum(bits[:, i], dtype=np.float64)))
                        out[a:b, start + i] += total[cuts[1:]] - total[cuts[:-1]]
        return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Learn from the text and non-null lang of ``docs`` (all of its rows count as labelled)."""
    labelled = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = staged(sizes.select("lang", F.least(F.lit(1.0), F.lit(float(sample_docs)) / F.col("n")).alias("share")), "languages")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) / F.lit(1e6)
    # one row a language; they are joined by a map that travels with the filter
    of = {r["lang"]: r["share"] for r in share.collect()}
    if not of:
        return None
    shares = F.create_map(*[F.lit(x) for kv in of.items() for x in kv])
    sample = labelled.filter(draw < shares[F.col("lang")]).select("lang", "text")
    bound_batches(docs.sparkSession)
    counted = sample.mapInArrow(count_ngrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    tree = counted.repartition("lang").sortWithinPartitions("lang", "code").mapInArrow(_pack, "lang string, blob binary")
    blobs: dict[str, list[bytes]] = {}
    for row in tree.toLocalIterator():
        blobs.setdefault(row["lang"], []).append(bytes(row["blob"]))
    return Model(blobs) if blobs else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), lang_pred and score of each document."""
    rows = docs.select(F.struct("*").alias("row"), F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"))
    if model is None:
        return rows.select("row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    spark = docs.sparkSession
    bound_batches(spark)
    parts = model.parts(BROADCAST_BYTES)
    found = rows.withColumns({"lang_pred": F.lit(UNKNOWN), "bits": F.lit(None).cast("double"), "mass": F.lit(0.0)})
    for i, part in enumerate(parts):
        held = spark.sparkContext.broadcast(part)
        found = found.mapInArrow(lambda batches, held=held: _score(batches, held), found.schema)
        if i + 1 < len(parts):
            found = staged(found, "languages-so-far")
    return found.select("row", "lang_pred", F.when(F.col("mass") > 0, 1 / F.col("mass")).otherwise(F.lit(0.0)).alias("score"))


def _score(batches: Iterable[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """Rows with the least bits so far, their language, and the mass of all languages as a multiple of its probability."""
    model = held.value
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column("text")
        bits = model.code_lengths(texts)
        none = np.array(texts.is_null())
        best, least = bits.argmin(axis=1), bits.min(axis=1)
        mass = np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        names = np.array(model.languages, dtype=object)[best]
        known = np.array(batch.column("bits").is_valid())
        before = np.where(known, batch.column("bits").fill_null(0).to_numpy(zero_copy_only=False), np.inf)
        old = before <= least
        both = np.where(known, np.minimum(before, least), least)
        total = mass * np.exp2(np.maximum(both - least, -1000)) + np.where(known, batch.column("mass").to_numpy() * np.exp2(np.maximum(both - np.where(known, before, both), -1000)), 0)
        names[old] = np.array(batch.column("lang_pred").to_pylist(), dtype=object)[old]
        names[none], total[none] = UNKNOWN, 0.0
        yield pa.RecordBatch.from_arrays([batch.column("row"), texts, pa.array(names, pa.string()), pa.array(both, pa.float64(), mask=none), pa.array(total, pa.float64())], ["row", "text", "lang_pred", "bits", "mass"])


def language_filter(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """``docs`` without the documents that are rejected: no letter in them, or no language above ``min_score``."""
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
