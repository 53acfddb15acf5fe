"""MinHash near-dedup with b-bit signatures.

Documents are sets of hashes of SHINGLE consecutive words (A-Z lowered), 4 unless told otherwise. Documents with equal
sets are one class, and only its smallest doc_id goes on. Each class gets MINIMA minima;
their low BITS bits are packed into a signature, and each of BANDS bands of ROWS full minima
gives a bucket.

1. Candidates: every member of a bucket with its smallest member. Their similarity is
   estimated from the number of equal packed minima, corrected for the minima that agree by
   chance, and pairs SLACK standard deviations below the threshold are left out.
2. Links: the rest is confirmed on the full sets of both texts.
3. Components: min-label propagation over the links.
4. Sweep: buckets whose members still belong to several components may hold links between
   two members neither of which is the smallest. Members outside a bucket's largest
   component meet the members of other components; pairs are estimated and confirmed as
   before, in one of the buckets they share, and components are joined. Pairs within a
   component can't change it, so no bucket is ever expanded into all its pairs. Before they meet, each such document's
   shingles that no other document of these buckets has are counted: they lie outside every
   intersection, which bounds the similarity of a pair from above, and pairs whose bound is
   below the threshold never arise. So the copies of a large group that strayed too far to
   be linked aren't compared with all the others.

With BANDS = 40 and ROWS = 5 a pair at similarity 0.8 shares no bucket with probability
1.2e-7; with SLACK = 5 the estimate loses 3e-7 of them. There is no cap on buckets, partners
or candidates.

Defined results: a text of fewer words than a shingle is one shingle of all its words; a
null text or one without words has an empty set and is a component of its own. Rows with
equal doc_id are taken for repeats of one document. A row without a doc_id links nothing: it
has the component of the class of equal sets, if there is one, and is kept. Extra columns
are neither read nor returned. An empty table gives an empty result; very long texts count whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed, words, zipped
from tessera.llm.common import bound_batches, columns, free_name, staged

BANDS, ROWS, MINIMA, BITS, SLACK = 40, 5, 400, 4, 5.0
SHINGLE, PERCENT = 4, 80
_LANES = 64 // BITS
_LOW = sum(1 << (BITS * i) for i in range(_LANES))
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**32, (2, MINIMA), dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingle_sets(block: words.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, in a row, and where each text's begin (and the end)."""
    row, hashes, counts = block.row_of_word(), block.hashes(lower=True), block.counts()
    sets, at = words.shingles(hashes, row, n)
    of = row[at]
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # all words as one shingle; its length keeps it apart
        with np.errstate(over="ignore"):
            own = [words.mix(np.array([_fold(hashes[block.first[i] : block.first[i + 1]])], dtype=np.uint64))[0] for i in short]
        sets, of = np.concatenate((sets, np.array(own, dtype=np.uint64))), np.concatenate((of, short))
    order = np.lexsort((sets, of))
    sets, of = sets[order], of[order]
    if len(sets):
        new = np.concatenate(([True], (sets[1:] != sets[:-1]) | (of[1:] != of[:-1])))
        sets, of = sets[new], of[new]
    return sets, np.searchsorted(of, np.arange(len(counts) + 1))


def _fold(hashes: np.ndarray) -> int:
    out = len(hashes)
    for h in hashes.tolist():
        out = (out * 0x100000001B3 + h) % 2**64
    return out


def minima(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MINIMA minima of each of several sets that begin at ``starts``: (sets, minima)."""
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    y = (words.mix(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), MINIMA), dtype=np.uint32)
    for i, (a, b) in enumerate(_SEEDS.T):
        out[:, i] = np.minimum.reduceat((x * a) ^ (y + b), starts)
    return out


def sketch(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the bands, and the packed low bits of the minima, as signed 64-bit integers."""
    low = np.zeros((len(m), -(-m.shape[1] // _LANES) * _LANES), dtype=np.uint64)
    low[:, : m.shape[1]] = words.mix(m.astype(np.uint64)) & np.uint64(2**BITS - 1)
    packed = (low.reshape(len(m), -1, _LANES) << (np.uint64(BITS) * np.arange(_LANES, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(m), 1))
    with np.errstate(over="ignore"):
        for i in range(ROWS):
            key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + m[:, i : BANDS * ROWS : ROWS])
    return key.view(np.int64), packed.view(np.int64)


def _lists(values: np.ndarray, filled: np.ndarray) -> pa.Array:
    """A list for each row; the filled rows have those of ``values``."""
    offsets = np.concatenate(([0], np.cumsum(filled * values.shape[1]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def _sketch(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, block in words.blocks(batch.column("text")):
            sets, first = shingle_sets(block, shingle)
            n = np.diff(first)
            filled = n > 0
            keys, packed = sketch(minima(sets, first[:-1][filled])) if filled.any() else (np.empty((0, BANDS), np.int64), np.empty((0, 1), np.int64))
            digest = [hashlib.sha256(sets[first[i] : first[i + 1]].tobytes()).digest() if n[i] else None for i in range(b - a)]
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), _lists(keys, filled), _lists(packed, filled)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "bands", "packed"])


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bucket keys and packed signature of each document."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda x: _sketch(x, shingle), "doc_id long, n_shingles long, digest binary, bands array<long>, packed array<long>")


def equal_minima(a: Column, b: Column) -> Column:
    """How many packed minima of two signatures agree."""
    words_ = -(-MINIMA // _LANES)
    total = F.lit(MINIMA)
    low = _LOW - 2**64 if _LOW >= 2**63 else _LOW
    for i in range(words_):
        x = a[i].bitwiseXOR(b[i])
        for shift in range(1, BITS):
            x = x.bitwiseOR(F.shiftrightunsigned(a[i].bitwiseXOR(b[i]), shift))
        total = total - F.bit_count(x.bitwiseAND(F.lit(low)))
    return total


def estimate(a: Column, b: Column) -> Column:
    """Similarity estimated from packed signatures, corrected for minima that agree by chance."""
    chance = 2.0**-BITS
    return (equal_minima(a, b) / F.lit(float(MINIMA)) - chance) / (1 - chance)


def least_estimate(percent: int = PERCENT) -> float:
    chance, j = 2.0**-BITS, percent / 100
    p = chance + (1 - chance) * j
    return j - SLACK * (p * (1 - p) / MINIMA) ** 0.5 / (1 - chance)


def _confirm(batches: Iterable[pa.RecordBatch], percent: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs (a, b) that are linked."""
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        linked = np.zeros(len(a), dtype=bool)
        cache: dict[bytes, np.ndarray] = {}

        def shingles(blob: bytes, cache: dict = cache) -> np.ndarray:
            if blob not in cache:
                if len(cache) > 64:
                    cache.clear()
                data = np.frombuffer(zipped.unzip(blob), dtype=np.uint8)
                cache[blob] = shingle_sets(words.of_bytes(data, np.array([0, len(data)])), shingle)[0]
            return cache[blob]

        for i, (x, y) in enumerate(zip(batch.column("text_a"), batch.column("text_b"), strict=True)):
            x, y = shingles(x.as_py()), shingles(y.as_py())
            both = len(np.intersect1d(x, y, assume_unique=True))
            linked[i] = 100 * both >= percent * (len(x) + len(y) - both)
        keep = pa.array(linked)
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; texts: doc_id, zipped."""
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("zipped").alias("text_a")), "a")
    both = both.join(texts.select(F.col("doc_id").alias("b"), F.col("zipped").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda x: _confirm(x, percent, shingle), "a long, b long")


def likely(pairs: DataFrame, signatures: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose estimated similarity is not too far below the threshold."""
    own = lambda x: signatures.select(F.col("doc_id").alias(x), F.col("packed").alias(f"packed_{x}"))
    joined = pairs.join(own("a"), "a").join(own("b"), "b")
    return joined.filter(estimate(F.col("packed_a"), F.col("packed_b")) >= least_estimate(percent)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of all ends of the links (a, b): alternating large and small stars.

    Each round writes its edges to the shared folder. Large star: a node's larger
    neighbours are tied to its smallest one; small star: its smaller ones are. Rounds end
    when every edge leads to the smallest node of its component.
    """
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = staged(edges, "links")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # now each node's smaller neighbours, and itself, are tied to the smallest of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("x"), "a", "b")
        new = small.select("x", F.explode(F.array("a", "b")).alias("b")).filter("x < b").select(F.col("x").alias("a"), "b").distinct()
        new = staged(new, "links")
        # done when edges are stars: no node is both a larger and a smaller end, and no larger end has two
        ends = new.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
        inner = new.select(F.col("a").alias("b")).distinct().withColumn("n", F.lit(2).cast("long"))
        if ends.filter("n > 1").isEmpty() and ends.select("b").join(inner, "b", "left_semi").isEmpty():
            stars = new
            break
        edges = new
    return stars.select(F.col("b").alias("doc_id"), F.col("a").alias("component")).unionByName(stars.select(F.col("a").alias("doc_id"), F.col("a").alias("component")).distinct())


def _send_shingles(batches: Iterable[pa.RecordBatch], buckets: int, shingle: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, zipped) to packed (shingle, doc); a shingle of two documents here is settled here."""
    chunk = packed.Chunk()

    def flush() -> Iterator[pa.RecordBatch]:
        columns = chunk.take()
        if not columns or not len(columns[0]):
            return
        h, doc = columns
        order, starts = packed.groups(h, doc)
        h, doc = h[order], doc[order]
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        known = packed.per_row(starts, np.diff(np.append(starts, len(h))) > 1, len(h))
        first = np.zeros(len(h), dtype=bool)
        first[starts] = True
        send = ~known | first
        rows = [(x, False, y) for x, y in packed.by_bucket(buckets, h[send], doc[send], known[send].astype(np.int64))]
        if known.any():
            own, n = np.unique(doc[known], return_counts=True)
            spread = words.mix(own.view(np.uint64))
            o = np.argsort(spread)
            rows += [(x, True, y) for x, y in packed.by_bucket(buckets, spread[o], own[o], n[o].astype(np.int64))]
        yield packed.batch(rows)

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for a, b, block in zipped.blocks(batch.column("zipped")):
            sets, first = shingle_sets(block, shingle)
            if chunk.add(sets, np.repeat(ids[a:b], np.diff(first))):
                yield from flush()
    yield from flush()


def _count_shared(records: list[np.ndarray], settled: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """How many shingles of each document another document has, as partial counts packed by document."""
    out = [settled[1:]] if settled else []
    if records:
        h, doc, known = records
        order, starts = packed.groups(h)
        h, doc, known = h[order], doc[order], known[order]
        several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.maximum.reduceat(known, starts) > 0)
        own, n = np.unique(doc[packed.per_row(starts, several, len(h)) & (known == 0)], return_counts=True)
        out.append([own, n.astype(np.int64)])
    doc, n = (np.concatenate(c) for c in zip(*out, strict=True))
    if not len(doc):
        return None
    spread = words.mix(doc.view(np.uint64))
    o = np.argsort(spread)
    return packed.batch([(b, False, x) for b, x in packed.by_bucket(buckets, spread[o], doc[o], n[o])])


def _sum_counts(records: list[np.ndarray], _: list[np.ndarray]) -> pa.RecordBatch:
    _, doc, n = records
    order, starts = packed.groups(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc[order][starts], pa.int64()), pa.array(np.add.reduceat(n[order], starts), pa.int64())], ["doc_id", "n_shared"])


def shared_shingles(texts: DataFrame, buckets: int, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and n_shared, the number of its shingles that another of the texts (doc_id, zipped) has."""
    sent = texts.select("doc_id", "zipped").mapInArrow(lambda x: _send_shingles(x, buckets, shingle), packed.SCHEMA)
    counted = packed.received(sent, lambda x, y: _count_shared(x, y, buckets), packed.SCHEMA, buckets)
    return packed.received(counted, _sum_counts, "doc_id long, n_shared long", buckets)


def near_dedup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    sketched = staged(sketches(docs, shingle), "sketches")
    classes = sketched.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    classes = staged(classes, "classes")
    unique = sketched.join(classes, [sketched["digest"] == classes["digest"], sketched["doc_id"] == classes["class_id"]], "left_semi")
    signatures = unique.groupBy("doc_id").agg(F.first("packed").alias("packed"))

    members = unique.select("doc_id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most")
    members = staged(members.join(shared.select("bucket", "least"), "bucket"), "members")

    stars = members.filter("least < doc_id").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = staged(likely(stars, signatures, percent), "stars")
    candidates = members.select("doc_id").distinct()
    texts = staged(zipped.compressed(docs).join(candidates, "doc_id", "left_semi"), "texts")
    found = staged(components(staged(confirm(stars, texts, percent, shingle), "confirmed")), "components")

    labelled = members.join(found, "doc_id", "left").select("bucket", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    labelled = staged(labelled, "labelled")
    sizes = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("k"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("k > 1")
    active = staged(labelled.join(mixed.select("bucket", "main"), "bucket"), "active")
    bounds = shared_shingles(texts.join(active.select("doc_id").distinct(), "doc_id", "left_semi"), packed.bucket_count(texts), shingle)
    bounds = bounds.join(sketched.select("doc_id", "n_shingles").distinct(), "doc_id").filter(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    active = active.join(bounds, "doc_id").join(signatures, "doc_id").join(unique.select("doc_id", "bands").dropDuplicates(["doc_id"]), "doc_id")
    active = staged(active, "active")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("doc_id", "component", "packed", "n_shared", "n_shingles", "bands")]
    others = active.filter("component <> main").select("bucket", *side("x"))
    met = others.join(active.select("bucket", *side("y")), "bucket").filter("x_component <> y_component")
    most = F.least("x_n_shared", "y_n_shared")
    met = met.filter(100 * most >= percent * (F.col("x_n_shingles") + F.col("y_n_shingles") - most))
    met = met.filter(estimate(F.col("x_packed"), F.col("y_packed")) >= least_estimate(percent))
    met = met.filter(F.array_min(F.array_intersect("x_bands", "y_bands")) == F.col("bucket"))  # of the buckets they share, in one
    met = met.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    more = staged(confirm(met, texts, percent, shingle), "swept")
    if not more.isEmpty():  # tie components together
        label = lambda x: found.select(F.col("doc_id").alias(x), F.col("component").alias(f"c{x}"))
        ties = more.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        tied = components(ties).withColumnRenamed("component", "into").withColumnRenamed("doc_id", "component")
        whole = found.join(tied, "component", "left").select("doc_id", F.coalesce("into", "component").alias("component"))
        alone = tied.join(found, "component", "left_anti").select(F.col("component").alias("doc_id"), F.col("into").alias("component"))
        found = whole.unionByName(alone)

    rows = sketched.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left")
    rows = rows.join(found.select(F.col("doc_id").alias("class_id"), "component"), "class_id", "left")
    component = F.coalesce("component", "class_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group of near copies (and all rows without a set); its
    columns stay, whatever their names."""
    name = free_name(docs, "tessera_gone")
    gone = near_dedup(docs, percent, shingle).filter(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti").select(*columns(docs))
