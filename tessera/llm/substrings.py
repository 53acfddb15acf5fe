"""Substring dedup by a compacted de Bruijn graph of token k-mers.

A word is removed when a window of WINDOW consecutive words that covers it also starts in
a document with a smaller doc_id.

1. Anchors: of every WINDOW consecutive words, the K-gram with the smallest hash is an anchor.
   Equal windows have equal anchors, so only windows that hold an anchor of two documents can
   repeat; the others go no further.
2. Edges: each such window, a k-mer of WINDOW words, is an edge from its first WINDOW - 1 words
   to its last. Tasks send each edge with its source coordinates (doc_id, first word), the word
   that follows and how often it occurs; buckets of hashes join the occurrences. The smallest
   coordinates of an edge that two documents hold are its representative.
3. Compaction: representative, count and whether the edge has one follower only are joined back
   to the occurrences. An edge and the next of its document belong to one path where the node
   between them doesn't branch: the first has one follower and both occur equally often. Such a
   path is a unitig, told by its representative's coordinates, one row for all its occurrences.
4. Verification: the words at the coordinates of each occurrence are joined with those of its
   unitig's representative, and compared. The words of occurrences that equal a
   representative in a smaller document go.

An edge that several documents of one task hold is settled there: the smallest document's
occurrence goes on and stands for the others, whose paths are compared with it, word by word,
on the spot. So an edge sends one record for each task and its document, and a passage of a
third of all documents is no hot key.

Defined results: a null text has no words; rows with a null doc_id neither lose words nor
make others lose any; doc_id identifies a document, so rows that share one are taken for
repeats of one row, which don't make each other lose words. An empty table gives an empty
result. Extra columns are neither read nor returned. Texts move through Spark once, compressed
and in buckets of doc_id, so a hot source or passage is no hot key there either.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import packed, words, zipped
from tessera.llm.common import bound_batches, looked_up, staged

WINDOW, K = 13, 7
REACH = WINDOW - K + 1
#: Bytes of texts that a task holds to compare occurrences it settles.
HELD_BYTES = 32 << 20
#: Occurrences of a unitig that are compared in one part.
PART = 2048


def select_kmers(block: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and position in its row of the anchors: K-grams that are smallest in some window."""
    row = block.row_of_word()
    h, at = words.shingles(block.hashes(), row, K)
    chosen = np.zeros(len(h), dtype=bool)
    n = len(h) - REACH + 1
    if n > 0:
        least = h[:n].copy()
        for i in range(1, REACH):
            np.minimum(least, h[i : i + n], out=least)
        whole = row[at[:n]] == row[at[REACH - 1 :]]
        for i in range(REACH):
            chosen[i : i + n] |= whole & (h[i : i + n] == least)
    of = row[at[chosen]]
    return h[chosen], of, at[chosen] - block.first[of]


def _by_document(buckets: int, settled: bool, doc: np.ndarray, *columns: np.ndarray) -> list[tuple[int, bool, bytes]]:
    """Blobs of (doc, columns) in buckets of a hash of doc."""
    spread = words.mix(doc.view(np.uint64))
    o = np.argsort(spread, kind="stable")
    return [(b, settled, x) for b, x in packed.by_bucket(buckets, spread[o], doc[o], *[c[o] for c in columns])]


def _send_anchors(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    chunk = packed.Chunk()

    def flush() -> Iterator[pa.RecordBatch]:
        columns = chunk.take()
        if not columns or not len(columns[0]):
            return
        h, doc, pos = columns
        order, starts = packed.groups(h)
        h, doc, pos = h[order], doc[order], pos[order]
        several = np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)
        known = packed.per_row(starts, several, len(h))
        first = np.zeros(len(h), dtype=bool)
        first[starts] = True
        send = ~known | first  # of an anchor known to repeat one record tells the others so
        rows = [(b, False, x) for b, x in packed.by_bucket(buckets, h[send], doc[send], pos[send], known[send].astype(np.int64))]
        if known.any():
            rows += _by_document(buckets, True, doc[known], pos[known])
        yield packed.batch(rows)

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for a, b, block in zipped.blocks(batch.column("zipped")):
            h, row, pos = select_kmers(block)
            if chunk.add(h, ids[a:b][row], pos):
                yield from flush()
    yield from flush()


def _repeated(records: list[np.ndarray], settled: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Occurrences of the anchors that two documents hold, packed by document."""
    out = [settled[1:]] if settled else []
    if records:
        h, doc, pos, known = records
        order, starts = packed.groups(h)
        doc, pos, known = doc[order], pos[order], known[order]
        several = (np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)) | (np.maximum.reduceat(known, starts) > 0)
        keep = packed.per_row(starts, several, len(doc)) & (known == 0)
        out.append([doc[keep], pos[keep]])
    doc, pos = (np.concatenate(c) for c in zip(*out, strict=True))
    return packed.batch(_by_document(buckets, False, doc, pos)) if len(doc) else None


def _positions(records: list[np.ndarray], _: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each document with the positions of its anchors."""
    _, doc, pos = records
    order, starts = packed.groups(doc, pos)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(doc[order]) != 0)))
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(doc)), pa.int32()), pa.array(pos[order], pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(doc[order][starts], pa.int64()), lists], ["doc_id", "positions"])


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """doc_id and positions of its anchors that another document has, one row per document."""
    rows = texts.filter("doc_id is not null").select("doc_id", "zipped")
    sent = rows.mapInArrow(lambda x: _send_anchors(x, buckets), packed.SCHEMA)
    found = packed.received(sent, lambda x, y: _repeated(x, y, buckets), packed.SCHEMA, buckets)
    return packed.received(found, _positions, "doc_id long, positions array<int>", buckets)


def _second_hash(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """32 more bits of the windows that start at these words."""
    out = np.zeros(len(at), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            out = out * np.uint64(0xD6E8FEB86659FD93) + (h[at + i] ^ (h[at + i] >> np.uint64(29)))
    return (words.mix(out) >> np.uint64(32)).astype(np.int64)


def _joined(block: words.Words, first: int, behind: int) -> bytes:
    """Words of a block, one space between."""
    return b" ".join([block.data[a:b].tobytes() for a, b in zip(block.start[first:behind].tolist(), block.end[first:behind].tolist(), strict=True)])


def _runs(doc: np.ndarray, pos: np.ndarray, rep_doc: np.ndarray, rep_pos: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each path: neighbours in a document whose representatives are
    neighbours too, where ``whole`` tells that the node before an edge doesn't branch."""
    same = (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1) & (rep_doc[1:] == rep_doc[:-1]) & (rep_pos[1:] == rep_pos[:-1] + 1) & whole[1:]
    first = np.flatnonzero(np.concatenate(([True], ~same)))
    return first, np.append(first[1:], len(doc)) - 1


def _send_edges(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, zipped, positions) to packed edges; paths that are settled here, by document."""
    chunk, held = packed.Chunk(packed.CHUNK // 2), []

    def flush() -> Iterator[pa.RecordBatch]:
        columns = chunk.take()
        if not columns or not len(columns[0]):
            held.clear()
            return
        order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
        h, second, doc, pos, following, at, of = (c[order] for c in columns)
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (second[1:] != second[:-1]))))
        each = lambda x: packed.per_row(starts, x, len(h))
        least = each(doc[starts])
        gone = doc > least
        # what stands for the others carries their number, and 0 for a follower that isn't the same for all
        number = np.ones(len(h), dtype=np.int64)
        number[starts] += np.add.reduceat(gone.astype(np.int64), starts)
        one = np.where(each((np.minimum.reduceat(following, starts) == np.maximum.reduceat(following, starts))), following, 0)
        stay = ~gone
        rows = [(b, False, x) for b, x in packed.by_bucket(buckets, h[stay], second[stay], doc[stay], pos[stay], one[stay], number[stay])]
        if gone.any():
            rep = each(starts)[gone]
            g = np.lexsort((at[gone], of[gone]))  # by row, as rows may share a doc_id
            i, rep = np.flatnonzero(gone)[g], rep[g]
            first, last = _runs(of[i], at[i], of[rep], at[rep], np.ones(len(i), dtype=bool))
            equal = np.array([_joined(held[of[i[x]]], at[i[x]], at[i[y]] + WINDOW) == _joined(held[of[rep[x]]], at[rep[x]], at[rep[y]] + WINDOW) for x, y in zip(first, last, strict=True)], dtype=bool)
            first, last = first[equal], last[equal]
            rows += _by_document(buckets, True, doc[i][first], pos[i][first], pos[i][last])
        held.clear()
        yield packed.batch(rows)

    for batch in batches:
        ids, positions = batch.column("doc_id").to_numpy(), batch.column("positions")
        for a, b, block in zipped.blocks(batch.column("zipped")):
            row, hashes = block.row_of_word(), block.hashes()
            h, at = words.shingles(hashes, row, WINDOW)
            own = positions.slice(a, b - a)
            lengths = np.array([len(x) for x in own], dtype=np.int64)
            anchor = np.repeat(block.first[:-1], lengths) + own.flatten().to_numpy()
            inside = np.zeros(len(row) + 1, dtype=np.int64)
            np.add.at(inside, np.maximum(anchor - (REACH - 1), np.repeat(block.first[:-1], lengths)), 1)
            np.add.at(inside, anchor + 1, -1)
            take = np.cumsum(inside)[at] > 0
            h, at = h[take], at[take]
            behind = np.minimum(at + WINDOW, len(row) - 1)
            following = np.where((at + WINDOW < len(row)) & (row[behind] == row[at]), (hashes[behind] & np.uint64(0xFFFF)).astype(np.int64) | 1, 0)
            if not len(h):
                continue
            held.append(block)
            of = np.full(len(h), len(held) - 1, dtype=np.int64)
            if chunk.add(h, _second_hash(hashes, at), ids[a:b][row[at]], at - block.first[row[at]], following, at, of) or sum(len(x.data) for x in held) > HELD_BYTES:
                yield from flush()
    yield from flush()


def _represented(records: list[np.ndarray], settled: list[np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Occurrences of the edges that two documents hold, with representative, count and whether
    there is one follower, packed by document; and what is settled."""
    rows = _by_document(buckets, True, *settled[1:]) if settled else []
    if records:
        order = np.lexsort((records[3], records[2], records[1], records[0]))
        h, second, doc, pos, following, number = (c[order] for c in records)
        starts = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (second[1:] != second[:-1]))))
        each = lambda x: packed.per_row(starts, x, len(h))
        several = each(doc[starts] != np.maximum.reduceat(doc, starts))
        same = (np.minimum.reduceat(following, starts) == np.maximum.reduceat(following, starts)) & (following[starts] > 0)
        columns = (doc, pos, each(doc[starts]), each(pos[starts]), each(np.add.reduceat(number, starts)), each(same.astype(np.int64)))
        if several.any():
            rows += _by_document(buckets, False, *[c[several] for c in columns])
    return packed.batch(rows) if rows else None


_PATH = "doc_id long, first int, last int, rep_doc long, rep_first int"


def _paths(records: list[np.ndarray], settled: list[np.ndarray]) -> pa.RecordBatch:
    """Occurrences of unitigs; rep_doc is null for paths that are settled."""
    out = []
    if records:
        _, doc, pos, rep_doc, rep_pos, number, one = records
        order = np.lexsort((pos, doc))
        keep = np.concatenate(([True], (np.diff(doc[order]) != 0) | (np.diff(pos[order]) != 0)))  # rows that share a doc_id
        doc, pos, rep_doc, rep_pos, number, one = (c[order][keep] for c in (doc, pos, rep_doc, rep_pos, number, one))
        whole = np.concatenate(([False], (one[:-1] > 0) & (number[1:] == number[:-1])))
        first, last = _runs(doc, pos, rep_doc, rep_pos, whole)
        out.append([doc[first], pos[first], pos[last], rep_doc[first], rep_pos[first], np.zeros(len(first), dtype=bool)])
    if settled:
        _, doc, first, last = settled
        out.append([doc, first, last, doc, first, np.ones(len(doc), dtype=bool)])
    doc, first, last, rep_doc, rep_first, done = (np.concatenate(c) for c in zip(*out, strict=True))
    columns = [pa.array(doc, pa.int64()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(rep_doc, pa.int64(), mask=done), pa.array(rep_first, pa.int32(), mask=done)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _PATH.split(", ")])


def unitig_occurrences(texts: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """doc_id, first and last edge, and the unitig (rep_doc, rep_first) of each path; the
    representative's own row is among them. Paths settled within a task have no unitig."""
    rows = texts.join(anchors, "doc_id").select("doc_id", "zipped", "positions")
    sent = rows.mapInArrow(lambda x: _send_edges(x, buckets), packed.SCHEMA)
    found = packed.received(sent, lambda x, y: _represented(x, y, buckets), packed.SCHEMA, buckets)
    return packed.received(found, _paths, _PATH, buckets)


def _words_at(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, zipped, paths) to one row per path with its words. They are compressed; equal
    bytes are equal words, and equal words give equal bytes."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        paths = batch.column("paths")
        for a, b, block in zipped.blocks(batch.column("zipped")):
            out = []
            for i in range(b - a):
                doc = batch.column("doc_id")[a + i].as_py()
                out += [(doc, x["first"], x["last"], x["rep_doc"], x["rep_first"], pack.compress(_joined(block, block.first[i] + x["first"], block.first[i] + x["last"] + WINDOW))) for x in paths[a + i].as_py()]
            columns = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "first", "last", "rep_doc", "rep_first", "words"])


def verified(texts: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, first and last edge of the paths whose words equal those of a representative in a smaller document."""
    own = paths.filter("rep_doc is not null").groupBy("doc_id").agg(F.collect_list(F.struct("first", "last", "rep_doc", "rep_first")).alias("paths"))
    found = texts.join(own, "doc_id").select("doc_id", "zipped", "paths").mapInArrow(_words_at, _PATH + ", words binary")
    found = staged(found, "path-words")
    unitigs = found.filter("doc_id = rep_doc and first = rep_first").select("rep_doc", "rep_first", F.col("words").alias("rep_words")).distinct()
    later = found.filter("doc_id > rep_doc")
    # occurrences of a unitig that very many documents hold are dealt to parts, each with its words
    parts = later.groupBy("rep_doc", "rep_first").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).filter("parts > 1")
    parts = staged(parts, "parts")
    later = looked_up(later, parts, "rep_doc", "rep_first").withColumn("part", F.pmod(F.xxhash64("doc_id", "first"), F.coalesce("parts", F.lit(1))))
    unitigs = unitigs.join(parts, ["rep_doc", "rep_first"], "left").select("rep_doc", "rep_first", "rep_words", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    return later.join(unitigs, ["rep_doc", "rep_first", "part"]).filter("words = rep_words").select("doc_id", "first", "last")


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("gone")
        for a, b, block in zipped.blocks(batch.column("zipped")):
            n, removed, kept = block.counts(), np.zeros(b - a, dtype=np.int64), []
            for i in range(b - a):
                first, behind = block.first[i], block.first[i + 1]
                start, end = block.start[first:behind], block.end[first:behind]
                own = gone[a + i]
                if own.is_valid and len(own):
                    cover = np.zeros(n[i] + 1, dtype=np.int64)
                    np.add.at(cover, np.minimum(own.values.field("first").to_numpy(), n[i]), 1)
                    np.subtract.at(cover, np.minimum(own.values.field("last").to_numpy() + WINDOW, n[i]), 1)
                    keep = np.cumsum(cover)[:-1] <= 0
                    removed[i] = n[i] - keep.sum()
                    start, end = start[keep], end[keep]
                data = block.data
                kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)]))
            columns = [batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of each row."""
    bound_batches(docs.sparkSession)
    texts = zipped.stored(docs, "texts")
    buckets = packed.bucket_count(texts)
    anchors = staged(repeated_anchors(texts, buckets), "anchors")
    paths = staged(unitig_occurrences(texts, anchors, buckets), "paths")
    gone = verified(texts, paths).unionByName(paths.filter("rep_doc is null").select("doc_id", "first", "last"))
    gone = staged(gone.groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("gone")), "gone")
    rows = texts.join(gone, "doc_id", "left").select("doc_id", "zipped", "gone")
    return rows.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
