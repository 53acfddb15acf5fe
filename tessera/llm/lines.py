"""Line dedup by content-defined chunks of lines.

Texts are split at ``\\n``. A boundary stands between two lines where a rolling hash over the
hashes of the WINDOW lines around the place is below KEEP modulo DIVISOR, so lines added or
removed elsewhere don't move it; a chunk ends after MOST_LINES lines at the latest. Chunks that
are compared are whole ones and, since a repeated run of lines rarely begins and ends at a
boundary, their parts from the first line or to the last, and the two lines around each
boundary; all of LEAST_LINES lines or more. A run of lines is found but for its lines at an end
that no boundary parts from what is no repeat.

Of equal chunks, in whatever documents, the one in the smallest doc_id, then at the first line,
stays; the others go, after their bytes have been compared with the bytes of the one that
stays. A line that goes is equal to an earlier line of such a chunk, so each line's text stays
somewhere. Where a chunk overlaps the one that stays (a line said three times or more), the
lines of the latter stay.

Defined results: a null or empty text has no lines; chunks of white space only stay; rows
with a null doc_id neither lose lines nor make others lose any; doc_id identifies a
document, so rows that share one are taken for repeats of one row. An empty table gives an
empty result. Counts by chunk are aggregated before the shuffle; the comparison is an
equi-join on the chunk's hash, which adaptive execution splits for a chunk that very many
documents hold. Texts meet what is wanted of them in sort-merge joins at every size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words, zipped
from tessera.llm.common import bound_batches, staged

WINDOW, DIVISOR, KEEP = 2, 4, 3
LEAST_LINES, MOST_LINES = 2, 8


def line_spans(block: words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each line, and the index of each text's first line (and the end)."""
    breaks = np.flatnonzero(block.data == 0x0A)
    filled = np.flatnonzero(np.diff(block.row_start) > 0)
    start = np.sort(np.concatenate((block.row_start[filled], breaks + 1)))
    end = np.sort(np.concatenate((block.row_start[filled + 1], breaks)))
    # a text that ends with a line break has an empty last line, at the start of the next text
    row = np.sort(np.concatenate((filled, np.searchsorted(block.row_start, breaks, side="right") - 1)))
    return start, end, np.searchsorted(row, np.arange(len(block) + 1))


def boundaries(block: words.Words, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a boundary stands before each line: where a text begins, and where the rolling
    hash over the WINDOW lines around the place says so."""
    h = words.Words(block.data, block.row_start, start, end, np.array([0, len(start)])).hashes()
    here = np.concatenate(([True], row[1:] != row[:-1]))
    if len(h) >= WINDOW:
        with np.errstate(over="ignore"):
            rolling = np.zeros(len(h) - WINDOW + 1, dtype=np.uint64)
            for i in range(WINDOW):
                rolling = rolling * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - WINDOW + 1 + i]
            hit = words.mix(rolling) % np.uint64(DIVISOR) < np.uint64(KEEP)
        here[WINDOW // 2 : WINDOW // 2 + len(hit)] |= hit
    return here


def chunk_spans(block: words.Words) -> dict[str, np.ndarray]:
    """Chunks of a block: text index, first line (from 0), lines, start and end byte, hash, and whether they hold a word."""
    start, end, first = line_spans(block)
    n, row = len(start), np.repeat(np.arange(len(block)), np.diff(first))
    if not n:
        return {k: np.empty(0, dtype=np.int64) for k in ("row", "line", "lines", "start", "end", "hash", "filled")}
    opens = boundaries(block, start, end, row)
    line = np.arange(n)
    opens |= (line - np.maximum.accumulate(np.where(opens, line, 0))) % MOST_LINES == 0
    heads = np.flatnonzero(opens)
    chunk = np.cumsum(opens) - 1
    head, last = heads[chunk], np.append(heads[1:], n)[chunk] - 1
    inner = line[opens & (line > first[:-1][row])]  # a boundary within a text
    # from each chunk's head to each of its lines, from each of its lines to its last, and across each boundary
    pairs = np.concatenate((np.stack((head, line)), np.stack((line, last)), np.stack((inner - 1, inner))), axis=1)
    pairs = pairs[:, pairs[1] - pairs[0] >= LEAST_LINES - 1]
    own, behind = np.unique(pairs, axis=1)
    of = row[own]
    order = np.argsort(of, kind="stable")
    own, behind, of = own[order], behind[order], of[order]
    spans = words.Words(block.data, block.row_start, start[own], end[behind], np.searchsorted(of, np.arange(len(block) + 1)))
    filled = np.searchsorted(block.start, spans.end) > np.searchsorted(block.start, spans.start)
    return {"row": of, "line": own - first[of], "lines": behind - own + 1, "start": spans.start, "end": spans.end, "hash": spans.hashes().view(np.int64), "filled": filled}


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, block in words.blocks(batch.column("text")):
            c = chunk_spans(block)
            take = (c["lines"] >= LEAST_LINES) & (c["filled"] > 0)
            doc = batch.column("doc_id").slice(a, b - a).take(pa.array(c["row"][take]))
            yield pa.RecordBatch.from_arrays([doc, pa.array(c["hash"][take]), pa.array(c["line"][take], pa.int32()), pa.array(c["lines"][take], pa.int32())], ["doc_id", "chunk", "line", "lines"])


def _bytes_of_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, zipped, own: chunks wanted) to one row per wanted chunk with its bytes."""
    for batch in batches:
        wanted = batch.column("own").to_pylist()
        for a, b, block in zipped.blocks(batch.column("zipped")):
            c = chunk_spans(block)
            place = {x: i for i, x in enumerate(zip(c["row"].tolist(), c["line"].tolist(), c["lines"].tolist(), strict=True))}
            rows = [(a + i, x) for i in range(b - a) for x in wanted[a + i]]
            rows = [(r, x) for r, x in rows if (r - a, x["line"], x["lines"]) in place]  # rows that share a doc_id may differ
            at = [place[r - a, x["line"], x["lines"]] for r, x in rows]
            doc = batch.column("doc_id").take(pa.array([r for r, _ in rows], pa.int64()))
            columns = [doc, pa.array([x["chunk"] for _, x in rows], pa.int64()), pa.array([x["line"] for _, x in rows], pa.int32()), pa.array([x["stays"] for _, x in rows], pa.bool_())]
            columns += [pa.array([int(c["lines"][i]) for i in at], pa.int32()), pa.array([block.data[c["start"][i] : c["end"][i]].tobytes() for i in at], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk", "line", "stays", "lines", "bytes"])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, line and lines of each chunk that equals an earlier one, byte for byte."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    chunks = staged(rows.mapInArrow(_chunks, "doc_id long, chunk long, line int, lines int").dropDuplicates(["doc_id", "line", "lines"]), "chunks")
    first = chunks.groupBy("chunk").agg(F.min(F.struct("doc_id", "line", "lines")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stays = F.struct("doc_id", "line", "lines") == F.col("first")
    wanted = chunks.join(first.select("chunk", "first"), "chunk").select("doc_id", F.struct("chunk", "line", "lines", stays.alias("stays")).alias("x"))
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("x").alias("own"))
    texts = zipped.compressed(rows)
    found = texts.join(wanted.hint("merge"), "doc_id").select("doc_id", "zipped", "own").mapInArrow(_bytes_of_chunks, "doc_id long, chunk long, line int, stays boolean, lines int, bytes binary")
    found = staged(found, "chunk-bytes")
    kept = found.filter("stays").select("chunk", F.col("bytes").alias("kept_bytes"), F.col("doc_id").alias("kept_doc"), (F.col("line") + F.col("lines")).alias("kept_end")).dropDuplicates(["chunk"])
    same = found.filter("not stays").join(kept, "chunk").filter("bytes = kept_bytes")
    begin = F.when(F.col("doc_id") == F.col("kept_doc"), F.greatest("line", "kept_end")).otherwise(F.col("line"))
    return same.select("doc_id", begin.alias("line"), (F.col("line") + F.col("lines") - begin).alias("lines")).distinct()


def _remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column("gone").to_pylist()
        n, removed, kept = [], [], []
        for i, blob in enumerate(batch.column("zipped")):
            text = zipped.unzip(blob.as_py())
            lines = text.split(b"\n") if text else []
            drop = {k for x in gone[i] or () for k in range(x["line"], x["line"] + x["lines"])}
            n.append(len(lines))
            removed.append(len(drop))
            kept.append(b"\n".join([x for k, x in enumerate(lines) if k not in drop]).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_removed", "kept_text"])


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text (the lines that stay, joined by ``\\n``) of each row."""
    gone = staged(repeated_chunks(docs), "chunk-repeats").groupBy("doc_id").agg(F.collect_list(F.struct("line", "lines")).alias("gone"))
    rows = zipped.compressed(docs).join(gone.hint("merge"), "doc_id", "left").select("doc_id", "zipped", "gone")
    return rows.mapInArrow(_remove, "doc_id long, n_lines long, n_removed long, kept_text string")
