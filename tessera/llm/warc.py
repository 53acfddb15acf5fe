"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing: one record per page. Of equal payloads of REVISIT_BYTES or more the smallest
page_id is written as a response; the others are revisit records without a block, which
name the response they refer to. A record is one row of a text file whose line separator
is the blank line that ends a WARC record, so writing needs no Python.

Reading: files are split at the magic ``WARC/1.0``, wherever it stands, by Spark's text
source; tasks emit a candidate record for each and its successor's offset (header, content
length, blank line). Offsets within a split are summed up in the task; the split's own
offset is the sum of the splits before it. Pointer jumping from the start of each file marks
the candidates that the chain of successors reaches, on narrow rows of numbers: first each
segment of SEGMENT bytes jumps by itself to where its chains leave it, then joins that
double the length of the jump find the places where the chain from offset 0 enters a
segment, and from these the segment's records are marked. Magic inside a payload starts a
candidate that nothing reaches. A payload that holds magic spans several pieces; only such
payloads are read a second time and put together.

Defined results: a null html is an empty payload; a null url gives no target; a null
page_id is always a response without an identifier. Rows that share page_id and payload are
written as they are, all of the same type; rows that share a page_id but not the payload are
records of their own, and a revisit is told by page_id and digest. A file without a record,
or whose first bytes are no record, gives no rows; what follows a broken record isn't
reached. Empty tables give empty results; extra columns of ``pages`` are neither read nor
written, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bound_batches, discard, looked_up, staged

MAGIC = "WARC/1.0\r\n"
BLANK = "\r\n\r\n"
REVISIT_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a file, as a power of two, whose candidates are chained within one task.
SEGMENT = 26


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null; line breaks in it become spaces."""
    value = F.regexp_replace(value.cast("string"), "[\\r\\n]+", " ")
    return F.coalesce(F.concat(F.lit(name + ": "), value, F.lit("\r\n")), F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def write_archives(pages: DataFrame, path: str, codec: str = "gzip") -> None:
    """Write a record for each of ``pages`` (page_id, url, html) to WARC files below ``path``."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).alias("n"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    large = rows.filter(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    rows = looked_up(rows, staged(large.select("digest", "first"), "copies"), "digest")
    again = (F.col("n") >= REVISIT_BYTES) & (F.col("page_id") != F.col("first"))
    again = F.coalesce(again, F.lit(False))
    record = F.concat(
        F.lit(MAGIC),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response"), F.lit("\r\n")),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("first")))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.lit("Content-Type: text/html\r\n"),
        F.concat(F.lit("Content-Length: "), F.when(again, 0).otherwise(F.col("n")).cast("string"), F.lit(BLANK)),
        F.when(again, "").otherwise(F.col("payload")),
    )
    rows.select(record.alias("value")).write.option("lineSep", BLANK).option("compression", codec).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block and value of what stands between two magics, in the order of the file within a task."""
    bound_batches(spark)
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def parse_header(piece: bytes) -> tuple[dict[str, str] | None, int, int]:
    """Fields (names in lower case), bytes of the header and content length of a piece; None where it is no record."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None, 0, 0
    fields = {}
    for line in piece[:end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            return None, 0, 0
        fields.setdefault(name.lower(), value.strip())
    length = fields.get("content-length", "")
    if "warc-type" not in fields or not length.isascii() or not length.isdigit():
        return None, 0, 0
    return fields, end + 4, int(length)


_CANDIDATE = "file string, block long, at long, size long, header int, length long, fields map<string,string>, digest string, payload binary"


def _candidates(batches: Iterable[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    """A row for each piece: ``at`` is where it starts within its split, behind the magic."""
    split, at = None, 0
    for batch in batches:
        rows = []
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            if (file, block) != split:
                split, at = (file, block), 0
            piece = value.as_py() or b""
            fields, header, length = parse_header(piece)
            payload = piece[header : header + length]
            whole = fields is not None and len(payload) == length
            rows.append((file, block, at, len(piece), header, length, list(fields.items()) if fields is not None else None, hashlib.sha256(payload).hexdigest() if whole else None, payload if whole and with_payload else None))
            at += len(piece) + len(MAGIC)
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in _CANDIDATE.split(", ")])


def _segments(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The rows of each (file, segment), as far as the batches hold them."""
    table = pa.Table.from_batches(batches).combine_chunks()
    file, segment = (table.column(c).to_numpy() for c in ("file", "segment"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(segment) != 0)) + 1
    bounds = [0, *cuts.tolist(), len(table)]
    return [table.slice(a, b - a).combine_chunks().to_batches()[0] for a, b in zip(bounds, bounds[1:], strict=False)]


def _local(batches: Iterable[pa.RecordBatch], work: Callable[[dict[str, np.ndarray]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work(columns)`` on the rows of each (file, segment), which come together and in order of ``at``."""
    key = lambda b, i: (b.column("file")[i].as_py(), b.column("segment")[i].as_py())
    run = lambda b: work({c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names})
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if key(batch, batch.num_rows - 1) != key(held[0], 0):
                *whole, rest = _segments(held)
                yield from map(run, whole)
                held = [rest]
    if held:
        yield from map(run, _segments(held))


def _jump(at: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each candidate's successor among ``at``, or its own where it leaves; and whether it leaves."""
    place = np.minimum(np.searchsorted(at, following), len(at) - 1)
    leaves = at[place] != following
    return np.where(leaves, np.arange(len(at)), place), leaves


def _exits(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Where the chain from each candidate leaves the segment, by pointer jumping."""
    at, following = columns["at"], columns["next"]
    to, _ = _jump(at, following)
    while True:
        beyond = to[to]
        if (beyond == to).all():
            break
        to = beyond
    return pa.RecordBatch.from_arrays([pa.array(columns["file"]), pa.array(at), pa.array(following[to])], ["file", "at", "next"])


def _marked(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """The candidates that a chain from one of the segment's entries reaches, by pointer jumping."""
    at, on = columns["at"], columns["entry"].astype(bool)
    to, _ = _jump(at, columns["next"])
    while True:
        more = on.copy()
        more[to[on]] = True
        beyond = to[to]
        if (more == on).all() and (beyond == to).all():
            break
        on, to = more, beyond
    return pa.RecordBatch.from_arrays([pa.array(columns["file"][on]), pa.array(at[on])], ["file", "at"])


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, at, next; numbers) that the chain from offset 0 reaches, by pointer jumping."""
    segment = lambda c: F.shiftright(F.col(c), SEGMENT)
    nodes = candidates.withColumn("segment", segment("at")).repartition("file", "segment").sortWithinPartitions("file", "segment", "at")
    nodes = staged(nodes, "chain")
    bound_batches(nodes.sparkSession)
    dealt = lambda x: x.repartition("file", "segment").sortWithinPartitions("file", "segment", "at")
    exits = dealt(nodes.select("file", "segment", "at", "next")).mapInArrow(lambda b: _local(b, _exits), "file long, at long, next long")
    doors = nodes.filter(segment("next") != F.col("segment")).select("file", F.col("next").alias("at")).distinct()
    doors = doors.unionByName(nodes.filter("at = 0").select("file", "at")).distinct()
    entries = staged(exits.join(doors, ["file", "at"], "left_semi").select("file", "at", "next", (F.col("at") == 0).alias("entry")), "entries")
    while True:  # each round marks what the marked reach in one jump, and doubles the jump
        hit = entries.filter("entry").select("file", F.col("next").alias("at")).distinct().withColumn("hit", F.lit(True))
        jump = entries.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        following = entries.join(hit, ["file", "at"], "left").join(jump, ["file", "next"], "left")
        following = following.select("file", "at", F.coalesce("beyond", "next").alias("next"), F.coalesce(F.col("entry") | F.col("hit"), "entry").alias("entry"), F.col("beyond").isNotNull().alias("goes"))
        following = staged(following, "entries")
        discard(entries)
        entries = following
        if following.filter("goes").isEmpty():
            break
    flagged = nodes.join(entries.filter("entry").select("file", "at", "entry"), ["file", "at"], "left")
    flagged = dealt(flagged.select("file", "segment", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry")))
    return flagged.mapInArrow(lambda b: _local(b, _marked), "file long, at long")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """file, start (offset), fields, length, digest and, if asked for, payload of each record below ``path``."""
    pieces = _pieces(spark, path).mapInArrow(lambda x: _candidates(x, with_payload), _CANDIDATE)
    pieces = staged(pieces.select(F.xxhash64("file").alias("id"), "*"), "pieces")
    splits = pieces.groupBy("id", "file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    splits = staged(splits, "splits")
    if not splits.groupBy("id").agg(F.min("file").alias("a"), F.max("file").alias("b")).filter("a <> b").isEmpty():
        raise ValueError("two files have the same number: read them apart")
    before = F.sum("total").over(Window.partitionBy("id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = staged(splits.select("id", "block", F.coalesce(before, F.lit(0)).alias("base")), "bases")
    pieces = looked_up(pieces, splits, "id", "block").withColumn("start", F.col("at") + F.col("base") - len(MAGIC))
    records = pieces.filter("fields is not null and start >= 0")
    after = F.col("start") + len(MAGIC) + F.col("header") + F.col("length") + len(BLANK)
    chain = staged(reachable(records.select(F.col("id").alias("file"), F.col("start").alias("at"), after.alias("next"))), "reached")
    records = records.join(chain.select(F.col("file").alias("id"), F.col("at").alias("start")), ["id", "start"])
    whole = records.filter("digest is not null").select("file", "start", "fields", "length", "digest", "payload")
    broken = staged(records.filter("digest is null").select("id", "file", "start", "fields", "header", "length"), "spanning")
    if broken.isEmpty():
        return whole
    return whole.unionByName(_put_together(spark, path, pieces, broken, with_payload))


def _put_together(spark: SparkSession, path: str, pieces: DataFrame, broken: DataFrame, with_payload: bool) -> DataFrame:
    """Payloads that hold magic: each one's pieces are read again and joined. Payloads don't
    overlap, so a piece meets its owner in the segment where it starts."""
    segment = lambda c: F.shiftright(c, SEGMENT)
    until = F.col("start") + len(MAGIC) + F.col("header") + F.col("length")
    owners = broken.select("id", F.col("start").alias("owner"), until.alias("until"))
    owners = owners.withColumn("segment", F.explode(F.sequence(segment(F.col("owner")), segment(F.col("until")))))
    wanted = pieces.select("id", "block", "at", "start", segment(F.col("start")).alias("segment")).join(owners, ["id", "segment"]).filter("start >= owner and start < until")
    again = _pieces(spark, path).mapInArrow(_numbered, "file string, block long, at long, value binary").withColumn("id", F.xxhash64("file"))
    magic = "".join(f"{x:02X}" for x in MAGIC.encode())
    parts = again.join(wanted.select("id", "block", "at", "owner", "start"), ["id", "block", "at"]).groupBy("id", "owner").agg(F.expr(f"listagg(value, X'{magic}') WITHIN GROUP (ORDER BY start)").alias("bytes"))
    full = broken.withColumnRenamed("start", "owner").join(parts, ["id", "owner"])
    payload = F.substring(F.col("bytes"), F.col("header") + 1, F.col("length").cast("int"))
    full = full.withColumn("payload", payload).filter(F.length("payload") == F.col("length"))
    return full.select("file", F.col("owner").alias("start"), "fields", "length", F.sha2("payload", 256).alias("digest"), F.when(F.lit(with_payload), F.col("payload")).alias("payload"))


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, at = None, 0
    for batch in batches:
        places = []
        for file, block, value in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("value"), strict=True):
            if (file, block) != split:
                split, at = (file, block), 0
            places.append(at)
            at += len(value.as_py() or b"") + len(MAGIC)
        yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(places, pa.int64()), batch.column("value")], ["file", "block", "at", "value"])


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that
    :func:`write_archives` wrote; a revisit has its own digest and the size of the response
    of that page_id and digest, which it refers to."""
    number = lambda name: F.regexp_extract(F.col("fields")[name], "^<urn:page:(-?\\d+)>$", 1).try_cast("long")
    again = F.col("fields")["warc-type"] == "revisit"
    named = F.regexp_extract(F.col("fields")["warc-payload-digest"], "^sha256:([0-9a-f]{64})$", 1)
    rows = records.select(number("warc-record-id").alias("page_id"), F.col("length").alias("payload_bytes"), F.when(again, named).otherwise(F.col("digest")).alias("payload_digest"), F.col("fields")["warc-type"].alias("record_type"), number("warc-refers-to").alias("refers_to"))
    rows = staged(rows, "pages")
    named = rows.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    first = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("full_bytes"))
    first = first.join(named, ["refers_to", "payload_digest"], "left_semi").distinct()
    full = rows.join(first, ["refers_to", "payload_digest"], "left")
    return full.select("page_id", F.when(F.col("record_type") == "revisit", F.col("full_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
