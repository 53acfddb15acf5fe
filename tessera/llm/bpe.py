"""BPE encoding and decoding with a pair occurrence index.

The distinct pretokens of a batch are laid out as one linked list of symbols. An index maps
each mergeable pair to all its positions in the batch; active ranks are taken in ascending
order from a heap, all positions of a pair are merged at once, and only the lists of the
pairs that arise next to them are updated. A merge can only give rise to pairs of later
ranks (checked when the vocabulary is read), so ascending ranks over the whole batch give
each pretoken what a loop over that pretoken alone gives.

Special tokens of the vocabulary file are cut out of a text first, as the tokenizers
library does by default; the rest is split into pretokens by the file's byte-level pattern,
which is applied to the kinds of all characters of a step at once (``_begins``).
Decoding joins the bytes of the tokens and replaces what isn't UTF-8.

Memory is bounded by bytes, not by rows. Texts are worked off in steps of STEP characters; a
longer text is cut before white space that follows a non-space, where a pretoken always ends.
New pretokens are encoded CHUNK bytes at a time, and what a worker remembers of earlier ones
is dropped beyond CACHE bytes. Only a single pretoken (a run without white space) is held
whole, whatever its length.

Defined results: a null text counts as empty and has no ids; every text is encoded whole, an
empty or very long one too. Rows may repeat, each has its own result; doc_id is passed through,
null or not. Extra columns are neither read nor returned; an empty table gives an empty
result. Nothing is shuffled.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from tessera.llm.common import bound_batches

#: The byte-level pretoken pattern (fixed value of the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text is cut into pieces of so many characters.
PIECE = 1 << 20
#: As many pieces are worked off together as have STEP characters; new pretokens of theirs are encoded CHUNK bytes at a time.
STEP, CHUNK = 2 << 20, 1 << 20
#: So many distinct pretokens are looked up together, and so many pairs.
WORDS, SLICE = 100_000, 1 << 17
#: Bytes, as far as they can be told, that a worker keeps of pretokens it has seen.
CACHE = 96 << 20
#: What an entry costs besides its bytes and ids: two objects and a place in the table.
_ENTRY = 180
#: Kinds of characters in the pattern; END stands for the end of a text.
OTHER, LETTER, NUMBER, BLANK, END = range(5)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def kinds() -> np.ndarray:
    """The kind of each code point."""
    kind = np.zeros(0x110000, dtype=np.uint8)
    everything = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for run in regex.finditer(pattern, everything):
            kind[run.start() : run.end()] = k
    return kind


class Vocabulary:
    """Tokens and merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        ids = file["model"]["vocab"]
        characters = byte_characters()
        self.bytes = {i: bytes(characters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = np.zeros(256, dtype=np.int32)
        for c, b in characters.items():
            self.of_byte[b] = ids[c]
        self.size = max(self.bytes) + 1
        self.decimal = pa.array([b",%d" % i for i in range(self.size)], pa.large_binary())
        self.own_bytes = pa.array([self.bytes.get(i, b"") for i in range(self.size)], pa.large_binary())
        self.kinds = kinds()
        merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
        left, right = (np.array([ids[m[k]] for m in merges], dtype=np.int64) for k in (0, 1))
        self.left, self.right, self.merged = left, right, np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        made = np.full(self.size, -1, dtype=np.int64)
        made[self.merged[::-1]] = np.arange(len(merges))[::-1]
        if not (np.maximum(made[left], made[right]) < np.arange(len(merges))).all():
            raise ValueError("a merge uses a token that only a later merge makes")
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks = (left * self.size + right)[order], order.astype(np.int32)
        self.cut_at = None if any(x.isspace() for t in self.special for x in t) else regex.compile(r"(?<=\S)\s")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or -1."""
        if len(left) > SLICE:
            return np.concatenate([self.rank(left[i : i + SLICE], right[i : i + SLICE]) for i in range(0, len(left), SLICE)])
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int32(-1))

    def encode_words(self, pretokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids (int32) of all pretokens in a row, and where each one's begin (and the end)."""
        n = np.array([len(w) for w in pretokens], dtype=np.int64)
        ends = np.cumsum(n)
        symbol = self.of_byte[np.frombuffer(b"".join(pretokens), dtype=np.uint8)]
        size = len(symbol)
        following, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size - 1, dtype=np.int32)
        following[ends[n > 0] - 1] = -1
        before[(ends - n)[n > 0]] = -1
        alive = np.ones(size, dtype=bool)

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        last = np.empty(size, dtype=np.int32)

        def distinct(at: np.ndarray) -> np.ndarray:
            place = np.arange(len(at), dtype=np.int32)
            last[at] = place
            return at[last[at] == place]

        def note(at: np.ndarray) -> None:
            """Enter the pairs that begin at these positions."""
            rank = self.rank(symbol[at], symbol[following[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            if len(at) > 1:
                order = np.argsort(rank, kind="stable")
                at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, own in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts) if len(cuts) else (at,), strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(heap, r)

        note(np.flatnonzero(following >= 0).astype(np.int32))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            a, b = self.left[r], self.right[r]
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            after = following[at]
            good = alive[at] & (symbol[at] == a) & (after >= 0)
            at, after = at[good], after[good]
            at = at[symbol[after] == b]
            if len(lists) > 1:
                at = distinct(at)
            if a == b and len(at) > 1:  # in a run of equal symbols every other pair counts, from the left
                at = np.sort(at)
                joined = at[1:] == following[at[:-1]]
                run = np.arange(len(at))
                heads = np.concatenate(([True], ~joined))
                at = at[(run - np.maximum.accumulate(np.where(heads, run, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbol[at] = self.merged[r]
            alive[gone] = False
            after = following[gone]
            following[at] = after
            before[after[after >= 0]] = at[after >= 0]
            left = before[at]
            touched = np.concatenate((left[left >= 0], at[after >= 0]))
            if len(touched):
                note(distinct(touched))
        starts = np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]
        return symbol[alive], starts

    def parts(self, text: str) -> list[str]:
        """The text, or its parts, between which a pretoken can't reach; special tokens are parts of their own."""
        if self.split is None or not any(s in text for s in self.special):
            return [text] if text else []
        return [x for x in self.split.split(text) if x]

    def pretokens(self, parts: list[str]) -> tuple[np.ndarray, pa.Array]:
        """Where the pretokens of these parts begin in their joined text, and their UTF-8."""
        text = "".join(parts)
        data = text.encode("utf-8", "replace")
        point = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
        ends = np.cumsum([len(x) for x in parts], dtype=np.int64)
        begins = _begins(point, self.kinds[point], ends)
        for x, end in zip(parts, ends.tolist(), strict=True):
            if x in self.special:
                begins[end - len(x) + 1 : end] = False
        at = np.flatnonzero(begins)
        if len(data) == len(point):
            offsets = np.append(at, len(data))
        else:
            width = (point > 0x7F).view(np.uint8) + (point > 0x7FF) + (point > 0xFFFF)
            offsets = np.append(at + np.cumsum(width, dtype=np.int64)[at] - width[at], len(data))
        return at, _binary(offsets, pa.py_buffer(data))

    def pieces(self, text: str, most: int = PIECE) -> Iterator[str]:
        """The text in pieces of ``most`` characters where it can be cut so; a piece without a
        place to cut is as long as it takes."""
        start = 0
        while len(text) - start > most and self.cut_at:
            cuts = self.cut_at.search(text, start + most - min(most, 4096) // 2)
            if not cuts:
                break
            yield text[start : cuts.start()]
            start = cuts.start()
        yield text[start:] if start else text

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _begins(point: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a pretoken of PATTERN begins at each character of parts that end at ``ends``, none of them empty."""
    if not len(point):
        return np.zeros(0, dtype=bool)
    before, behind = np.empty_like(kind), np.empty_like(kind)
    before[1:], behind[:-1] = kind[:-1], kind[1:]
    before[0] = before[ends[:-1]] = behind[ends - 1] = END
    begins = before != kind
    # a space belongs to what comes after it, and white space before that is a pretoken without its last character
    spaced = np.zeros_like(begins)
    spaced[1:] = point[:-1] == ord(" ")
    spaced[ends[:-1]] = False
    blank = kind == BLANK
    begins &= blank | ~spaced
    begins |= blank & (behind < BLANK)
    # 's, 't, 'm, 'd, 're, 've, 'll end after their letters, whatever comes then
    at = np.flatnonzero((point == ord("'")) & begins & (behind == LETTER))
    first, second = point[at + 1], point[np.minimum(at + 2, len(point) - 1)]
    two = (behind[at + 1] == LETTER) & (((second == ord("e")) & ((first == ord("r")) | (first == ord("v")))) | ((second == ord("l")) & (first == ord("l"))))
    one = np.isin(first, [ord(c) for c in "stmd"])
    begins[at[one | two] + 1] = False
    end = np.concatenate((at[one] + 2, at[two] + 3))
    begins[end[end < len(point)]] = True
    return begins


def _binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    """An array of ``large_binary`` over these buffers."""
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64, copy=False)), data])


def _offsets(array: pa.Array) -> np.ndarray:
    """Offsets of an array of ``large_binary`` that begins with its buffers."""
    return np.frombuffer(array.buffers()[1], dtype=np.int64)[: len(array) + 1]


class Encoder:
    """Encodes pieces of texts; keeps the ids (as the bytes of an int32 array) of the pretokens it has seen."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        """Start a generation; what the last one used is at hand still, what it didn't use is dropped."""
        self.before = getattr(self, "known", {})
        self.known = {s.encode(): np.int32(i).tobytes() for s, i in self.vocabulary.special.items()}
        self.held = 0

    def keep(self, word: bytes, ids: bytes) -> bytes:
        """Enter the ids of a pretoken."""
        self.held += _ENTRY + len(word) + len(ids)
        if 2 * self.held > CACHE:
            self.clear()
        self.known[word] = ids
        return ids

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pretokens in a row, and where each one's begin (and the end). They are learnt where they are new."""
        parts, sizes = [b""], [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(words), WORDS):
            found = self.find(words.slice(at, WORDS).to_pylist())
            parts.append(b"".join(found))
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2)
        return np.frombuffer(b"".join(parts), dtype=np.int32), np.cumsum(np.concatenate(sizes))

    def find(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these pretokens."""
        found = list(map(self.known.get, words))
        new, size = [], 0
        for i in [i for i, ids in enumerate(found) if ids is None]:
            w = words[i]
            if (ids := self.before.get(w)) is not None:
                found[i] = self.keep(w, ids)
                continue
            new.append(i)
            size += len(w)
            if size > CHUNK:
                self.learn(words, new, found)
                new, size = [], 0
        self.learn(words, new, found)
        return found

    def learn(self, words: list[bytes], new: list[int], found: list[bytes | None]) -> None:
        """Enter the ids of ``words`` at these places in ``found``."""
        if not new:
            return
        ids, starts = self.vocabulary.encode_words([words[i] for i in new])
        data, cuts = ids.tobytes(), (4 * starts).tolist()
        for i, a, b in zip(new, cuts, cuts[1:], strict=False):
            found[i] = self.keep(words[i], data[a:b])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Vocabulary(path))
    return _ENCODERS[path]


class _Step:
    """Some pieces of texts with their pretokens: ``rows`` the row of each piece, ``cuts`` where its pretokens begin
    (and the end), ``which`` the place of each pretoken among the distinct ones, ``ids`` and ``starts`` theirs."""

    def __init__(self, own: Encoder, held: list[tuple[int, str]]):
        self.rows = [row for row, _ in held]
        at, pretokens = own.vocabulary.pretokens([part for _, piece in held for part in own.vocabulary.parts(piece)])
        self.cuts = np.append(np.searchsorted(at, np.cumsum([0, *[len(piece) for _, piece in held]])[:-1]), len(at))
        distinct = pretokens.dictionary_encode()
        del pretokens
        self.which = distinct.indices.to_numpy()
        self.ids, self.starts = own.ids(distinct.dictionary)

    def counts(self) -> np.ndarray:
        """Number of ids before each piece (and the end)."""
        return np.concatenate(([0], np.cumsum(np.diff(self.starts)[self.which])))[self.cuts]

    def joined(self, tokens: pa.Array) -> tuple[memoryview, list[int]]:
        """What ``tokens`` has for all ids in a row, and where each piece's begins (and the end)."""
        if not len(self.which):
            return memoryview(b""), [0] * len(self.cuts)
        own = tokens.take(pa.array(self.ids))
        words = _binary(_offsets(own)[self.starts], own.buffers()[2] or pa.py_buffer(b""))
        out = words.take(pa.array(self.which))
        return memoryview(out.buffers()[2] or b""), _offsets(out)[self.cuts].tolist()


def _coded(column: pa.Array, own: Encoder) -> Iterator[_Step]:
    """Steps over all texts in order; a row has several pieces where its text is cut, and one at least."""
    held, size = [], 0
    for row, text in enumerate(column):
        for piece in own.vocabulary.pieces(text.as_py() or ""):
            if held and size + len(piece) > STEP:
                yield _Step(own, held)
                held, size = [], 0
            held.append((row, piece))
            size += len(piece)
    if held:
        yield _Step(own, held)


def _steps(column: pa.Array, own: Encoder) -> Iterator[tuple[int, np.ndarray]]:
    """(row, places of the pretokens among the distinct ones of the step) of each piece."""
    for step in _coded(column, own):
        yield from zip(step.rows, np.split(step.which, step.cuts[1:-1]), strict=True)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of each whole text."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            flat, n = [np.zeros(0, dtype=np.int32)], np.zeros(len(batch), dtype=np.int32)
            for step in _coded(batch.column("text"), own):
                np.add.at(n, step.rows, np.diff(step.counts()).astype(np.int32))
                each = np.diff(step.starts)[step.which]
                first = step.starts[step.which] - (np.cumsum(each) - each)
                flat.append(step.ids[np.repeat(first, each) + np.arange(each.sum())])
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(x.as_py() or ()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    bound_batches(encoded.sparkSession)
    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("text", "string"))


class _Digest:
    """Digests of one text's ids and of the text decoded from them, a piece at a time."""

    def __init__(self) -> None:
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()
        self.decoder = codecs.getincrementaldecoder("utf-8")("replace")

    def add(self, n: int, ids: memoryview, own_bytes: memoryview) -> None:
        """``n`` ids as decimal text, each after a comma, and their bytes."""
        if n:
            self.ids.update(ids if self.n else ids[1:])
            self.n += n
            self.text.update(self.decoder.decode(own_bytes).encode())

    def close(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.decode(b"", True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, in one
    pass: ids are digested where they are made instead of being sent through Spark twice."""
    path = path or default_vocabulary()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            found, last, digest = [], 0, _Digest()
            for step in _coded(batch.column("text"), own):
                counts = np.diff(step.counts()).tolist()
                ids, cuts = step.joined(own.vocabulary.decimal)
                text, ends = step.joined(own.vocabulary.own_bytes)
                for k, row in enumerate(step.rows):
                    if row != last:
                        found.append(digest.close())
                        last, digest = row, _Digest()
                    digest.add(counts[k], ids[cuts[k] : cuts[k + 1]], text[ends[k] : ends[k + 1]])
            if len(batch):
                found.append(digest.close())
            n, ids_sha, text_sha = zip(*found, strict=True) if found else ((), (), ())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string"))
