"""Quality rules: statistics of whole texts and a learned decision list over them.

Statistics are counted in one pass over the texts. A decision list is learnt from labelled
statistics by sequential covering: a rule, a conjunction of thresholds, is grown by
information gain on two thirds of the rows that no earlier rule covers, pruned on the rest
while that raises its precision, and kept while it is right more often than not; what it
covers is taken out and the next rule is grown. The list is emitted as one ordered Spark
conditional expression, so applying it needs no Python and no shuffle.

The fit uses a bounded sample: at most about ``sample_rows`` labelled documents, chosen by
a hash of doc_id. Statistics cover all documents and whole texts.

Defined results: a null text has no words, lines or symbols; a text without words fails the
base rules; with no labels, or labels of one kind only, the list is empty and keeps
everything that passes the base rules. A document with several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words
from tessera.llm.common import bound_batches, staged

SAMPLE_ROWS = 20_000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_CONTINUES = np.zeros(256, dtype=bool)
_CONTINUES[0x80:0xC0] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_distinct_words"]


def text_counts(block: words.Words) -> np.ndarray:
    """The counts of COUNTS for each text of a block: (texts, counts)."""
    n = len(block)
    row = block.row_of_word()
    word_bytes = block.end - block.start
    sums = lambda x: np.bincount(row, weights=x, minlength=n).astype(np.int64)
    per_byte = lambda flag: _between(flag[block.data], block.row_start[:-1], block.row_start[1:])
    continues = np.concatenate(([0], np.cumsum(_CONTINUES[block.data])))
    chars = word_bytes - (continues[block.end] - continues[block.start])
    hashes = block.hashes()

    repeated = np.zeros(len(row), dtype=np.int64)
    window, at = words.shingles(hashes, row, 3)
    if len(at):
        _, inverse, count = np.unique(window ^ words.mix(row[at].astype(np.uint64)), return_inverse=True, return_counts=True)
        for i in range(3):
            repeated[at[count[inverse] > 1] + i] = 1
    distinct = np.zeros(n, dtype=np.int64)
    if len(row):
        first_seen = np.unique(hashes ^ words.mix(row.astype(np.uint64)), return_index=True)[1]
        distinct = np.bincount(row[first_seen], minlength=n)
    lines, dup_lines = _lines(block)
    return np.stack([block.counts(), sums(chars), per_byte(_SYMBOL), dup_lines, sums(repeated), lines, per_byte(_DIGIT), distinct], axis=1)


def _between(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[b] - total[a]


def _lines(block: words.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of the same text."""
    lines, duplicates = np.zeros(len(block), dtype=np.int64), np.zeros(len(block), dtype=np.int64)
    for i in range(len(block)):
        if block.first[i + 1] == block.first[i]:
            continue
        own = [x for x in block.text(i).split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
        lines[i], duplicates[i] = len(own), len(own) - len(set(own))
    return lines, duplicates


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, block in words.blocks(batch.column("text")):
            counts = text_counts(block)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *[pa.array(x, pa.int64()) for x in counts.T]], ["doc_id", *COUNTS])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of COUNTS of each whole text."""
    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text")
    schema = rows.select("doc_id").schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    return rows.mapInArrow(_count, schema)


def _per(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def features() -> dict[str, Column]:
    """What rules may test, by name."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "n_lines": F.col("n_lines").cast("double"),
        "word_length": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "digits_per_word": _per("n_digits", "n_words"),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "repeat_share": _per("n_repeat_words", "n_words"),
        "distinct_share": _per("n_distinct_words", "n_words"),
        "words_per_line": _per("n_words", "n_lines"),
    }


@dataclass
class Rule:
    """Rows that meet all conditions (feature, is it <=, threshold) are rejected."""

    conditions: list[tuple[str, bool, float]] = field(default_factory=list)

    def covers(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, below, threshold in self.conditions:
            v = x[:, names.index(name)]
            out &= v <= threshold if below else v > threshold
        return out

    def column(self) -> Column:
        tests = [features()[n] <= t if below else features()[n] > t for n, below, t in self.conditions]
        return reduce(lambda a, b: a & b, tests)

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if below else '>'} {t:.6g}" for n, below, t in self.conditions)


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 16, max_conditions: int = 4, min_precision: float = 0.8) -> list[Rule]:
    """A decision list for ``bad`` rows, by sequential covering."""
    rules: list[Rule] = []
    left = np.ones(len(x), dtype=bool)
    part = np.arange(len(x)) % 3
    while len(rules) < max_rules and (left & bad).sum() >= max(5, 0.01 * bad.sum()):
        rule = _grow(x, bad, left & (part < 2), names, max_conditions)
        rule = _prune(rule, x, bad, left & (part == 2), names)
        covered = rule.covers(x, names) & left if rule.conditions else np.zeros(len(x), dtype=bool)
        if covered.sum() < 5 or bad[covered].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _grow(x: np.ndarray, bad: np.ndarray, rows: np.ndarray, names: list[str], most: int) -> Rule:
    rule = Rule()
    rows = rows.copy()
    while len(rule.conditions) < most and bad[rows].any() and not bad[rows].all():
        p, n = bad[rows].sum(), (~bad[rows]).sum()
        base, best = np.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(names):
            v = x[rows, k]
            for t in np.unique(np.quantile(v, np.linspace(0, 1, 65)[:-1])):
                for below in (True, False):
                    hit = v <= t if below else v > t
                    hp = (hit & bad[rows]).sum()
                    if hp and hit.sum() < len(v):
                        gain = hp * (np.log2(hp / hit.sum()) - base)
                        if gain > best[0]:
                            best = (gain, (name, below, float(t)))
        if best[1] is None:
            break
        rule.conditions.append(best[1])
        rows &= Rule([best[1]]).covers(x, names)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, rows: np.ndarray, names: list[str]) -> Rule:
    """Drop conditions from the end while (p - n) / (p + n) on the pruning rows doesn't fall."""

    def worth(r: Rule) -> float:
        hit = r.covers(x[rows], names)
        return (2 * bad[rows][hit].mean() - 1) if hit.any() else -1.0

    while len(rule.conditions) > 1 and worth(Rule(rule.conditions[:-1])) >= worth(rule):
        rule = Rule(rule.conditions[:-1])
    return rule


def fit(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules from the statistics of labelled documents (labels: doc_id, quality; 0 is bad)."""
    labels = labels.select("doc_id", "quality").filter("doc_id is not null and quality is not null")
    n = labels.count()
    if not n:
        return []
    draw = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / F.lit(1e6)
    sample = labels.filter(draw < min(1.0, sample_rows / n)).join(stats, "doc_id")
    names = list(features())
    found = sample.select("doc_id", "quality", *[c.alias(k) for k, c in features().items()]).toPandas().sort_values(["doc_id", "quality"])
    bad = found["quality"].to_numpy() == 0
    return learn(found[names].to_numpy(dtype=float), bad, names) if bad.any() and not bad.all() else []


def verdict(rules: list[Rule]) -> Column:
    """True where no rule of the list rejects; the first rule that holds decides."""
    if not rules:
        return F.lit(True)
    first, *rest = rules
    return reduce(lambda out, r: out.when(r.column(), F.lit(False)), rest, F.when(first.column(), F.lit(False))).otherwise(F.lit(True))


def base_failed() -> Column:
    """Too few words, or most words in windows that occur again in the same text."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics, base_failed and kept of each document, and the rules that were learnt."""
    stats = staged(statistics(docs), "quality-statistics")
    rules = fit(stats, labels)
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules)), rules
