"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

1. language ID keeps documents that have a letter and a language;
2. exact dedup keeps one row of equal texts;
3. MinHash near-dedup keeps one document of each group of near copies, at a similarity of 0.8
   or more on five-word shingles;
4. mixing repeats or leaves out documents so that sources come near their target weights;
5. BPE encodes what is left and decodes it again.

All stages but the last return the columns of their input. Stages 1, 3 and 5 have no SQL,
so there is no oracle; ``tests/llm`` holds the result against a brute-force version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, lang_id, mixing, near_dedup
from tessera.llm.common import fresh_path

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
    docs = docs if docs is not None else spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lang_id.language_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, shingle=SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("encode", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
