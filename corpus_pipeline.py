"""The corpus pipeline: documents in, token ids' digests of the clean ones out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinderspark.llm import bpe_codec, decontamination, exact_dedup, simhash, toxicity
from cinderspark.llm.queries import vocab
from cinderspark.llm.runtime import table
from cinderspark.scratch import release, scratch_path, staged_paths


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents predicted toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of equal texts one stays."""
    return exact_dedup.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of each component of linked fingerprints one document stays."""
    return simhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that a benchmark item contaminates go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: ids of the documents that remain, and the texts they decode to, as digests."""
    return bpe_codec.digest_documents(docs, vocab("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("bpe_codec", encoded),
]

#: The nearest examples, fingerprints' hash and ids can't be had in SQL; tests/llm compares with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next.

    What a stage has staged for itself is deleted when its result is written, and so is its input.
    """
    docs = table(spark, sf_dir, "documents")
    before = staged_paths(spark)
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        release(spark, [*before, path])
    return STAGES[-1][1](spark, docs, sf_dir)
