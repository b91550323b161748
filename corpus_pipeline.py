"""Corpus pipeline: stages over documents, each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import _runtime, decontamination, ngram_jaccard, source_mixing, substring_dedup, toxicity

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard", ngram_jaccard.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontamination", decontamination.stage),
    ("source_mixing", source_mixing.stage),
]
#: No SQL: a trained model, shingle sets of whole texts and tiling are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`; what each returns is written and read again as the next one's input.

    A stage's tables go once its result is written, and that result once the next one is. Nulls in any column, repeated rows, empty
    tables and columns named like a stage's own go through as each stage's module says; a document without words is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with _runtime.scratch() as keep:
            after = keep(_runtime.written(stage(spark, docs, sf_dir), f"stage-{name}"))
        _runtime.drop(docs)
        docs = after
    return docs
