"""The subpackage's queries, by operator number."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import chat_formatting, decontamination, embedding_whitening, html_extraction, lm_scoring, mpeg_audio, ngram_jaccard, periodic_runs, source_mixing, substring_dedup, token_counts, toxicity, warc_shards

_MODULES = (source_mixing, token_counts, toxicity, lm_scoring, ngram_jaccard, decontamination, html_extraction, warc_shards, substring_dedup, mpeg_audio, periodic_runs, embedding_whitening, chat_formatting)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _MODULES for k, f in getattr(m, "ORACLE_SQL", {}).items()}
