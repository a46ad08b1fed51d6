"""A training corpus from ``documents``: five stages, each a function of (spark, docs, sf_dir).

Each stage's result is written and read again before the next, so a lost executor costs
one stage's tasks at most, and no stage computes an earlier one anew.  All stages but the last
return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import decontamination, jaccard_join, packing, quality_rules, secret_scan
from skein.llm.common import discard, scratch, store


def _rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy rejects go.

    Null, empty and very short texts are among them; equal rows are judged alike and all stay or go.
    Columns of any name come through as they were; an empty table stays empty.
    """
    return quality_rules.apply_policy(docs)


def _unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link by n-gram Jaccard similarity, directly or through others, the smallest doc_id stays.

    A null doc_id comes last; of rows with the same doc_id and text one stays, and texts that are
    null or without words link with nothing and stay.
    """
    return jaccard_join.keep_first(docs)


def _clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go.

    A document without words is not contaminated; rows with one doc_id are judged each by its own
    text; without items all stay.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked; every row stays, null texts as null, and ``n_chars`` is counted anew."""
    return secret_scan.redact(docs)


def _packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is its end id alone, equal rows are packed each, an empty table gives no pieces."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", _rules),
    ("ngram_jaccard", _unlike),
    ("decontamination", _clean),
    ("secret_scans", _masked),
    ("packing", _packed),
]

#: Column generation and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage made for itself goes when its result is stored, and that when the next one's is."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            made = keep(store(stage(spark, docs, sf_dir), name))
        discard(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
