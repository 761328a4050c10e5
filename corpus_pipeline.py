"""Documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pointframe.llm import langid, mixing, neardup, packing, quality
from pointframe.llm.common import arrow_bytes, forget, store
from pointframe.llm.queries import table, tokenizer_path

#: No stage is expressible in SQL; tests/llm compares them with brute force.
ORACLE_SQL: str | None = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the isolation forest."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; undetermined ones go."""
    return langid.keep_identified(docs, langid.fit(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8)."""
    return neardup.keep_one(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path(), size=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("mix_sources", mixing_stage),
    ("pack_sequences", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a row a packed piece.

    Null texts go in the first stage; null ids, null sources and repeated rows are rows
    like others; an empty table gives no rows. The last stage stores its pieces, after which the stages' own
    tables are deleted.
    """
    docs = table(spark, sf_dir, "documents")
    made = []
    with arrow_bytes(spark):  # whole texts in small batches, in every stage
        for name, stage in STAGES[:-1]:
            docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
            made.append(docs)
        out = STAGES[-1][1](spark, docs, sf_dir)
    forget(*made)
    return out
