"""The corpus pipeline: classify, drop exact copies, drop near copies, decontaminate, mix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.llm.common import stored, table, without
from rasterloom.llm.decontaminate import contamination
from rasterloom.llm.exact_dedup import drop_copies
from rasterloom.llm.mixing import mix
from rasterloom.llm.quality import score_documents
from rasterloom.llm.simhash import drop_near_copies


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject, with all their columns.

    Null and empty texts are scored as empty ones; very long texts whole. Rows that repeat doc_id and text go or stay
    together. A score of just the threshold (a tie) stays; without usable labels all do. An empty table gives none.
    """
    scored = score_documents(docs, table(spark, sf_dir, "labels"))
    return without(docs, stored(scored.where("predicted = 0").select("k1", "k2"), "rejected"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id, with all its columns.

    A null text is equal to an empty one; very long texts are compared whole. A null doc_id stays only where all of the
    group are null. Of rows that repeat doc_id and text, or tie in doc_id, one stays. An empty table gives none.
    """
    return drop_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id, with all its columns.

    Null and empty texts have fingerprint zero and are one group; very long texts are read whole. A null doc_id stays
    only where all of the group are null. Of rows that repeat or tie in doc_id one stays. An empty table gives none.
    """
    return drop_near_copies(docs)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, with all their columns.

    Null and empty texts have no words and stay; very long texts are searched whole. Rows that repeat doc_id and text go
    or stay together, so ties don't arise. Without items all stay; an empty table gives none.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, stored(found.where("contaminated").select("k1", "k2"), "contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: (doc_id, size, source, source_size, target, taken), each document with the words taken of it.

    A null text has size 0 and nothing taken; a null source is a source of its own, and a null doc_id is drawn like any
    other. Very long texts count whole. Ties go by doc_id, then by the text; rows that repeat take turns. Other columns
    are dropped; an empty table gives none.
    """
    return mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("exact dedup", keep_distinct),
    ("simhash near-dedup", keep_unlike),
    ("benchmark decontamination", keep_clean),
    ("mixing sources", mix_sources),
]
#: The classifier and SimHash can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
