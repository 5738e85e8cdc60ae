"""From raw documents to packed training sequences: toxicity, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import language, minhash, packing, toxicity
from tapewright.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; the classifier learns from the labels of ``docs``.

    Null and empty texts stay, very long ones are judged by all their words; repeated rows each stay or go; an empty table
    stays empty.
    """
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are text in one of the languages of ``docs``.

    Null, empty and letterless texts go; very long ones are scored whole; repeated rows each stay or go; an empty table
    stays empty.
    """
    return language.keep_language(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id.

    Rows with a null doc_id or text stay; of repeated rows one does; very long texts are compared by all their shingles; an
    empty table stays empty.
    """
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. Null and empty texts have their end alone, very long ones several pieces; an empty table gives none."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", keep_language), ("near_duplicates", drop_near_duplicates), ("packing", pack)]

#: Stages learn, hash and run BPE, which SQL can't express; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to the table that the one before wrote."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
