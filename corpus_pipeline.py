"""The corpus pipeline: language ID, quality rules, near-duplicate removal, removal of repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs; all but the last return docs' columns. Between stages the
rows are written as Parquet to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.llm import common, langid, packing, quality, simhash, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose declared language is all but excluded, go. See langid.identify for nulls, empty and
    long texts, ties and repeated rows; extra columns stay."""
    return langid.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Robust outliers of their language and source go, and texts without words. See quality.assess; extra columns stay."""
    return quality.keep_usual(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id. See simhash.keep_one; extra columns stay."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; a document of which nothing is left goes. See suffix_dedup.without_repeats;
    extra columns stay."""
    return suffix_dedup.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of lengths that are powers of two. See packing.pack; the result has its columns alone."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("packing", pack)]

#: SQL can't express the first stage (a trained classifier) nor the last (a tokenizer): tests/llm compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = common.scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
