"""Queries of this subpackage: each operator over its whole table, with the parameters for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satchel.llm import bpe, chat, common, langid, packing, quality, rans, simhash, suffix_dedup, token_count, topk


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(common.documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(common.documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(common.documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(common.documents(spark, sf_dir))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 searches all vectors."""
    return topk.top_k(common.documents(spark, sf_dir, "embeddings"), every=100)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(common.documents(spark, sf_dir, "conversations"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(common.documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir))


def op10_rans_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.compress(common.documents(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (op1_suffix_array_dedup, op2_byte_bpe, op3_token_counts, op4_packing, op5_language_id, op6_exact_top_k, op7_chat_format, op8_quality_rules, op9_simhash, op10_rans_blocks)
}
ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
with v as (select vec_id, cast(embedding as double[]) as v from embeddings),
pairs as (select a.vec_id, b.vec_id as neighbor_id, round(list_dot_product(a.v, b.v), 9) as s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
ranked as (select vec_id, neighbor_id, s, row_number() over (partition by vec_id order by s desc, neighbor_id) as rank from pairs)
select vec_id, cast(rank as int) as rank, neighbor_id, round(s, 6) as score from ranked where rank <= 10
""",
}
