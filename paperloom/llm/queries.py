"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracle


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import repeated_words

    return repeated_words(_table(spark, sf_dir, "documents")).drop("kept_text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_personal_data

    return find_personal_data(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=2, threshold=80)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_file_round_trip

    return token_file_round_trip(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_inner_products

    return top_inner_products(integer_vectors(_table(spark, sf_dir, "embeddings")), "vec_id % 20 = 0")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(_table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import conversation_trie

    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import encoded_digests

    return encoded_digests(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_groups

    return spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_decontaminate, op3_pii, op4_packing, op5_near_dup, op6_warc, op7_token_files, op8_topk, op9_url_filter, op10_quality, op11_prefix_trie, op12_bpe, op13_spelling)}

#: SQL can't express the tokenizers' ids (4, 7, 12), the field (3) and the classifier (10).
ORACLE: dict[str, str] = {
    "op1_substring_dedup": oracle.OP1,
    "op2_decontaminate": oracle.OP2,
    "op5_near_dup": oracle.OP5,
    "op6_warc": oracle.OP6,
    "op8_topk": oracle.OP8,
    "op9_url_filter": oracle.OP9,
    "op11_prefix_trie": oracle.OP11,
    "op13_spelling": oracle.OP13,
}
