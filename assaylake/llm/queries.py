"""One query for each numbered operator, over its whole table.

What each does with nulls, empty and long texts, ties, repeated rows, empty
tables and other columns is stated by the operator that it calls.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import bpe, conversation_repair, embedding_dup, language_id, near_dup, packing, repetition, secrets, sharding, substring_dedup, topk, url_filter, whitening
from assaylake.llm.common import documents, is_held_out, ship


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = is_held_out(F.col("doc_id"))
    model = language_id.train(docs, ~held_out)
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, keep_text=False)


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge(documents(spark, sf_dir))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"), every_length=True)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir), near_dup.OP5_PERCENT)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digest(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op7_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return topk.query(spark, sf_dir)


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir).select("doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return secrets.digest(docs, secrets.train(docs))


def op10_temporal_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(spark, sf_dir)


def op11_viterbi_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.query(spark, sf_dir)


def op12_compensated_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.query(spark, sf_dir)


def op13_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.query(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_suffix_repetition": op2_suffix_repetition,
        "op3_sentence_spans": op3_sentence_spans,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_chosen_path": op5_chosen_path,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_threshold_top_k": op7_threshold_top_k,
        "op8_histogram_sort": op8_histogram_sort,
        "op9_secret_scan": op9_secret_scan,
        "op10_temporal_url_filter": op10_temporal_url_filter,
        "op11_viterbi_repair": op11_viterbi_repair,
        "op12_compensated_whitening": op12_compensated_whitening,
        "op13_int8_tiles": op13_int8_tiles,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_threshold_top_k": topk.SQL,
        "op10_temporal_url_filter": url_filter.SQL,
        "op11_viterbi_repair": conversation_repair.SQL,
        "op13_int8_tiles": embedding_dup.SQL,
    }
