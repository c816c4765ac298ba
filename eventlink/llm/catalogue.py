"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlink.llm import (
    bit_search,
    byte_repeats,
    chat_format,
    merkle,
    near_dup,
    packing,
    personal_data,
    pieces,
    quality_rules,
    spelling,
    suffix_tree,
    warc,
    word_repeats,
)
from eventlink.llm.common import table


def op1_bit_search(spark: SparkSession, folder: str) -> DataFrame:
    return bit_search.neighbours(table(spark, folder, "embeddings"))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer, with_ids=False).drop("ids")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_byte_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return byte_repeats.remove_repeats(table(spark, folder, "documents"))


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.detect(table(spark, folder, "documents"))


def op7_word_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return word_repeats.remove_repeats(table(spark, folder, "documents"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.group_near_duplicates(table(spark, folder, "documents"))


def op9_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, folder, "documents"))


def op10_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        said.alias("text"),
    )
    return chat_format.digests(chat_format.format_chat(turns.unionByName(extra)))


def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


def op12_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verify(table(spark, folder, "documents"))


def op13_archives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bit_search": op1_bit_search,
        "op2_packing": op2_packing,
        "op3_quality_rules": op3_quality_rules,
        "op4_pieces": op4_pieces,
        "op5_byte_repeats": op5_byte_repeats,
        "op6_personal_data": op6_personal_data,
        "op7_word_repeats": op7_word_repeats,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_suffix_tree": op9_suffix_tree,
        "op10_chat_format": op10_chat_format,
        "op11_spelling": op11_spelling,
        "op12_manifest": op12_manifest,
        "op13_archives": op13_archives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.SQL,
        "op7_word_repeats": word_repeats.SQL,
        "op10_chat_format": chat_format.SQL,
        "op11_spelling": spelling.SQL,
        "op12_manifest": merkle.SQL,
        "op13_archives": warc.SQL,
    }
