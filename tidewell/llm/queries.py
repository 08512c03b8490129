"""The registered queries of the training-data operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunk_levels, context_tree, decontaminate, filter_audit, hard_negatives, langid, mixing, packed_ids, quality, simhash, substrings, warc
from .common import table, texts

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(texts(spark, sf_dir, "documents"), ["doc_id"]).drop("char_distance", "word_distance")


def op2_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
    return mixing.mix(docs, ["doc_id", "text_md5"]).select("doc_id", "source", "mix_block", "mix_slot", "mix_position", "mix_balanced")


def op3_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(texts(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op4_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "documents")
    return langid.predict_language(docs, langid.train(docs))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = texts(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select((F.col("id") * 0 - 1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_chats(chat.format_chats(turns.unionByName(extra), BYTE_TOKENIZER), BYTE_TOKENIZER).drop("n_tokens")


def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_levels.dedup_chunks(table(spark, sf_dir, "documents"))


def op7_substring_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(table(spark, sf_dir, "documents"), ["doc_id"])


def op8_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages"))).drop("url")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.read_packed(packed_ids.write_packed(table(spark, sf_dir, "documents"), WORD_TOKENIZER, END_ID))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(texts(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(texts(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_pfair_mixing, op3_simhash_anchors, op4_byte_cnn, op5_chat_format, op6_line_chunks, op7_substring_graph, op8_warc_writer, op9_decontamination, op10_packed_ids, op11_hard_negatives, op12_filter_audit, op13_context_tree]
    return {f.__name__: f for f in found}
