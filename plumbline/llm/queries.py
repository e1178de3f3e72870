"""One registered query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    backoff_lm,
    best_two_fit,
    byte_bpe,
    capture_index,
    filter_audit,
    hamming_trie,
    link_trust,
    ngram_ratio,
    preference_format,
    source_audit,
    suffix_repeats,
    template_tree,
    vertical_topk,
)
from plumbline.llm.common import table
from plumbline.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


@query("op1_preference_format", preference_format.SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    pairs = preference_format.preference_pairs(table(spark, folder, "conversations"))
    masks = {c: preference_format.mask_text(c) for c in ("chosen_mask", "rejected_mask")}
    return preference_format.format_pairs(pairs).withColumns(masks)


@query("op2_backoff_lm")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return backoff_lm.score_documents(table(spark, folder, "documents"))


@query("op3_best_two_fit")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return best_two_fit.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


@query("op4_hamming_trie")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = hamming_trie.near_duplicates(table(spark, folder, "documents"))
    hexadecimal = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", hexadecimal.alias("fingerprint"), "component_id")


@query("op5_link_trust", link_trust.SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return link_trust.judge(table(spark, folder, "pages"))


@query("op6_capture_index", capture_index.SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return capture_index.archive_and_read(table(spark, folder, "pages"))


@query("op7_vertical_topk", vertical_topk.SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return vertical_topk.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_ids=False).drop("text")


@query("op9_template_tree", template_tree.SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return template_tree.drop_recurring_lines(docs).select(
        "doc_id", "n_lines", "dropped_lines", F.md5("text").alias("text_md5")
    )


@query("op10_ngram_ratio")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ratio = ngram_ratio.fit(docs, table(spark, folder, "labels"))
    return ngram_ratio.judge(docs, ratio).drop("text")


@query("op11_suffix_repeats")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_repeats.digest(suffix_repeats.remove_repeats(table(spark, folder, "documents"), with_text=False))


@query("op12_filter_audit", filter_audit.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_source_audit", source_audit.SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.divergences(table(spark, folder, "documents"))
