"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import best_two_fit, near_copies, ngram_ratio, template_tree
from plumbline.llm.common import table
from plumbline.session import scratch_path


# Documents that share this much with one earlier document, line by line, are left to near_duplicates.
SPARE_COPIES = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the n-gram ratio accept."""
    ratio = ngram_ratio.fit(docs, table(spark, sf_dir, "labels"))
    return ngram_ratio.judge(docs, ratio).where("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose template an earlier document holds; emptied ones stay, empty.

    Near copies of one earlier document stay whole: cut down to scraps, they would
    no longer be known as copies. What only they held before is dropped nowhere.
    """
    slim = template_tree.drop_recurring_lines(docs, SPARE_COPIES).select(*docs.columns)
    if "n_chars" in docs.columns:
        slim = slim.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return slim


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word runs, similarity of 0.8 or more.

    The trie of SimHash fingerprints tells the closest, minimum hashes those beyond
    its budget. Emptied documents are copies of each other.
    """
    return near_copies.keep_one(docs, exhaustive=True).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return best_two_fit.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", packing),
]

# Tokenisers, fingerprints and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
