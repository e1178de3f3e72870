"""Readers and writers: JSON lines, labelled CSV, saved tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.joins import join_reviews_meta
from plumbline.operators.labels import real_label
from plumbline.operators.sampling import sample_rows as take_sample
from plumbline.schema import EXTRA_TYPES, REVIEW_COLUMNS
from plumbline.sources.normalizers import edition, select_unified, unified

_REVIEW_FILE = re.compile(r"^(?!meta_)(?P<category>.+)\.jsonl(?:\.gz)?$")
_PATH_CATEGORY = r"/(?:meta_)?([^/]+?)\.jsonl(?:\.gz)?(?:/|$)"


def list_files(spark: SparkSession, folder: str) -> dict[str, str]:
    """File name to full path for one folder of any file system Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName(): s.getPath().toString() for s in fs.listStatus(path)}


def discover_categories(spark: SparkSession, raw_dir: str) -> list[str]:
    matches = (_REVIEW_FILE.match(name) for name in list_files(spark, raw_dir))
    return sorted({m["category"] for m in matches if m})


def resolve_file(files: dict[str, str], name: str) -> str | None:
    """The plain file where there is one, else its gzipped form, else nothing."""
    return files.get(name) or files.get(f"{name}.gz")


def scan_jsonl(spark: SparkSession, paths: list[str], layout: str) -> DataFrame:
    """JSON lines with a given layout, plain or gzipped, plus the category of the file.

    A path may also be a folder of part files. ``line_order`` grows with the
    position in a file. A gzipped file cannot be split and is read by one task;
    repartition afterwards where files are large.
    """
    category = F.regexp_extract("_metadata.file_path", _PATH_CATEGORY, 1)
    return spark.read.schema(layout).json(paths).select(
        "*",
        category.alias("file_category"),
        F.struct(
            F.col("_metadata.file_name").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("line_order"),
    )


def load_categories(
    spark: SparkSession,
    raw_dir: str,
    categories: list[str] | None = None,
    edition_name: str = "amazon_reviews_2023",
    sample_rows: int | None = None,
    seed: int = 42,
    strict: bool = False,
) -> DataFrame:
    """Reviews of several categories with their metadata, read in one scan each.

    A category without a review file is skipped, or is an error when ``strict``.
    Sampling happens before the join, which keeps every review row.
    """
    review_layout, normalize, meta_layout, normalize_meta = edition(edition_name)
    files = list_files(spark, raw_dir)
    wanted = categories or discover_categories(spark, raw_dir)
    paths = {c: resolve_file(files, f"{c}.jsonl") for c in wanted}
    absent = [c for c, path in paths.items() if path is None]
    found = [path for path in paths.values() if path]
    if not found or (strict and absent):
        raise FileNotFoundError(f"no review file for {absent or wanted} in {raw_dir}")
    raw = scan_jsonl(spark, found, review_layout)
    reviews = normalize(raw, F.col("file_category"))
    if sample_rows:
        reviews = take_sample(reviews, "review_id", sample_rows, seed, ["product_category"])
    meta_paths = [resolve_file(files, f"meta_{c}.jsonl") for c, path in paths.items() if path]
    meta_paths = [path for path in meta_paths if path]
    if not meta_paths:
        return reviews.withColumn("product_title", F.lit(""))
    meta = normalize_meta(
        scan_jsonl(spark, meta_paths, meta_layout), "file_category", "line_order"
    ).withColumnRenamed("file_category", "product_category")
    joined = join_reviews_meta(
        reviews, meta, F.col("line_order"), keys=("product_category", "product_id")
    )
    return select_unified(joined)


def load_category(spark: SparkSession, raw_dir: str, category: str, **options) -> DataFrame:
    return load_categories(spark, raw_dir, [category], strict=True, **options)


def union_sources(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns a table lacks are null."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


# Columns of the labelled file that are used, and their unified names.
LABELLED_LAYOUT = """
    asin string, review_id string, reviewer_id string, review_title string,
    review_text string, review_rating double, review_date string, product_title string,
    number_of_helpful double, fake_review_product string, reviewer_classified_fake string,
    reviewer_classified_honest string, reviewer_labeled_fake double,
    reviewer_labeled_honest double, review_is_removed_by_amazon double,
    fake_review_campaign_start_date string
"""
LABELLED_TO_UNIFIED = {
    "review_id": "review_id",
    "asin": "product_id",
    "reviewer_id": "reviewer_id",
    "review_rating": "rating",
    "review_title": "review_title",
    "review_text": "review_text",
    "review_date": "review_date",
    "number_of_helpful": "helpful_votes",
    "product_title": "product_title",
}


def scan_groundtruth(spark: SparkSession, path: str) -> DataFrame:
    """The labelled CSV, used columns only, taken by name from the header.

    The file is scanned as text columns and cast, so the column order of the
    file does not matter and bad numbers become null.
    """
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    fields = [f.strip().rsplit(" ", 1) for f in LABELLED_LAYOUT.split(",")]
    return raw.select(*[F.col(name).try_cast(kind).alias(name) for name, kind in fields])


def normalize_groundtruth(df: DataFrame, strategy: str = "primary") -> DataFrame:
    """Unified columns plus ``is_fake``; what this file lacks is null or constant."""
    columns = {new: F.col(old) for old, new in LABELLED_TO_UNIFIED.items()}
    columns["review_date"] = F.col("review_date").try_cast("timestamp")
    columns["product_category"] = F.lit("unknown")
    columns["source"] = F.lit("groundtruth")
    return unified(df, columns, {"is_fake": real_label(strategy)})


def load_groundtruth(
    raw: DataFrame, strategy: str = "primary", sample_rows: int | None = None, seed: int = 42
) -> DataFrame:
    """Labelled reviews under one strategy, unlabelled rows left out."""
    out = normalize_groundtruth(raw, strategy).where(F.col("is_fake").isNotNull())
    out = out.withColumn("is_fake", F.col("is_fake").cast("int"))
    return take_sample(out, "review_id", sample_rows, seed) if sample_rows else out


def save_reviews(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite"
) -> None:
    """Write the unified columns, then known extras, in their fixed order."""
    extras = [c for c in EXTRA_TYPES if c in df.columns]
    writer = df.select(*REVIEW_COLUMNS, *extras).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return select_unified(spark.read.parquet(path))
