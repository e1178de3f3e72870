"""Registered queries: each a Spark callable and, where one can be written, equal SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    column = F.col(c) if isinstance(c, str) else c
    return F.round(column, 6).alias(name or c)


def with_micros(df: DataFrame, column: str = "review_date") -> DataFrame:
    """Timestamps as epoch microseconds, alike in every engine."""
    return df.withColumn(column, F.unix_micros(F.col(column).cast("timestamp")))


def select_body(ctes: list[str], body: str) -> str:
    """``body`` is a SELECT, or more common tables followed by one."""
    body = body.strip()
    joint = " " if body.upper().startswith("SELECT") else ", "
    return "WITH " + ", ".join(ctes) + joint + body


# The review views of ``plumbline.sources.tables`` in plain SQL.
DOCS = """reviews_docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS review_id, d.source AS product_id,
    d.lang AS product_category, CAST(e.user_id AS VARCHAR) AS reviewer_id,
    CAST(CASE e.event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
      WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END AS DOUBLE) AS rating,
    '' AS review_title, d.text AS review_text, l.quality = 1 AS verified_purchase,
    e.ts AS review_date, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS helpful_votes,
    CASE WHEN d.doc_id % 3 = 0
      THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) + 10 END AS total_votes,
    p.p_name AS product_title, p.p_retailprice AS price, p.p_brand AS brand,
    p.p_type AS main_category, 'fallback' AS source, l.toxic AS is_fake
  FROM documents d JOIN events e ON d.doc_id = e.event_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN part p ON p.p_partkey = CAST(substr(d.source, 4) AS BIGINT))"""

ITEMS = """reviews_items AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(epoch_us(l_shipdate) // 1000000 AS BIGINT)) AS review_id,
    CAST(l_partkey AS VARCHAR) AS product_id, 'items' AS product_category,
    CAST(o_custkey AS VARCHAR) AS reviewer_id,
    CAST(1 + CAST(floor(l_quantity) AS BIGINT) % 5 AS DOUBLE) AS rating,
    CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END AS verified_purchase,
    l_shipdate AS review_date, CAST(round(l_tax * 100) AS BIGINT) AS helpful_votes,
    l_extendedprice AS price
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def docs_sql(body: str) -> str:
    return select_body([DOCS], body)


def items_sql(body: str) -> str:
    return select_body([ITEMS], body)


UNIFIED = (
    "review_id, product_id, product_category, reviewer_id, rating, review_title, review_text, "
    "verified_purchase, review_date, helpful_votes, total_votes, product_title, price, brand, "
    "main_category, source"
)
