"""Exact top-k search by inner product: vertical layout, branch and bound.

Vectors are whole numbers, floor(1024 * component). A block of candidates is laid
out by dimension. A query adds up its products one block of dimensions after the
other. What the rest can still add is at most the product of the two remaining
norms, so after each block a candidate is out if even its best end stays below the
k-th best certain one; survivors are compacted and go on.

Every block of candidates meets every block of queries in a task of bounded size
and returns at most k rows per query; the rows of a query are merged by rank.

Vectors with a component of ``LIMIT`` or more after scaling could overflow 64-bit
sums. They are scored in floating point with a bound on its error, and those that
the bound leaves among the k best once more in whole numbers of any size.

Cases: vectors that are null or hold null, NaN or infinite components take no
part, and so do rows without an id. A shorter vector counts as padded with zeros.
Ties go to the smaller id. A score beyond 64 bits is given as the nearest 64-bit
number and ranks as that. Candidates with the query's own id are left out;
repeated rows under another id are candidates each. Of query rows with one id the
smallest vector asks. No vectors give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import ship

K = 10
SCALE = 1024
# Below it, sums over up to 1,024 components stay inside 64 bits.
LIMIT = 1 << 26
LONG = (1 << 63) - 1
DIMENSIONS = 16
CANDIDATE_ROWS = 8192
QUERY_ROWS = 1024


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): vectors that take part, as doubles."""
    number = F.col("vec_id").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    return vectors.where(number).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )


def scaled(vector: list[float]) -> np.ndarray:
    """floor(SCALE * x) of the components as doubles: exact, or infinite where it leaves their range."""
    with np.errstate(over="ignore"):
        return np.floor(np.asarray(vector, float) * SCALE)


def whole(vector: list[float]) -> list[int]:
    """floor(SCALE * x) of the components as Python integers."""
    return [math.floor(x * SCALE) if abs(x) < LIMIT else math.floor(x) * SCALE + math.floor(x % 1 * SCALE) for x in vector]


def is_wide(vector: list[float]) -> bool:
    return bool(vector) and max(map(abs, vector)) * SCALE >= LIMIT


class Vertical:
    """A block of candidates by dimension, with the norm that each has left after each block of dimensions."""

    def __init__(self, vectors: list[np.ndarray], ids: np.ndarray, width: int):
        flat = np.zeros((len(vectors), width), np.int64)
        for row, v in zip(flat, vectors):
            row[: len(v)] = v
        order = np.argsort(ids, kind="stable")
        self.ids, self.by_dimension = ids[order], np.ascontiguousarray(flat[order].T)
        self.cuts = list(range(0, width, DIMENSIONS)) + [width]
        self.left = remaining(self.by_dimension.astype(float), self.cuts)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        alive = np.flatnonzero(self.ids != own)
        scores = np.zeros(len(alive), np.int64)
        left = remaining(query.astype(float)[:, None], self.cuts)[:, 0]
        for b, (start, stop) in enumerate(zip(self.cuts, self.cuts[1:])):
            part = self.by_dimension[start:stop]
            scores += query[start:stop] @ (part if len(alive) == part.shape[1] else part[:, alive])
            if len(alive) <= k or not left[b + 1]:
                continue
            # Rounding of the norms is far below the one that is added.
            slack = left[b + 1] * self.left[b + 1][alive] * (1 + 1e-9) + 1
            sure = np.partition(scores - slack, len(alive) - k)[len(alive) - k]
            keep = scores + slack >= sure
            alive, scores = alive[keep], scores[keep]
        return top(self.ids[alive], scores, k)


class Wide:
    """A block of candidates of any size: floating-point scores with an error bound, then whole numbers."""

    def __init__(self, vectors: list[list[float]], ids: np.ndarray, width: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], [vectors[i] for i in order]
        self.approximate = np.zeros((len(vectors), width))
        for row, v in zip(self.approximate, self.vectors):
            row[: len(v)] = scaled(v)

    def best(self, query: list[float], own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        alive = np.flatnonzero(self.ids != own)
        if len(alive) > k:
            asked = np.zeros(self.approximate.shape[1])
            asked[: len(query)] = scaled(query)
            with np.errstate(over="ignore", invalid="ignore"):
                scores = self.approximate[alive] @ asked
                # Each product and each sum is off by at most one part in 2^53 of the absolute sum.
                slack = (np.abs(self.approximate[alive]) @ np.abs(asked)) * (2 * len(asked) + 2) * 2.0**-53
                low, high = scores - slack, scores + slack
            low[~np.isfinite(low)], high[~np.isfinite(high)] = -np.inf, np.inf
            # Scores beyond 64 bits count as equal.
            low, high = np.clip(low, -(2.0**63), 2.0**63), np.clip(high, -(2.0**63), 2.0**63)
            alive = alive[high >= np.partition(low, len(alive) - k)[len(alive) - k]]
        numbers = whole(query)
        exact = [sum(a * b for a, b in zip(numbers, whole(self.vectors[i]))) for i in alive]
        return top(self.ids[alive], np.array([min(max(s, -LONG - 1), LONG) for s in exact], np.int64), k)


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id; ``~`` turns the order round without overflow."""
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def remaining(by_dimension: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norms over the dimensions from each cut on."""
    squares = [np.square(by_dimension[a:b]).sum(axis=0) for a, b in zip(cuts, cuts[1:])]
    sums = np.cumsum([np.zeros(by_dimension.shape[1]), *squares[::-1]], axis=0)[::-1]
    return np.sqrt(sums)


def search(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all vectors for each vector that ``is_query`` picks."""
    ship(vectors.sparkSession)
    rows = usable_vectors(vectors)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    n, n_asked = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    blocks, groups = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-n_asked // QUERY_ROWS))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        return df.select("vec_id", "vector", number.alias(own), every.alias(other))

    candidates = dealt(rows, "block", blocks, "group", groups)
    queries = dealt(asked, "group", groups, "block", blocks)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            own, theirs = left.column("vector").to_pylist(), right.column("vector").to_pylist()
            width = max(map(len, own + theirs), default=0)
            keys, asked = left.column("vec_id").to_numpy(), right.column("vec_id").to_pylist()
            wide = np.fromiter(map(is_wide, own), bool, len(own))
            every = Wide(own, keys, width) if any(map(is_wide, theirs)) else None
            large = Wide([own[i] for i in np.flatnonzero(wide)], keys[wide], width)
            plain = [scaled(own[i]).astype(np.int64) for i in np.flatnonzero(~wide)]
            block = Vertical(plain, keys[~wide], width)
            for key, v in zip(asked, theirs):
                if is_wide(v):
                    ids, scores = every.best(v, key, k)
                else:
                    query = np.zeros(width, np.int64)
                    query[: len(v)] = scaled(v)
                    ids, scores = block.best(query, key, k)
                    if len(large.ids):
                        more = large.best(v, key, k)
                        ids, scores = top(np.append(ids, more[0]), np.append(scores, more[1]), k)
                for column, values in zip(out, ([key] * len(ids), ids.tolist(), scores.tolist())):
                    column.extend(values)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    found = (
        candidates.groupBy("block", "group")
        .cogroup(queries.groupBy("block", "group"))
        .applyInArrow(meet, "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id != c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
