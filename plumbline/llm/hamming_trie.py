"""SimHash near-duplicates by a self-join of a binary trie of fingerprints.

A fingerprint holds, per bit, the majority of the 64-bit hashes of a text's
shingles. Equal fingerprints are one class. The trie over the classes is joined
with itself: pairs of nodes are walked down together, the differing bits add up,
and a pair is dropped once they exceed the budget.

The walk is dealt out below equal top blocks. With a budget of 3 and four blocks
of 16 bits, two linked fingerprints agree in at least one block; each rotation
puts another block on top, and the pairs of nodes whose top blocks differ are
left to the rotations where they agree. Crowded subtrees are cut into blocks of
rows, and every two of them are joined by a task of their own, so no link is lost
and no task holds more than about ``2 * SUBTREE_ROWS`` fingerprints.

Each task returns links that connect what it found connected, at most one per
fingerprint; components are then joined over all tasks.

Cases: a null or empty text has no words and the fingerprint 0, which is linked
like any other. Repeated rows fall into one class. A null id takes part, but a
component's id is the smallest id that is not null, and null if there is none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from plumbline.llm.common import add_columns, ship, texts_of
from plumbline.operators.skew import block_pairs
from plumbline.session import written_table

SHINGLE = 3
BUDGET = 3
BLOCK_BITS = 16
SUBTREE_ROWS = 1_000_000
_FRONTIER = 1 << 16
_HASHES = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(hashed, np.uint64, n)
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _HASHES):
        part = hashes[start : start + _HASHES].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a signed 64-bit column ``fingerprint``."""

    def compute(batch):
        values = [fingerprint(x, shingle) for x in texts_of(batch, "text")]
        return [pa.array(np.array(values, np.uint64).astype(np.int64))]

    return add_columns(docs, [StructField("fingerprint", LongType())], compute)


def rotated(values: np.ndarray, block: int) -> np.ndarray:
    """Put block ``block`` (0 is the topmost) on top."""
    if not block:
        return values
    shift = np.uint64(block * BLOCK_BITS)
    return (values << shift) | (values >> (np.uint64(64) - shift))


def trie_pairs(keys: np.ndarray, budget: int = BUDGET, top: int = BLOCK_BITS):
    """Index pairs of distinct sorted ``keys`` with equal ``top`` bits within ``budget``.

    A node is a range of ``keys``. Pairs of nodes of one depth are held in arrays
    and walked down depth first in bounded portions.
    """
    edges = np.flatnonzero(np.diff(keys >> np.uint64(64 - top))) + 1
    lo, hi = np.r_[0, edges], np.r_[edges, len(keys)]
    busy = hi - lo > 1
    lo, hi = lo[busy], hi[busy]
    stack = [(top, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        depth, alo, ahi, blo, bhi, diff = stack.pop()
        if len(alo) > _FRONTIER:
            half = len(alo) // 2
            for part in (slice(half, None), slice(0, half)):
                stack.append((depth, *(x[part] for x in (alo, ahi, blo, bhi, diff))))
            continue
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            i, j = alo[single], blo[single]
            near = (i != j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        bit = np.uint64(1) << np.uint64(63 - depth)
        below = ~(bit | (bit - np.uint64(1)))

        def middle(low, high):
            return np.clip(np.searchsorted(keys, (keys[low] & below) | bit), low, high)

        amid, bmid, same = middle(alo, ahi), middle(blo, bhi), alo == blo
        apart = ~same
        children = [
            (alo, amid, blo, bmid, diff, np.ones(len(alo), bool)),
            (amid, ahi, bmid, bhi, diff, np.ones(len(alo), bool)),
            (alo, amid, bmid, bhi, diff + 1, np.ones(len(alo), bool)),
            (amid, ahi, blo, bmid, diff + 1, apart),
        ]
        new = []
        for clo, chi, dlo, dhi, d, wanted in children:
            keep = wanted & (clo < chi) & (dlo < dhi) & (d <= budget)
            keep &= (clo != dlo) | (chi - clo > 1)
            new.append([x[keep] for x in (clo, chi, dlo, dhi, d)])
        joined = [np.concatenate(x) for x in zip(*new)]
        if len(joined[0]):
            stack.append((depth + 1, *joined))


def forest(keys: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect whatever ``trie_pairs`` connects, a chain per component."""
    parent = np.arange(len(keys))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for left, right in trie_pairs(keys, budget):
        open_ = parent[left] != parent[right]
        for i, j in zip(left[open_].tolist(), right[open_].tolist()):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
        while not np.array_equal(up := parent[parent], parent):
            parent = up
    order = np.argsort(parent, kind="stable")
    linked = np.flatnonzero(parent[order][1:] == parent[order][:-1])
    return order[linked], order[linked + 1]


def _walk(budget):
    """Join the subtrees of a partition sorted by (rotation, lo, hi, key)."""

    def join(part):
        rows = {c: part.column(c).to_numpy() for c in part.column_names}
        run = rows["rotation"].astype(np.int64) << 42 | rows["block_lo"].astype(np.int64) << 21 | rows["block_hi"]
        cuts = np.r_[0, np.flatnonzero(np.diff(run)) + 1, len(run)]
        for start, stop in zip(cuts[:-1], cuts[1:]):
            keys = rotated(rows["fingerprint"][start:stop].astype(np.uint64), int(rows["rotation"][start]))
            order = np.argsort(keys)
            a, b = forest(keys[order], budget)
            a, b = start + order[a], start + order[b]
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[c][x]) for x in (a, b) for c in ("anonymous", "node")],
                    names=["a_anonymous", "a", "b_anonymous", "b"],
                )

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < SUBTREE_ROWS:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            names = ["rotation", "block_lo", "block_hi", "top"]
            last = [whole.column(c)[n - 1].as_py() for c in names]
            other = np.zeros(n, bool)
            for c, v in zip(names, last):
                other |= whole.column(c).to_numpy() != v
            ready = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if ready:
                yield from join(whole.slice(0, ready))
                held, n = whole.slice(ready).to_batches(), n - ready
        if n:
            yield from join(pa.Table.from_batches(held).combine_chunks())

    return run


def links(classes: DataFrame, budget: int = BUDGET, subtree_rows: int = SUBTREE_ROWS) -> DataFrame:
    """Links (a_anonymous, a, b_anonymous, b) that connect every two classes within the budget.

    ``classes`` has one row (fingerprint, anonymous, node) per fingerprint.
    """
    ship(classes.sparkSession)
    blocks = 64 // BLOCK_BITS
    if budget >= blocks:
        raise ValueError(f"a budget of {budget} bits needs more than {blocks} blocks")
    tops = [
        F.shiftrightunsigned("fingerprint", 64 - BLOCK_BITS * (r + 1)).bitwiseAND((1 << BLOCK_BITS) - 1)
        for r in range(blocks)
    ]
    rows = classes.select(
        "*", F.posexplode(F.array(*tops)).alias("rotation", "top")
    )
    # At most one crowded subtree per ``subtree_rows`` rows, so this table stays small.
    crowded = rows.groupBy("rotation", "top").count().where(F.col("count") > subtree_rows)
    rows = rows.join(F.broadcast(crowded), ["rotation", "top"], "left")
    rows = block_pairs(
        rows.withColumn("count", F.coalesce("count", F.lit(1))),
        ["rotation", "top"], "count", "fingerprint", subtree_rows,
    )
    dealt = rows.repartition("rotation", "top", "block_lo", "block_hi").sortWithinPartitions(
        "rotation", "block_lo", "block_hi", "top"
    )
    columns = ["rotation", "top", "block_lo", "block_hi", "fingerprint", "anonymous", "node"]
    schema = "a_anonymous boolean, a long, b_anonymous boolean, b long"
    return dealt.select(*columns).mapInArrow(_walk(budget), schema)


def _node(anonymous: str, number: str) -> Column:
    """Sorts by id; classes without an id come last."""
    return F.struct(F.col(anonymous).alias("anonymous"), F.col(number).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    Every round joins each node to its smallest neighbour and contracts what it
    joined, which at least halves the nodes left; rounds go on until no link is
    left. All tables are written to the shared folder, so a lost executor costs
    no more than its part of a round.
    """
    a, b = _node("a_anonymous", "a"), _node("b_anonymous", "b")
    edges = written_table(
        edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u != v").distinct(), "links"
    )
    labels = None
    while not edges.isEmpty():
        both = edges.select("u", "v").union(edges.select("v", "u"))
        step = written_table(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("p")).toDF("node", "p"), "parents"
        )
        # Parents are smaller than their nodes, so following them ends at a root.
        while True:
            up = step.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            step = written_table(step.join(up, "p").select("node", F.col("pp").alias("p")), "parents")
            above = step.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            if step.join(above, "p").where("p != pp").isEmpty():
                break
        if labels is None:
            labels = step.select("node", F.col("p").alias("label"))
        else:
            moved = step.select(F.col("node").alias("label"), F.col("p").alias("to"))
            labels = labels.join(moved, "label", "left").select(
                "node", F.coalesce("to", "label").alias("label")
            )
            labels = written_table(labels, "labels")
        at_u = step.select(F.col("node").alias("u"), F.col("p").alias("pu"))
        at_v = step.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        merged = edges.join(at_u, "u").join(at_v, "v").select("pu", "pv").where("pu != pv")
        edges = written_table(
            merged.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links"
        )
    if labels is None:
        labels = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels


def near_duplicates(
    docs: DataFrame,
    shingle: int = SHINGLE,
    budget: int = BUDGET,
    subtree_rows: int = SUBTREE_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, component, row): one row per row of ``docs``.

    ``component`` is set for every row and tells components without ids apart;
    ``row`` is the hash of id and text.
    """
    own = docs.select(F.col("doc_id").cast("long"), "text", _row().alias("row"))
    marked = written_table(fingerprints(own, shingle).drop("text"), "fingerprints")
    classes = written_table(
        marked.groupBy("fingerprint")
        .agg(F.min("doc_id").alias("first"))
        .select(
            "fingerprint",
            F.col("first").isNull().alias("anonymous"),
            F.coalesce("first", "fingerprint").alias("node"),
        ),
        "classes",
    )
    labels = components(links(classes, budget, subtree_rows))
    named = written_table(
        classes.withColumn("node", _node("anonymous", "node"))
        .join(labels, "node", "left")
        .select("fingerprint", F.coalesce("label", "node").alias("component")),
        "components",
    )
    return marked.join(named, "fingerprint").select(
        "doc_id",
        "fingerprint",
        F.when(~F.col("component.anonymous"), F.col("component.id")).alias("component_id"),
        "component",
        "row",
    )


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, null ids last."""
    found = near_duplicates(docs, shingle, budget)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "row"))
    kept = found.groupBy("component").agg(first.alias("first")).select(F.col("first.row").alias("__row")).distinct()
    marked = docs.withColumn("__row", _row())
    return marked.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
