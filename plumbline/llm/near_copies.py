"""Near copies: texts whose sets of five-word runs have a Jaccard similarity of 0.8 or more.

Candidates come from two searches. The trie self-join of ``hamming_trie``, over
fingerprints of five-word runs, gives texts that differ in 3 bits or fewer, which
are nearly equal. For those further apart there are minimum hashes: a set has
``BANDS`` band hashes of ``ROWS`` minima each, and two sets of similarity s share
one with probability 1 - (1 - s**ROWS)**BANDS: 0.999 at 0.8, 0.18 at 0.45. Every
candidate is confirmed by its exact similarity before it links.

Equal texts are one class. In a bucket of up to ``SMALL`` classes every two are
compared. In a larger one a leader is compared with all others; first the class
of the smallest key. Then each component that was found shrinks, in this bucket, to
the class with most links, the one with most links of all leads, and so on for
``LEADERS`` leaders. So a bucket costs ``LEADERS`` comparisons a class however
large it is. A class meets leaders in all its buckets, and one that links to many
comes to lead; links are missed only where two classes never meet through any of
them. ``exhaustive``, which the pipeline asks for, then meets all classes of large
buckets that are still in different components through their rarest runs
(``_rarest_runs``): two similar sets share one of them, so it misses none, and a
passage that many hold brings none together that differ beside it. Tests
measure the recall of both against brute force.

Of the pairs that a round offers, each class is compared with the leader it met
most often; the others only where they would still join two components.

Cases: words are split and put in small letters as in ``hamming_trie``. A text of
under five words is one run; null and empty texts are one class without runs.
Words of a script without spaces are whole lines, so such lines count as one. A
null id comes after all others; of repeated rows one stays. Ties between leaders
go to the smaller key. A very long text is hashed in parts, and its runs are held
as 8-byte hashes by the task that compares it. Columns are kept whatever their
names, but for ``__row``. An empty table stays empty.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from plumbline.llm import hamming_trie
from plumbline.llm.common import add_columns, ship, texts_of
from plumbline.llm.hamming_trie import components
from plumbline.operators.skew import block_pairs, join_per_key
from plumbline.session import forget, written_table

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 6
SMALL = 8
LEADERS = 3
HOT_ROWS = 2_000
BLOCK_CLASSES = 500
# Counts of runs are compared with this much room, for the rounding of fractions.
_SLACK = 1e-6
_CHUNK = 2048
_RANDOM = np.random.default_rng(7)
_FACTORS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a text's runs of words, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = zip(*[words[k:] for k in range(shingle)]) if len(words) >= shingle else [words]
    hashed = map(partial(xxhash.xxh64_intdigest, seed=42), map(b" ".join, runs))
    return np.unique(np.fromiter(hashed, np.uint64))


def bands(runs: np.ndarray) -> list[int]:
    """Signed band hashes of a set; none for an empty one."""
    if not len(runs):
        return []
    least = np.full(BANDS * ROWS, np.uint64((1 << 64) - 1))
    for start in range(0, len(runs), _CHUNK):
        part = runs[start : start + _CHUNK, None]
        np.minimum(least, (part * _FACTORS + _OFFSETS).min(axis=0), out=least)
    hashed = [xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]
    return np.array(hashed, np.uint64).astype(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _signed(text: bytes) -> int:
    number = xxhash.xxh64_intdigest(b" ".join(text.lower().split()))
    return number - (1 << 64) if number >> 63 else number


def signatures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, equal for equal words, ``fingerprint`` and ``bands``."""
    kinds = [StructField("key", LongType()), StructField("fingerprint", LongType()), StructField("bands", ArrayType(LongType()))]

    def compute(batch):
        texts = texts_of(batch, "text")
        prints = np.array([hamming_trie.fingerprint(x, SHINGLE) for x in texts], np.uint64).astype(np.int64)
        keys = pa.array([_signed(x) for x in texts], pa.int64())
        return [keys, pa.array(prints), pa.array([bands(shingles(x)) for x in texts], pa.list_(pa.int64()))]

    return add_columns(docs, kinds, compute)


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys that are similar enough."""
    ship(pairs.sparkSession)
    sides = pairs
    for end, other in (("a", "b"), ("b", "a")):
        own = texts.select(F.col("key").alias(end), F.col("text").alias(f"{end}_text"))
        counts = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
        sides = join_per_key(sides, own, [end], other, "inner", counts, HOT_ROWS)

    def run(batches):
        last, runs = None, None
        for batch in batches:
            keep = []
            for a, x, y in zip(batch.column("a").to_pylist(), texts_of(batch, "a_text"), texts_of(batch, "b_text")):
                if a != last:
                    last, runs = a, shingles(x)
                keep.append(similarity(runs, shingles(y)) >= SIMILARITY)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sides.select("a", "a_text", "b", "b_text").mapInArrow(run, "a long, b long")


def _labels(found: DataFrame) -> DataFrame:
    """(key, label): the smallest key that each linked class reaches."""
    edges = found.select(F.lit(False).alias("a_anonymous"), "a", F.lit(False).alias("b_anonymous"), "b")
    return components(edges).select(F.col("node.id").alias("key"), F.col("label.id").alias("label"))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` whose ends are in different components."""
    for end in ("a", "b"):
        own = labels.select(F.col("key").alias(end), F.col("label").alias(f"{end}_label"))
        pairs = join_per_key(pairs, own, [end], "b" if end == "a" else "a", "left", pairs.groupBy(end).count(), HOT_ROWS)
    apart = F.coalesce("a_label", "a") != F.coalesce("b_label", "b")
    return pairs.where(apart).drop("a_label", "b_label")


class _Links:
    """Confirmed links and the components they make."""

    def __init__(self, texts: DataFrame):
        self.texts, self.found, self.labels = texts, None, None

    def compare(self, pairs: DataFrame) -> None:
        found, before = _confirmed(pairs, self.texts), (self.found, self.labels)
        self.found = written_table(found if self.found is None else self.found.union(found), "similar")
        self.labels = written_table(_labels(self.found), "labels")
        for table in before:
            if table is not None:
                forget(table)

    def add(self, offered: DataFrame) -> None:
        """Compare offered (a, b, met); of the pairs of one class the most frequent first."""
        pairs = written_table(offered, "offered")
        best = pairs.groupBy("b").agg(F.max(F.struct("met", "a")).alias("best")).select("best.a", "b")
        self.compare(best)
        rest = written_table(_apart(pairs.join(best, ["a", "b"], "left_anti"), self.labels), "rest")
        if not rest.isEmpty():
            self.compare(rest.select("a", "b"))
        forget(rest)
        forget(pairs)


def _met(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, met), the smaller key first, and how often they met."""
    ends = pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ends.groupBy("a", "b").agg(F.count(F.lit(1)).alias("met"))


def _trie_pairs(classes: DataFrame) -> DataFrame:
    """(x, y): classes whose fingerprints the trie join links, and those of equal ones."""
    prints = classes.groupBy("fingerprint").agg(F.min("key").alias("node"), F.count(F.lit(1)).alias("n"))
    prints = written_table(prints, "fingerprints")
    linked = hamming_trie.links(prints.select("fingerprint", F.lit(False).alias("anonymous"), "node"))
    equal = prints.where("n > 1").select("fingerprint", "node", "n")
    own = classes.select("fingerprint", "key")
    same = join_per_key(own, equal.drop("n"), ["fingerprint"], "key", "inner", equal.select("fingerprint", "n"), HOT_ROWS)
    return linked.select(F.col("a").alias("x"), F.col("b").alias("y")).union(same.select("node", "key"))


def _led(members: DataFrame, leaders: DataFrame) -> DataFrame:
    """(x, y): the leader of each bucket and every member of another component."""
    sizes = members.groupBy("bucket").count()
    led = leaders.select("bucket", "leader", F.col("label").alias("led"))
    met = join_per_key(members, led, ["bucket"], "key", "inner", sizes, HOT_ROWS).where("label != led")
    return met.select(F.col("leader").alias("x"), F.col("key").alias("y"))


def _rarest_runs(texts: DataFrame) -> DataFrame:
    """(key, size, run, n, ahead): the runs through which a class must be met, ``n`` classes have it.

    Two sets as similar as that share all but a fifth of the larger one. So with the runs of
    every set in one order, the rarest first, they share one that has ``SIMILARITY`` times
    ``size`` runs or more ``ahead``, itself included. Runs of one class are first and meet nobody.
    """
    ship(texts.sparkSession)

    def run(batches):
        for batch in batches:
            sets = [shingles(x) for x in texts_of(batch, "text")]
            sizes = np.array([len(x) for x in sets], np.int64)
            keys = np.repeat(batch.column("key").to_numpy(zero_copy_only=False), sizes)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(np.repeat(sizes, sizes)), pa.array(flat)], names=["key", "size", "run"]
            )

    runs = written_table(texts.select("key", "text").mapInArrow(run, "key long, size long, run long"), "runs")
    counts = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = join_per_key(runs, counts, ["run"], "key", "inner", counts, HOT_ROWS)
    listed = shared.groupBy("key", "size").agg(F.sort_array(F.collect_list(F.struct("n", "run"))).alias("shared"))
    placed = listed.select("key", "size", F.size("shared").alias("held"), F.posexplode("shared").alias("place", "run"))
    ahead = (F.col("held") - F.col("place")).alias("ahead")
    return placed.select("key", "size", "run.run", "run.n", ahead).where(F.col("ahead") >= F.col("size") * SIMILARITY - _SLACK)


def _apart_in_buckets(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """(x, y): classes in different components that could be similar, of buckets that hold several components."""
    named = members.join(labels, "key", "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    named = written_table(named, "members")
    sizes = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    going = sizes.where("lo != hi").select("bucket", "n")
    left = join_per_key(named, going, ["bucket"], "key", "inner", going, HOT_ROWS).select("key", "label").distinct()
    left = written_table(left, "apart")
    asked = written_table(_rarest_runs(texts.join(left, "key", "left_semi")).join(left, "key"), "rarest")
    # At the first run that two sets share all that they share is ahead of both; the smaller set is looked up.
    needed = SIMILARITY / (1 + SIMILARITY)
    ends = block_pairs(asked, ["run"], "n", "key", BLOCK_CLASSES).drop("n")
    held = ends.where(F.col("ahead") >= 2 * needed * F.col("size") - _SLACK)
    block = ["run", "block_lo", "block_hi"]
    one = ends.select(*block, *[F.col(c).alias(f"x_{c}") for c in ("key", "size", "ahead", "label", "block")])
    two = held.select(*block, *[F.col(c).alias(f"y_{c}") for c in ("key", "size", "ahead", "label", "block")])
    across = (F.col("block_lo") == F.col("block_hi")) | (F.col("x_block") != F.col("y_block"))
    larger = F.struct("x_size", "x_key") > F.struct("y_size", "y_key")
    enough = F.least("x_ahead", "y_ahead") >= (F.col("x_size") + F.col("y_size")) * needed - _SLACK
    met = one.join(two, block).where(across & larger & enough & (F.col("x_label") != F.col("y_label")))
    return met.select(F.col("x_key").alias("x"), F.col("y_key").alias("y"))


def _standing(members: DataFrame, links: _Links) -> DataFrame:
    """(bucket, key, label, degree, tried) of buckets that hold several components and someone who has not led.

    One class stands for each component of a bucket, the one with most links.
    """
    degree = links.found.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("degree"))
    known = links.labels.join(degree, "key")
    named = members.select("bucket", "key", "tried").join(known, "key", "left").select(
        "bucket", "key", F.coalesce("label", "key").alias("label"), F.coalesce("degree", F.lit(0)).alias("degree"), "tried"
    )
    best = F.max(F.struct("degree", (-F.col("key")).alias("turned"), "key", "tried")).alias("best")
    named = named.groupBy("bucket", "label").agg(best).select("bucket", "best.key", "label", "best.degree", "best.tried")
    named = written_table(named, "members")
    sizes = named.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("tried").alias("done")
    )
    going = sizes.where("lo != hi AND NOT done").select("bucket", "n")
    return join_per_key(named, going.select("bucket"), ["bucket"], "key", "inner", going, HOT_ROWS)


def links(classes: DataFrame, texts: DataFrame, exhaustive: bool = False) -> DataFrame:
    """(key, label): the smallest key of the component of each linked class.

    ``classes`` has one (key, fingerprint, bands, row) per key, ``texts`` has (row, text).
    """
    spread = classes.select("key", F.posexplode("bands").alias("band", "value"))
    spread = spread.select(F.xxhash64("band", "value").alias("bucket"), "key")
    sizes = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written_table(join_per_key(spread, sizes, ["bucket"], "key", "inner", sizes, HOT_ROWS), "buckets")
    trie = written_table(_trie_pairs(classes), "trie-pairs")
    involved = members.select("key").union(trie.select("x")).union(trie.select("y")).distinct()
    some = classes.select("key", "row").join(involved, "key", "left_semi")
    texts = written_table(texts.join(some, "row").dropDuplicates(["key"]).select("key", "text"), "texts")
    small = members.where(F.col("n") <= SMALL).select("bucket", "key")
    large = members.where(F.col("n") > SMALL).select("bucket", "key")
    within = small.groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    within = within.select("keys", F.posexplode("keys").alias("i", "x"))
    within = within.select("x", F.explode(F.slice("keys", F.col("i") + 2, F.size("keys"))).alias("y"))
    leaders = large.groupBy("bucket").agg(F.min("key").alias("leader")).withColumn("label", F.col("leader"))
    own = _Links(texts)
    own.add(_met(trie.union(within).union(_led(large.withColumn("label", F.col("key")), leaders))))
    forget(trie)
    led = leaders.select("bucket", F.col("leader").alias("key"), F.lit(True).alias("tried"))
    state = large.join(led, ["bucket", "key"], "left").fillna(False, ["tried"])
    turns = 1
    while turns < LEADERS:
        state = written_table(_standing(state, own), "members")
        if state.isEmpty():
            break
        best = F.max(F.struct("degree", (-F.col("key")).alias("turned"), "key", "label")).alias("best")
        leaders = state.where("NOT tried").groupBy("bucket").agg(best).select(
            "bucket", F.col("best.key").alias("leader"), F.col("best.label").alias("label")
        )
        own.add(_met(_led(state, leaders)))
        led = leaders.select("bucket", F.col("leader").alias("key"), F.lit(True).alias("led"))
        state = state.join(led, ["bucket", "key"], "left").select("bucket", "key", F.coalesce("led", "tried").alias("tried"))
        turns += 1
    if exhaustive:
        own.compare(written_table(_met(_apart_in_buckets(large, own.labels, texts)).select("a", "b"), "offered"))
    forget(members)
    forget(texts)
    return own.labels


def _row():
    return F.xxhash64("doc_id", "text")


def keep_one(docs: DataFrame, exhaustive: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of the smallest id, null ids last."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _row().alias("row"))
    marked = written_table(signatures(own).drop("text"), "signatures")
    classes = marked.groupBy("key").agg(
        F.min_by("fingerprint", "row").alias("fingerprint"), F.min_by("bands", "row").alias("bands"), F.min("row").alias("row")
    )
    classes = written_table(classes, "classes")
    labels = links(classes, own.select("row", "text"), exhaustive)
    found = marked.select("doc_id", "row", "key").join(labels, "key", "left")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("anonymous"), "doc_id", "row"))
    kept = found.groupBy(F.coalesce("label", "key")).agg(first.alias("first")).select(F.col("first.row").alias("__row")).distinct()
    rows = docs.withColumn("__row", _row())
    return rows.join(kept, "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
