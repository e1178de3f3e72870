"""Near copies by five-word runs: planted pairs on both sides of the threshold, large groups, brute force."""

import itertools
import random

from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import near_copies

FOLDER = "/root/testdata/sf0.001"


def words(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(n)]


def changed(own, places, mark="x"):
    return [f"{w}{mark}" if i in places else w for i, w in enumerate(own)]


def runs(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_ids(docs):
    """Smallest id of each component, by comparing every two texts."""
    label = {k: k for k in docs}
    sets = {k: runs(v) for k, v in docs.items()}
    for a, b in itertools.combinations(sorted(docs), 2):
        if label[a] != label[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            lo, hi = sorted((label[a], label[b]))
            label = {k: lo if v == hi else v for k, v in label.items()}
    return set(label.values())


def stage(spark, docs):
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return {r.doc_id for r in corpus_pipeline.near_duplicates(spark, rows, FOLDER).collect()}


def test_copies_beyond_three_bits_go(spark):
    docs = {}
    for k in range(20):
        own = words(k, 300)
        docs[3 * k] = " ".join(own)
        docs[3 * k + 1] = " ".join(changed(own, {40, 120, 200, 260}))  # similarity 276 of 316
        docs[3 * k + 2] = " ".join(changed(own, set(range(10, 300, 30))))  # 246 of 346
    assert stage(spark, docs) == kept_ids(docs) == {k for k in range(60) if k % 3 != 1}


def test_a_large_group_hangs_together_by_one_text(spark):
    own, rng = words(99, 200), random.Random(1)
    # Copies resemble the first text but hardly each other.
    docs = {k: " ".join(changed(own, set(rng.sample(range(5, 195), 4)), f"y{k}")) for k in range(60)}
    docs[60] = " ".join(own)
    docs[61] = " ".join(words(7, 200))
    assert stage(spark, docs) == kept_ids(docs)
    assert len(kept_ids(docs)) < 5


def test_short_and_empty_texts(spark):
    rows = [(1, "a b"), (2, "A  b"), (3, "a c"), (4, ""), (5, None), (None, "a b"), (6, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_one(docs).collect()} == {1, 3, 4, 6}


def grouped(seed, groups, size, changes):
    """Groups of variants of one text each, which resemble it more than each other."""
    rng, docs = random.Random(seed), {}
    for g in range(groups):
        own = words(1000 * seed + g, 150)
        for _ in range(size):
            docs[len(docs)] = " ".join(changed(own, set(rng.sample(range(5, 145), changes)), f"z{len(docs)}"))
        docs[len(docs)] = " ".join(own)
    return docs


def test_recall_against_brute_force(spark):
    docs = grouped(3, 2, 20, 3) | {1000 + k: v for k, v in grouped(4, 1, 20, 5).items()} | {2000 + k: v for k, v in grouped(5, 6, 4, 2).items()}
    wanted = set(docs) - kept_ids(docs)
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for exhaustive, least in ((False, 0.97), (True, 0.99)):
        gone = set(docs) - {r.doc_id for r in near_copies.keep_one(rows, exhaustive).collect()}
        assert gone <= wanted and len(gone) >= least * len(wanted)


def test_stage_misses_nothing_that_leaders_leave_apart(spark, monkeypatch):
    """All texts share one bucket and no fingerprints are close: three leaders would find three of the pairs."""
    real, docs = near_copies.signatures, {}

    def one_bucket(rows):
        return real(rows).withColumns({"bands": F.array(F.lit(7).cast("long")), "fingerprint": F.xxhash64("key")})

    monkeypatch.setattr(near_copies, "signatures", one_bucket)
    monkeypatch.setattr(near_copies, "BLOCK_CLASSES", 7)
    for k in range(15):
        own = words(500 + k, 60)
        docs |= {2 * k: " ".join(own), 2 * k + 1: " ".join(changed(own, {30}))}
    assert stage(spark, docs) == kept_ids(docs) == set(range(0, 30, 2))


def test_a_common_passage_brings_no_pairs(spark):
    """80 texts of one bucket share most of their runs, yet only those that may be similar meet."""
    passage, docs = words(40, 64), {}
    for k in range(80):
        docs[k] = " ".join(passage + words(600 + k, 14 + k % 9))
    docs |= {80: docs[0] + " end", 81: " ".join(changed(docs[5].split(), {70}))}
    texts = spark.createDataFrame(list(docs.items()), "key long, text string")
    members = texts.select(F.lit(7).cast("long").alias("bucket"), "key")
    met = near_copies._apart_in_buckets(members, spark.createDataFrame([], "key long, label long"), texts).collect()
    assert {frozenset(r) for r in met} == {frozenset((0, 80)), frozenset((5, 81))}


def test_work_grows_with_the_group(spark, monkeypatch):
    """Pairs compared in a group of variants whose similarity to each other is below the threshold."""
    compared, real = [], near_copies._confirmed

    def counted(pairs, texts):
        compared[-1] += pairs.count()
        return real(pairs, texts)

    monkeypatch.setattr(near_copies, "_confirmed", counted)
    for size in (100, 400):
        docs = grouped(6, 1, size, 5)
        compared.append(0)
        near_copies.keep_one(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).count()
    assert compared[1] < 6 * compared[0] and compared[1] < 400 * 60


def test_clashing_columns_empty_table_and_a_very_long_text(spark):
    long = " ".join(words(8, 60_000))
    rows = [(1, "same words here in both texts", 1, "x"), (2, "Same words  here in both texts", 2, "y"), (3, long, 3, "z"), (4, long + " end", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, key int, bands string")
    kept = near_copies.keep_one(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.key, r.bands) for r in kept] == [(1, 1, "x"), (3, 3, "z")]
    assert near_copies.keep_one(docs.where(F.lit(False))).count() == 0
