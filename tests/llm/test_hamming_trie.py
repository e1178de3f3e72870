"""Fingerprints, the trie join and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm import hamming_trie
from plumbline.llm.queries import QUERIES


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [words[i : i + 3] for i in range(len(words) - 2)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values):
    """Smallest key reached from each key of {key: fingerprint}."""
    label = {k: k for k in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if (values[a] ^ values[b]).bit_count() <= 3 and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint():
    texts = ["", "One", "one two", "A b  c\td", "ü ä ö x y z x y z x y z", "a\x0bb\x0cc d " * 900]
    for text in texts:
        assert hamming_trie.fingerprint(text.encode()) == slow_fingerprint(text)


def test_spark_hash_agrees(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("uno dos tres")).alias("h")).first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest("uno dos tres", 42)


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


def test_trie_pairs_equal_all_pairs():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(60)]
    values += [near(rng, rng.choice(values), rng.randint(1, 4)) for _ in range(400)]
    keys = np.unique(np.array(values, np.uint64))
    found = {(min(i, j), max(i, j)) for a, b in hamming_trie.trie_pairs(keys, top=0 + 16) for i, j in zip(a.tolist(), b.tolist())}
    expected = {
        (i, j)
        for i in range(len(keys))
        for j in range(i + 1, len(keys))
        if (int(keys[i]) ^ int(keys[j])).bit_count() <= 3 and int(keys[i]) >> 48 == int(keys[j]) >> 48
    }
    assert found == expected


@pytest.mark.parametrize("subtree_rows", [1_000_000, 7])
def test_components_equal_brute_force(spark, subtree_rows):
    rng = random.Random(8)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    values = {}
    for i in range(160):
        base = rng.choice(seeds) if i % 2 else rng.choice(list(values.values()) or seeds)
        values[i * 3] = near(rng, base, rng.randint(1, 3))
    signed = {k: v - 2**64 if v >= 2**63 else v for k, v in values.items()}
    rows = spark.createDataFrame([(v, False, k) for k, v in signed.items()], "fingerprint long, anonymous boolean, node long")
    rows = rows.groupBy("fingerprint").agg(F.min("anonymous").alias("anonymous"), F.min("node").alias("node"))
    labels = hamming_trie.components(hamming_trie.links(rows, subtree_rows=subtree_rows))
    got = {r.node.id: r.label.id for r in labels.collect()}
    first = {}
    for k in sorted(values):
        first.setdefault(values[k], k)
    expected = slow_components({k: v for v, k in first.items()})
    assert {k: got.get(k, k) for k in expected} == expected


def test_cases(spark):
    text = "the quick brown fox jumps over the lazy dog " * 3
    rows = [(None, text), (7, text), (7, text), (9, None), (4, ""), (2, " \n"), (3, "other words are here"), (None, "lone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    got = sorted(
        ((r.doc_id, r.component_id, r.fingerprint) for r in hamming_trie.near_duplicates(docs).collect()), key=repr
    )
    by_id = {(a, b) for a, b, _ in got}
    assert len(got) == len(rows)
    assert {(7, 7), (None, 7), (9, 2), (4, 2), (2, 2), (3, 3), (None, None)} == by_id
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert hamming_trie.near_duplicates(empty).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    values = {k: slow_fingerprint(v) for k, v in texts.items()}
    label = slow_components(values)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_hamming_trie"](spark, folder).collect()}
    assert got == {k: (f"{values[k]:016x}", label[k]) for k in values}
