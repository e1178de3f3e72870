"""The model against dictionaries of counts and a plain recursion."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import backoff_lm
from plumbline.llm.queries import QUERIES

WEIGHTS = backoff_lm.WEIGHTS


def tokens_of(text):
    return [*(text or "").encode().lower().split(), b""]


class Slow:
    """Counts in dictionaries; probabilities straight from the definition."""

    def __init__(self, texts, order=3, weights=WEIGHTS):
        self.order, self.weights, self.count = order, weights, Counter()
        self.words = Counter()
        for text in texts:
            words = tokens_of(text)
            self.words.update(words)
            marked = ("<s>", *words)
            for k in range(1, order + 1):
                self.count.update(marked[i : i + k] for i in range(len(marked) - k + 1))
        self.n, self.types = sum(self.words.values()), len(self.words)
        singles = sum(1 for n in self.words.values() if n == 1)
        self.unseen = (singles + 1) / (self.n + 2) if self.n else 1.0

    def probability(self, context, word):
        if not context:
            return (1 - self.unseen) * self.words[word] / self.n if self.words[word] else self.unseen
        m = self.weights[len(context) - 1]
        lower = self.probability(context[1:], word)
        return (self.count[(*context, word)] + m * lower) / (self.count[context] + m)

    def score(self, text):
        marked, total = ("<s>", *tokens_of(text)), 0.0
        for i in range(1, len(marked)):
            total += math.log10(self.probability(marked[max(0, i - self.order + 1) : i], marked[i]))
        return total

    def base(self, text):
        return sum(math.log10((self.words[w] + 0.5) / (self.n + 0.5 * (self.types + 1))) for w in tokens_of(text))


def held_out(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1


def check(got, rows, order=3):
    model = Slow([t for k, t in rows if not held_out(k)], order)
    expected = sorted(
        (
            (k is None, k or 0, held_out(k), len(tokens_of(t)), sum(w in model.words for w in tokens_of(t)), model.n,
             round(model.base(t), 6), round(model.score(t), 6))
            for k, t in rows
        )
    )
    assert sorted(
        (r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
        for r in got
    ) == expected


def test_probabilities_add_up():
    model = Slow(["a b a c", "a b b", "c"])
    vocabulary = [*model.words, b"unknown"]
    for context in [(), (b"a",), (b"b",), (b"a", b"b"), (b"zzz",), ("<s>",), ("<s>", b"a")]:
        assert sum(model.probability(context, w) for w in vocabulary) == pytest.approx(1)


def test_keys_and_counts_round_trip():
    rng = random.Random(1)
    for n in (1, 2, 500):
        keys = np.sort(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
        assert (backoff_lm.unpacked_keys(backoff_lm.packed_keys(keys)) == keys).all()
    dense = np.arange(7, 300, dtype=np.uint64)
    assert (backoff_lm.unpacked_keys(backoff_lm.packed_keys(dense)) == dense).all()
    assert backoff_lm.unpacked_counts(backoff_lm.packed_counts(np.array([0, 1, 2**40]))).tolist() == [0, 1, 2**40]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_many_blocks_and_shards(spark, order):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["a", "B", "cc", "d", f"w{i}"]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(3, rows[3][1]), (None, "a b"), (77, None), (78, ""), (79, "zebra " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash")).repartition(3).cache()
    docs.count()
    check(backoff_lm.score_documents(docs, order, block_bytes=200, shard_bytes=300).collect(), rows, order)


def test_without_training_texts(spark):
    key = next(k for k in range(100) if held_out(k))
    docs = spark.createDataFrame([(key, "a b"), (key, None)], "doc_id long, text string")
    got = backoff_lm.score_documents(docs).collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got) == [(1, 0, 0, 0, 0), (3, 0, 0, 0, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert backoff_lm.score_documents(empty).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = QUERIES["op2_backoff_lm"](spark, folder).collect()
    check(got, rows)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
