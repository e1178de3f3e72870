"""Quality by a hashed n-gram log-likelihood ratio, beside plain word and line rules.

Every run of ``GRAM`` bytes of a text is hashed into one of ``BUCKETS`` buckets.
Two multinomials over the buckets are counted, one over trusted texts and one
over the whole corpus. A text's score is the mean, over its n-grams, of the
logarithm of the ratio of the two; texts at or above a threshold are kept.

Cases: a null or empty text has no words, fails the base rules and scores 0; a
text of under ``GRAM`` bytes scores 0. Without trusted texts all scores are 0 and
only the base rules decide. Repeated rows are judged alike; each counts in the
corpus. A text is trusted if its id is labelled and none of the labels says
otherwise; null ids are never trusted. Input columns named like a result are
replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField

from plumbline.llm.common import add_columns, ship, texts_of

GRAM = 4
BUCKETS = 1 << 16
# Added to the counts of both multinomials, the corpus scaled to the size of the trusted texts,
# so that a bucket of few trusted n-grams says little.
SMOOTHING = 5.0
# Natural logarithm per n-gram. Ordinary text is near or above 0, as it is most of the corpus.
THRESHOLD = -0.4
# The multinomial of trusted texts is fitted on this many labelled ids at most, in hash order.
MAX_LABELLED = 200_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_WINDOW = 1 << 20

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = [
    *[StructField(name, LongType()) for name in FEATURES],
    StructField("base_failed", BooleanType()),
    StructField("llr", DoubleType()),
    StructField("kept", BooleanType()),
]


@dataclass
class Ratio:
    """Log ratio of each bucket; an array of fixed size, whatever the corpus."""

    weights: np.ndarray

    def score(self, text: bytes) -> float:
        total, n = 0.0, 0
        for buckets in gram_buckets(text):
            total += float(self.weights.take(buckets).sum())
            n += len(buckets)
        return total / n if n else 0.0


def gram_buckets(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in windows of bounded memory."""
    data = np.frombuffer(text, np.uint8)
    for start in range(0, len(data) - GRAM + 1, _WINDOW):
        part = data[start : start + _WINDOW + GRAM - 1].astype(np.uint32)
        n = len(part) - GRAM + 1
        gram = np.zeros(n, np.uint32)
        for k in range(GRAM):
            gram = gram * np.uint32(257) + part[k : k + n]
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x9E3779B1)
        yield (gram >> np.uint32(16)).astype(np.int64) % BUCKETS


def trusted_ids(labels: DataFrame, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Sorted ids of trusted texts, from a bounded number of labelled ids in hash order."""
    per_id = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
    )
    rows = per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect()
    return np.array(sorted(r.doc_id for r in rows if r.quality == 1), np.int64)


def bucket_counts(docs: DataFrame, trusted: np.ndarray) -> DataFrame:
    """(bucket, corpus, target): n-grams of all texts and of the trusted ones.

    Each task adds up its own part first and hands on one row per bucket it saw.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trusted)

    def run(batches):
        ids, totals = shared.value, np.zeros((2, BUCKETS), np.int64)
        waiting: tuple[list, list] = ([], [])
        sizes = [0, 0]

        def flush(side):
            if waiting[side]:
                totals[side] += np.bincount(np.concatenate(waiting[side]), minlength=BUCKETS)
                waiting[side].clear()
                sizes[side] = 0

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            at = np.searchsorted(ids, [-1 if x is None else x for x in own])
            for key, place, text in zip(own, at, texts_of(batch, "text")):
                side = int(key is not None and place < len(ids) and ids[place] == key)
                for buckets in gram_buckets(text):
                    waiting[side].append(buckets)
                    sizes[side] += len(buckets)
                    if sizes[side] >= _WINDOW:
                        flush(side)
        for side in (0, 1):
            flush(side)
        seen = np.flatnonzero(totals.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(totals.sum(axis=0)[seen]), pa.array(totals[1][seen])],
            names=["bucket", "corpus", "target"],
        )

    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "bucket long, corpus long, target long"
    )
    return parts.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Ratio:
    """Count both multinomials over all texts; at most ``BUCKETS`` rows reach the driver."""
    counts = np.zeros((2, BUCKETS))
    for r in bucket_counts(docs, trusted_ids(labels, max_labelled)).collect():
        counts[:, r.bucket] = r.corpus, r.target
    if not counts[1].sum():
        return Ratio(np.zeros(BUCKETS))
    corpus, target = counts
    scaled = corpus * (target.sum() / corpus.sum())
    # Both have the same total now, which cancels out.
    return Ratio(np.log(target + SMOOTHING) - np.log(scaled + SMOOTHING))


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, upto = Counter(windows), 0, 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def features(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, _SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def judge(docs: DataFrame, ratio: Ratio, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the features, ``base_failed``, ``llr`` and ``kept`` of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def compute(batch):
        rows = []
        for text in texts_of(batch, "text"):
            found, llr = features(text), shared.value.score(text)
            failed = found[0] < MIN_WORDS or 100 * found[4] > MAX_REPEAT_PERCENT * found[0]
            rows.append((*found, failed, llr, not failed and llr >= threshold))
        types = [pa.int64()] * len(FEATURES) + [pa.bool_(), pa.float64(), pa.bool_()]
        columns = zip(*rows) if rows else [[] for _ in types]
        return [pa.array(list(c), t) for c, t in zip(columns, types)]

    return add_columns(docs, FIELDS, compute)
