"""Features and ratios against plain loops, edge cases, and held-out accuracy."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import ngram_ratio
from plumbline.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def slow_features(text):
    words = [w for w in "".join(c if c not in " \t\n\r\x0b\x0c" else " " for c in text or "").split(" ") if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def slow_buckets(text):
    data = (text or "").encode()
    out = []
    for i in range(len(data) - 3):
        x = 0
        for b in data[i : i + 4]:
            x = (x * 257 + b) % 2**32
        x = ((x ^ (x >> 15)) * 0x9E3779B1) % 2**32
        out.append(x >> 16)
    return out


def slow_verdicts(rows, labels):
    by_id = {}
    for k, q in labels:
        by_id.setdefault(k, set()).add(q)
    corpus, target = Counter(), Counter()
    for k, text in rows:
        corpus.update(slow_buckets(text))
        if by_id.get(k) == {1}:
            target.update(slow_buckets(text))
    share = sum(target.values()) / max(sum(corpus.values()), 1)

    def weight(b):
        return math.log((target[b] + 5) / (corpus[b] * share + 5)) if target else 0.0

    out = []
    for k, text in rows:
        own, buckets = slow_features(text), slow_buckets(text)
        score = sum(map(weight, buckets)) / len(buckets) if buckets else 0.0
        failed = own[0] < 50 or 100 * own[4] > 50 * own[0]
        out.append((k, *own, failed, round(score, 9), not failed and score >= ngram_ratio.THRESHOLD))
    return sorted(out, key=repr)


def verdicts(df):
    names = ["doc_id", *ngram_ratio.FEATURES, "base_failed", "llr", "kept"]
    return sorted((tuple(round(r[c], 9) if c == "llr" else r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "text",
    ["", " \n\n", "a b c a b c a b", "x\ny\nx\n x\n\n", "a a a a a", "é b\x1cc #*<|>\x0bd", "a b\r\na b\r\n", "w " * 5000],
)
def test_features(text):
    assert ngram_ratio.features(text.encode()) == slow_features(text)


def test_windows_of_long_texts(monkeypatch):
    text = ("abcdefgh é " * 60).encode()
    whole = [b for part in ngram_ratio.gram_buckets(text) for b in part.tolist()]
    monkeypatch.setattr(ngram_ratio, "_WINDOW", 7)
    assert [b for part in ngram_ratio.gram_buckets(text) for b in part.tolist()] == whole == slow_buckets(text.decode())


def test_cases(spark):
    good, bad = "ordinary words of plain text " * 3, "%%% $$$ ### &&& " * 20
    rows = [(1, good), (1, good), (2, bad), (None, good), (3, None), (4, ""), (5, "a"), (6, " ".join(f"word{i}" for i in range(60)))]
    labels = [(1, 1), (2, 0), (6, 1), (6, 0), (None, 1), (4, None), (99, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    given = spark.createDataFrame(labels, "doc_id long, quality int")
    got = ngram_ratio.judge(docs, ngram_ratio.fit(docs, given))
    assert verdicts(got) == slow_verdicts(rows, [x for x in labels if None not in x])
    none = ngram_ratio.fit(docs, given.limit(0))
    assert verdicts(ngram_ratio.judge(docs, none)) == slow_verdicts(rows, [])
    empty = docs.limit(0)
    assert ngram_ratio.judge(empty, ngram_ratio.fit(empty, given)).count() == 0


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    assert verdicts(QUERIES["op10_ngram_ratio"](spark, folder)) == slow_verdicts(rows, labels)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    ratio = ngram_ratio.fit(docs.where("doc_id % 2 = 0"), labels)
    judged = ngram_ratio.judge(docs.where("doc_id % 2 = 1"), ratio).join(labels, "doc_id").where("NOT base_failed")
    rows = judged.select("quality", "kept").collect()
    assert len(rows) > 100 and sum(r.kept == (r.quality == 1) for r in rows) >= 0.98 * len(rows)
