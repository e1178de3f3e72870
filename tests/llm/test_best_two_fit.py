"""Tokens against the public library, packing against its own rules one by one."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import best_two_fit
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    own.encode_special_tokens = True
    return own


ODD = ["", " \n", "Hello  World\x0bnew\x1ca b", "é ́x ạ́", "don't I'LL 123 '", "日本 🙂🙂", "İSTANBUL ΣΑΣ", "J̌ ǰ J̌x A\u030a I\u0307 K\u0327", "<|endoftext|> x"]


def test_tokens_equal_the_library(library):
    got = list(best_two_fit.encode([t.encode() for t in ODD], PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_plain_words_equal_the_library(library):
    rng = random.Random(9)
    letters = "aeinrstxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", ",", "..", "!"]) for _ in range(3000)]
    words += ["a×b", "÷", "×.", "ª", "µm", "a-b.", "1.", "é."]
    got = list(best_two_fit.encode([w.encode() for w in words], PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_long_texts_are_encoded_in_parts(library, monkeypatch):
    monkeypatch.setattr(best_two_fit, "_GROUP", 50)
    texts = ["word " * 100 + "end", "x" * 400, "short", "a b\n" * 40]
    got = list(best_two_fit.encode([t.encode() for t in texts], PATH))
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def one_by_one(counts, size):
    """The method on single pieces, without repeats of a pattern."""
    left = sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)
    out = []
    while left:
        used, gap = [], size
        while fit := [x for x in left if x <= gap][:1]:
            left.remove(fit[0])
            used.append(fit[0])
            gap -= fit[0]
        small = min(used)
        pairs = [(left[i] + left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] <= gap + small]
        if gap and pairs and max(pairs) > small:
            best = max(pairs)
            a, b = next((left[i], left[j]) for i in range(len(left)) for j in range(i + 1, len(left)) if left[i] + left[j] == best)
            used.remove(small)
            left.remove(a), left.remove(b)
            left = sorted([*left, small], reverse=True)
            used += [a, b]
        out.append(sum(used))
    return out


def check(rows, counts, size):
    """Every piece has one place and every sequence is gapless."""
    seen, spans = defaultdict(int), defaultdict(list)
    for k, first, repeats, sequence, offset in rows.tolist():
        nxt = min([r[1] for r in rows.tolist() if r[0] == k and r[1] > first], default=counts[k])
        for rank in range(first, nxt):
            seen[k] += 1
            place = rank - first
            spans[sequence + place % repeats].append((offset + place // repeats * k, k))
    assert dict(seen) == {k: n for k, n in counts.items() if n}
    for own in spans.values():
        at = 0
        for offset, k in sorted(own):
            assert offset == at
            at += k
        assert at <= size
    return len(spans)


@pytest.mark.parametrize("seed", range(12))
def test_plan(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 12) for _ in range(rng.randint(1, 14))}
    expected = one_by_one(counts, 40)
    n = check(best_two_fit.plan(counts, 40), counts, 40)
    assert n <= len(expected) + 1 and n >= -(-sum(k * c for k, c in counts.items()) // 40)


def test_large_counts_are_planned_at_once():
    counts = {k: 10**9 + k for k in range(1, 2049)}
    rows = best_two_fit.plan(counts)
    assert len(rows) < 40_000
    total = sum(k * c for k, c in counts.items())
    assert (rows[:, 3] + rows[:, 2]).max() <= 1.01 * total / 2048


def test_two_for_one():
    stock = best_two_fit._Stock({7: 1, 2: 1})
    stock.left, stock.lengths = {6: 1, 3: 1, 2: 2}, [2, 3, 6]
    # 6 + 3 leaves 1; 3 is given back for 2 + 2.
    assert best_two_fit.pattern(stock, 10) == {6: 1, 2: 2}


def whole(rows, size=2048):
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for own in spans.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(spans)


def test_cases(spark):
    long = "tokens of words " * 900
    rows = [(1, long), (1, long), (None, None), (2, ""), (3, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("clash"))
    got = best_two_fit.pack(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length) for r in got) == [
        (0, 0, 0, 1), (1, 0, 0, 2048), (1, 0, 0, 2048), (1, 1, 2048, 653), (1, 1, 2048, 653), (2, 0, 0, 1), (3, 0, 0, 4)
    ]
    assert whole(got) == 3
    assert best_two_fit.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    expected = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = np.array(library.encode(r.text, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected.add((r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())))
    got = QUERIES["op3_best_two_fit"](spark, folder).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == expected and len(got) == len(expected)
    assert whole(got) <= -(-sum(r.length for r in got) // 2048) + 1
