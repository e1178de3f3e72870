"""The pipeline's rows against a plain version of all four stages."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_best_two_fit import whole
from test_near_copies import kept_ids
from test_ngram_ratio import slow_verdicts
from tokenizers import Tokenizer

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"


def slow_templates(line):
    words = re.findall(r"[^ \t-\r]+", re.sub(r"[^ \t-\r]*[0-9][^ \t-\r]*", "<*>", line))
    n = len(words)
    out = [("whole", tuple(words))] if n >= 4 else []
    if n >= 15:
        for j in range(5):
            a, b = (n - 2) * j // 5 + 2, (n - 2) * (j + 1) // 5 + 2
            out.append((j, n, tuple(words[:a]), tuple(words[b:])))
    return out


def n_tokens(text):
    return len(re.findall(r"[^ \t-\r]+", text))


def slow_line_dedup(docs):
    ids = defaultdict(set)
    for key, text in docs.items():
        for line in text.split("\n"):
            for t in slow_templates(line):
                ids[t].add(key)
    # hits[document][line] are the templates that an earlier document holds.
    hits = {k: {i: {t for t in slow_templates(x) if min(ids[t]) != k} for i, x in enumerate(v.split("\n"))} for k, v in docs.items()}
    copies = set()
    for key, text in docs.items():
        shared = defaultdict(int)
        for i, line in enumerate(text.split("\n")):
            for first in {min(ids[t]) for t in hits[key][i]}:
                shared[first] += n_tokens(line)
        for first, n in shared.items():
            if n >= 0.5 * n_tokens(text) and n >= 0.5 * (n_tokens(text) + n_tokens(docs[first]) - n):
                copies.add(key)
    heirs = {}
    for key in sorted(set(docs) - copies):
        for t in set().union(*hits[key].values()):
            if min(ids[t]) in copies:
                heirs.setdefault(t, key)
    return {
        key: text if key in copies else "\n".join(
            x for i, x in enumerate(text.split("\n")) if all(heirs.get(t) == key for t in hits[key][i])
        )
        for key, text in docs.items()
    }


@pytest.fixture(scope="module")
def expected(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    kept = {v[0] for v in slow_verdicts(list(docs.items()), labels) if v[-1]}
    first = {k: v for k, v in docs.items() if k in kept}
    second = slow_line_dedup(first)
    kept = kept_ids(second)
    return [first, second, {k: v for k, v in second.items() if k in kept}]


def test_stages(spark, expected):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        docs = stage(spark, docs, FOLDER).cache()
        assert docs.columns == columns
        assert {r.doc_id: r.text for r in docs.collect()} == wanted
    assert len(expected[0]) > len(expected[2]) > 50 and expected[0] != expected[1]


def test_run(spark, expected):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = set()
    for key, text in expected[2].items():
        ids = np.array(own.encode(text, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            wanted.add((key, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())))
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == wanted and len(got) == len(wanted)
    whole(got)


def test_nulls_repeats_and_no_rows(spark):
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, text, None, None, None), (None, text, "en", "b", 1), (3, None, "en", "b", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, text), (3, None)]
    slim = corpus_pipeline.line_dedup(spark, docs, FOLDER).collect()
    # Copies stay whole for the stage that removes them.
    assert sorted((r.doc_id or 0, r.text or "", r.n_chars or 0) for r in slim) == [
        (0, text, len(text)), (1, text, len(text)), (1, text, len(text)), (2, text, len(text)), (3, "", 0)
    ]
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0
