"""Divergences of sources against brute force in whole numbers, cases and the SQL."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from oracle import compare, connect

from plumbline.llm import source_audit
from plumbline.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string, source string"


def slow(docs, least=10, top=10):
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in docs:
        small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", small)
        counts[lang or "", source or ""].update(terms)
        held[lang or ""].update(set(terms))
    out = []
    for lang in held:
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        sources = sorted(s for x, s in counts if x == lang)
        whole = sum((counts[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(rows[: None if part == "pair" else top])]
    return sorted(out)


def found(spark, docs, **parameters):
    rows = source_audit.divergences(spark.createDataFrame(docs, DOCS), **parameters)
    assert rows.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, rows.collect()))


def sample(n):
    rng = random.Random(9)
    words = ["Ab", "cé", "日本", "d1e", "F_g", "h'i", "ÀB", "\x00j", "k😀", *[f"w{chr(97 + i)}" for i in range(26)]]
    return [
        (rng.choice([None, 1, i]), rng.choice([None, "", *[" ".join(rng.choices(words, k=rng.randint(1, 60)))] * 8]),
         rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"]))
        for i in range(n)
    ]


def test_random_documents(spark):
    docs = sample(300)
    wanted = slow(docs)
    assert found(spark, docs) == wanted and {r[2] for r in wanted} == {"pair", "term"}
    # The same from shards of few terms.
    assert found(spark, docs, shard_terms=3) == wanted
    assert found(spark, docs, min_documents=40, top=2) == slow(docs, 40, 2)


def test_partial_counts_are_flushed_and_cut(spark):
    docs = spark.createDataFrame(sample(200), DOCS).coalesce(1)
    whole = source_audit.kept_terms(source_audit.partial_counts(docs), 1)
    parts = source_audit.kept_terms(source_audit.partial_counts(docs, slice_bytes=300, held_rows=50), 1)
    rows = [sorted((r.lang, r.term, r.total, sorted(map(tuple, r.by_source))) for r in x.collect()) for x in (whole, parts)]
    assert rows[0] == rows[1] and len(rows[0]) > 50


def test_shares_of_very_large_counts():
    counts, total = np.array([0, 7, 9 * 10**14]), 9 * 10**14 + 31
    assert source_audit.shares(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]


def test_cases(spark):
    assert found(spark, []) == []
    # No kept terms: pairs of value 0, in order of their names.
    docs = [(1, "one two", "en", "b"), (2, None, "en", "a"), (3, "", "en", None), (4, "x", None, "only")]
    assert found(spark, docs) == slow(docs) == [
        ("en", "", "pair", "a", 0, 1), ("en", "", "pair", "b", 0, 2), ("en", "a", "pair", "", 0, 1),
        ("en", "a", "pair", "b", 0, 2), ("en", "b", "pair", "", 0, 1), ("en", "b", "pair", "a", 0, 2),
    ]
    # Repeated rows are documents of their own; ties go by name; a very long text.
    docs = [(1, "Tie tie eit", "en", "a")] * 12 + [(2, "eit other", "en", "b")] * 12 + [(3, "long " * 300_000, "en", "c")] * 10
    assert found(spark, docs) == slow(docs)
    clash = spark.createDataFrame([(*d, 1, "x") for d in docs[:24]], f"{DOCS}, shard int, term string")
    assert sorted(map(tuple, source_audit.divergences(clash).collect())) == slow(docs[:24])


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op13_source_audit"](spark, folder), connect(folder), ORACLES["op13_source_audit"]) == ""
