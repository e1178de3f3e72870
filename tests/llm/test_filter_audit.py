"""Filter orders against brute force over all orders, path counts, cases and the SQL."""

import random
import re
from itertools import permutations
from math import factorial

from oracle import compare, connect

from plumbline.llm import filter_audit
from plumbline.llm.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def slow(docs, labels):
    judged = []
    for key, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^ \t-\r]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": re.search(r"[#$%&*|]", text) is not None,
            "E": any((t or "") == text and k is not None and (key is None or k < key) for k, t, _ in docs),
        }
        good = any(k is not None and k == key and q == 1 for k, q, _ in labels)
        toxic = any(k is not None and k == key and t == 1 for k, _, t in labels)
        judged.append((lang or "", {f for f, x in fails.items() if x}, good, toxic))
    rows, total = {}, {}
    for part in {j[0] for j in judged}:
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                own = [j for j in judged if j[0] == part]
                alive = [j for j in own if not j[1] & set(order[:i])]
                gone = [j for j in alive if f in j[1]]
                failing = sum(f in j[1] for j in own)
                total[part, f] = total.get((part, f), 0) + len(gone)
                rows[part, "".join(order), i + 1] = (
                    len(alive) - len(gone), len(gone), failing - len(gone), sum(j[1] == {f} for j in own),
                    sum(j[2] for j in gone), sum(j[3] for j in gone),
                )
    return sorted((*k, *v, total[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


def found(spark, docs, labels):
    rows = filter_audit.audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return sorted(map(tuple, rows.collect()))


def test_paths():
    for k in (1, 2, 3, 5):
        by = filter_audit.edges(k)
        assert len(by) == k << (k - 1)
        for state, f, orders in by:
            n = bin(state).count("1")
            assert orders == factorial(n) * factorial(k - n - 1)
        assert all(sum(w for _, g, w in by if g == f) == factorial(k) for f in range(k))
    assert len(filter_audit.steps("ABCDE")) == 600


def test_random_documents(spark):
    rng = random.Random(6)
    texts = ["", "Ab # c", "w " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"W{i}" for i in range(199)), "\x1f x | É"]
    texts += [" ".join(f"{rng.choice('aAbBc')}{rng.randint(0, 90)}" for _ in range(rng.randint(190, 215))) for _ in range(10)]
    docs = [(rng.choice([None, *range(40)]), rng.choice([None, *texts]), rng.choice(["en", "de", None, ""])) for _ in range(120)]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    got = found(spark, docs, labels)
    assert got == slow(docs, labels) and len(got) == 1800
    assert all(sum(r[c] for r in got) for c in range(3, 10))


def test_cases(spark):
    assert found(spark, [], []) == []
    docs = [(None, None, None), (None, "", None), (3, "", ""), (3, None, None), (4, "x" * 200_000, "de"), (5, "x" * 200_000, "de")]
    labels = [(None, 1, 1), (3, 0, 1), (3, 1, None)]
    assert found(spark, docs, labels) == slow(docs, labels)
    clash = spark.createDataFrame([(1, "a", "en", 2, "q")], f"{DOCS}, mask int, part string")
    assert filter_audit.audit_documents(clash, spark.createDataFrame([], LABELS)).count() == 600


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op12_filter_audit"](spark, folder), connect(folder), ORACLES["op12_filter_audit"]) == ""
