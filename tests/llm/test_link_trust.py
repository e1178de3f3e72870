"""Hosts, rules, spreading of trust against a plain loop, and the SQL."""

from collections import defaultdict

import duckdb
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from plumbline.llm import link_trust
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string"
PAGES = [
    (1, "https://A.example.ORG/fr/x?q#f", None),
    (2, "http://example.org/es/1", '<a href="http://bad.net/x">b</a>'),
    (3, "http://w.example.org/en/12", ""),
    (4, "http://org/", '<a href="//good.net/">g</a>'),
    (5, "http://notorg/", ""),
    (6, "http://x.com/fr/", '<A HREF=https://good.net?y>'),
    (7, "http://x.com/de/9", ""),
    (8, "http://x.com/en/", ""),
    (9, None, '<a href="http://bad.net">'),
    (10, "no scheme", ""),
    (11, "http://bad.net/", '<a href="http://example.org/es/1">'),
    (12, "http://good.net", ""),
    (13, "x://y://Z.net/p/a?b/c", ""),
    (14, "http://org", ""),
    (14, "http://org", ""),
    (15, "http://example.org?x", ""),
]


def judged(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("host", F.lit("clash")).withColumn("mass", F.lit(1))
    return link_trust.judge(df).collect()


def test_hosts_rules_and_verdicts(spark):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judged(spark, PAGES)}
    assert got == {
        1: ("a.example.org", "/fr/x", "org/", "allow"),
        2: ("example.org", "/es/1", "example.org/es/", "block"),
        3: ("w.example.org", "/en/12", "example.org/en/1", "block"),
        4: ("org", "/", "org/", "allow"),
        5: ("notorg", "/", None, "allow"),
        6: ("x.com", "/fr/", "com/fr/", "allow"),
        7: ("x.com", "/de/9", "com/de/", "block"),
        8: ("x.com", "/en/", None, "allow"),
        9: ("", "", None, "allow"),
        10: ("", "", None, "allow"),
        11: ("bad.net", "/", None, "block"),
        12: ("good.net", "", None, "allow"),
        13: ("y:", "//Z.net/p/a", None, "allow"),
        14: ("org", "", None, "allow"),
        15: ("example.org", "", None, "block"),
    }


def test_repeated_rows_and_no_rows(spark):
    assert len(judged(spark, PAGES)) == len(PAGES)
    assert judged(spark, []) == []


def slow(edges, seeds, settled):
    """One round after the other; every four rounds the mass of both kinds is compared with four rounds before."""
    kinds, total = {k for k, _ in seeds}, defaultdict(int)
    pages = {kind: sum(v for (k, _), v in seeds.items() if k == kind) for kind in kinds}
    for (k, s, _), w in edges.items():
        total[k, s] += w
    fresh = {(k, h): link_trust.UNITS // pages[k] * v * 15 // 100 for (k, h), v in seeds.items()}
    mass, before = fresh, 0
    while sum(mass.values()) - before >= link_trust.UNITS // settled:
        before = sum(mass.values())
        for _ in range(4):
            new = defaultdict(int, fresh)
            for (k, s, d), w in edges.items():
                if (k, s) in mass:
                    new[k, d] += mass[k, s] * 85 // (100 * total[k, s]) * w
            mass = new
    return dict(mass)


@pytest.mark.parametrize("hot", [100_000, 2])
def test_propagation_equals_a_loop(spark, monkeypatch, hot):
    monkeypatch.setattr(link_trust, "HOT_LINKS", hot)
    edges = {(k, f"h{a}", f"h{b}"): a + b for k in ("trust", "distrust") for a in range(9) for b in range(9) if a != b and (a * b) % 4 == 0}
    seeds = {("trust", "h1"): 3, ("trust", "h4"): 1, ("distrust", "h8"): 7}
    links = spark.createDataFrame([(*k, n) for k, n in edges.items()], "kind string, src string, dst string, n long")
    start = spark.createDataFrame([(*k, n) for k, n in seeds.items()], "kind string, host string, n long")
    got = {(r.kind, r.host): r.mass for r in link_trust.propagate(links, start, 100).collect()}
    assert got == slow(edges, seeds, 100)


def test_distrust_reaches_far_hosts(spark, tmp_path):
    """A chain of 22 pages that ends at a blocked host: all of them are blocked, in the SQL too."""
    rows = [(i, f"http://h{i}.net/", f'<a href="http://h{i + 1}.net/">') for i in range(21)]
    rows += [(21, "http://h21.net/", '<a href="http://example.org/es/">'), (22, "http://example.org/es/", "")]
    pages = spark.createDataFrame(rows, SCHEMA)
    pages.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    got = link_trust.judge(pages)
    assert {r.page_id: r.verdict for r in got.collect()} == {i: "block" for i in range(23)}
    assert compare(got, con, link_trust.SQL) == ""


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op5_link_trust"](spark, folder), connect(folder), ORACLES["op5_link_trust"]) == ""
