"""Archives and their index: round trips, lookups against a scan, and the SQL."""

import gzip
import hashlib

from oracle import compare, connect
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from plumbline.llm import capture_index
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "page_id long, url string, html string"


def read(df):
    return sorted((tuple(r) for r in capture_index.archive_and_read(df).collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_url_key(spark):
    urls = ["https://www.Example.com/a?b=C#d", "http://x.org", "no scheme/path", "", None, "ftp://a.b:80/?q"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = [r[0] for r in df.select(capture_index.url_key(F.col("url"))).collect()]
    assert got == ["com,example,www)/a?b=C#d", "org,x)", "no scheme)/path", "", "", "b:80,a)/?q"]


def test_record_round_trip():
    payload = "é\r\n\r\nWARC/1.1\r\n\r\n".encode()
    digest = hashlib.sha256(payload).hexdigest()
    assert capture_index.parsed(capture_index.record(5, "http://a b\n/", payload, digest, None)) == (len(payload), digest, "response", None)
    assert capture_index.parsed(capture_index.record(5, None, payload, digest, 3)) == (len(payload), digest, "revisit", 3)


def test_archives_are_valid_members(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/", f"page {i} " * 40) for i in range(30)], SCHEMA)
    captures = capture_index.write_archives(capture_index.record_types(df), archive_bytes=500).collect()
    assert len({r.archive for r in captures}) > 3
    for uri in {r.archive for r in captures}:
        fs, path = FileSystem.from_uri(uri)
        whole = fs.open_input_file(path).read()
        assert sum(r.length for r in captures if r.archive == uri) == len(whole)
        assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == sum(r.archive == uri for r in captures)


def test_lookups_equal_a_scan(spark):
    rows = [(i % 40, f"http://h{i % 7}.example.org/p", "x" * (i % 40)) for i in range(300)] + [(None, "http://h1.example.org/p", "q")]
    captures = capture_index.write_archives(capture_index.record_types(spark.createDataFrame(rows, SCHEMA)))
    index = capture_index.write_index(captures, block_lines=5)
    asked = captures.where("page_id % 3 = 0 OR page_id IS NULL").select("url_key", "page_id")
    missing = spark.createDataFrame([("zzz", 1), ("", 3), ("org,example,h1)/p", 4000)], "url_key string, page_id long")
    got = capture_index.lookup(index, asked.union(missing)).collect()
    expected = captures.where("page_id % 3 = 0 OR page_id IS NULL").select("page_id", "archive", "offset", "length").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, expected)) and len(got) > 90


def test_cases(spark):
    long, short = "long payload é " * 20, "short"
    rows = [
        (7, "http://a.org/1", long), (3, "http://a.org/2", long), (9, None, long), (None, "http://a.org/1", long),
        (4, "http://b.org/", short), (5, "http://b.org/", short), (6, "http://c.org", None), (8, "", ""), (3, "http://a.org/2", long),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("clash")).withColumn("offset", F.lit(1))
    n, d = len(long.encode()), sha(long)
    assert read(df) == sorted(
        [
            (7, n, d, "revisit", 3), (3, n, d, "response", None), (3, n, d, "response", None), (9, n, d, "revisit", 3),
            (None, n, d, "response", None), (4, 5, sha(short), "response", None), (5, 5, sha(short), "response", None),
            (6, 0, sha(""), "response", None), (8, 0, sha(""), "response", None),
        ],
        key=repr,
    )
    assert read(spark.createDataFrame([], SCHEMA)) == []


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op6_capture_index"](spark, folder), connect(folder), ORACLES["op6_capture_index"]) == ""
