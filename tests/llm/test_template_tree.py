"""Recurring line templates: planted lines, edge cases and the SQL."""

from oracle import compare, connect

from plumbline.llm import template_tree
from plumbline.llm.queries import ORACLES, QUERIES

LONG = "the quick brown fox jumps over the lazy dog while seven small birds watch from a very old tree"


def texts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(
        ((r.doc_id, r.text, r.dropped_lines) for r in template_tree.drop_recurring_lines(docs).collect()), key=repr
    )


def test_recurring_lines_stay_in_the_first_document(spark):
    rows = [(2, f"own words stand here\n{LONG}\nend"), (1, f"{LONG}\nother"), (3, LONG)]
    assert texts(spark, rows) == [(1, f"{LONG}\nother", 0), (2, "own words stand here\nend", 1), (3, "", 1)]


def test_variable_fields(spark):
    one = LONG.replace("seven small", "nine large")
    two = one.replace("old tree", "new house")
    rows = [(1, LONG), (2, one), (3, two), (4, "read 12 of 40 pages"), (5, "read 7 of 9 pages"), (6, "read some of the pages")]
    got = {k: t for k, t, _ in texts(spark, rows)}
    # 2 differs from 1 in one field, 3 from 2 in one; numbers are variable wherever they stand.
    assert got == {1: LONG, 2: "", 3: "", 4: rows[3][1], 5: "", 6: rows[5][1]}


def test_two_fields_or_other_leading_tokens_differ(spark):
    rows = [(1, LONG), (2, LONG.replace("fox", "cat").replace("old", "new")), (3, LONG.replace("quick", "slow")), (4, LONG + " x")]
    assert [d for *_, d in texts(spark, rows)] == [0, 0, 0, 0]


def test_cases(spark):
    rows = [
        (None, LONG), (1, LONG), (1, LONG), (2, None), (3, ""), (4, "\n\n"), (5, "short one\nshort one"), (6, "short one"),
        (7, f"{LONG}  \r\n{LONG}"), (8, "a b c d\na b c d"),
    ]
    got = texts(spark, rows)
    assert got == sorted(
        [
            (None, LONG, 0), (1, "", 1), (1, "", 1), (2, None, 0), (3, "", 0), (4, "\n\n", 0),
            (5, "short one\nshort one", 0), (6, "short one", 0), (7, "", 2), (8, "a b c d\na b c d", 0),
        ],
        key=repr,
    )
    assert texts(spark, []) == []


def test_further_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "x", LONG, 5), (2, "y", LONG, 6)], "doc_id long, line string, text string, n_lines int")
    got = template_tree.drop_recurring_lines(docs).orderBy("doc_id").collect()
    assert [r.asDict() for r in got] == [
        {"doc_id": 1, "line": "x", "text": LONG, "n_lines": 1, "dropped_lines": 0},
        {"doc_id": 2, "line": "y", "text": "", "n_lines": 1, "dropped_lines": 1},
    ]


def test_very_long_text(spark):
    many = "\n".join(f"{LONG} {'x' * (i % 50)} {chr(97 + i % 26)}" for i in range(20_000))
    got = dict((k, d) for k, _, d in texts(spark, [(1, many), (2, many)]))
    assert got == {1: 0, 2: 20_000}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(QUERIES["op9_template_tree"](spark, folder), connect(folder), ORACLES["op9_template_tree"]) == ""


def test_plan_has_no_python(spark, capsys):
    QUERIES["op9_template_tree"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
