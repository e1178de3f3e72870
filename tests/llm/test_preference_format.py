"""Shared prompts, masks and pairing, edge cases and the SQL."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import TABLES, compare, connect
from pyspark.sql import functions as F

from plumbline.llm import preference_format
from plumbline.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    # 1 and 2 open alike and part at the second turn; 3 opens alone.
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello there"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (2, 2, "user", "more"), (2, 3, "assistant", "no"),
    (3, 0, "user", "ask"), (3, 1, "assistant", "reply"), (3, 2, "user", "thanks"),
    # No assistant turn: no pair. Two copies agree throughout.
    (4, 0, "user", "anyone?"),
    (5, 0, "user", "same"), (5, 1, "assistant", "é"), (6, 0, "user", "same"), (6, 1, "assistant", "é"),
    # Nulls, ties and repeated rows.
    (None, 0, "user", "lost"), (7, None, "system", None), (7, 1, None, "b"), (7, 1, None, "a"), (7, 1, None, "a"),
    (7, 2, "assistant", None), (8, 0, "assistant", "first words"),
]


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prompt", F.lit("clash")).withColumn("turns", F.lit(1))
    pairs = preference_format.preference_pairs(df)
    return {(r.chosen_id, r.rejected_id): r for r in preference_format.format_pairs(pairs).collect()}


def test_pairs_prompts_and_masks(spark):
    got = formatted(spark, ROWS)
    assert set(got) == {(1, 2), (3, 3), (5, 6), (7, 7), (8, 8)}
    r = got[1, 2]
    assert (r.kind, r.n_shared, r.prompt) == ("sibling", 1, "<|user|>\nhi<|end|>\n")
    assert r.chosen == "<|assistant|>\nhello there<|end|>\n"
    assert r.rejected == "<|assistant|>\nyo<|end|>\n<|user|>\nmore<|end|>\n<|assistant|>\nno<|end|>\n"
    assert [tuple(m) for m in r.rejected_mask] == [(14, 10, True), (9, 12, False), (14, 10, True)]
    r = got[3, 3]
    assert (r.kind, r.n_shared) == ("echo", 1)
    assert r.rejected == "<|assistant|>\nask<|end|>\n<|user|>\nthanks<|end|>\n"
    r = got[5, 6]
    assert (r.n_shared, r.chosen, r.rejected, r.chosen_mask) == (2, "", "", [])
    assert got[7, 7].prompt == "<|system|>\n<|end|>\n<||>\na<|end|>\n<||>\na<|end|>\n<||>\nb<|end|>\n"
    assert got[7, 7].rejected == "<|assistant|>\nb<|end|>\n"
    assert (got[8, 8].prompt, got[8, 8].rejected) == ("", "<|assistant|>\n<|end|>\n")
    assert formatted(spark, []) == {}


def test_masks_cover_the_completions(spark):
    for r in formatted(spark, ROWS).values():
        for text, spans in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            assert sum(m.header + m.body for m in spans) == len(text)
            at = 0
            for m in spans:
                assert text[at:].startswith("<|assistant|>") == m.learnt
                at += m.header + m.body


def test_long_conversation(spark):
    rows = [(c, i, ("user", "assistant")[i % 2], "w" * (i % 90) + str(c * (i > 2990))) for c in (1, 2) for i in range(3000)]
    got = formatted(spark, rows)
    assert got[2, 1].n_shared == 2991 if (2, 1) in got else got[1, 2].n_shared == 2991


def sql_of_rows(tmp_path, rows):
    columns = list(zip(*rows))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["conv_id", "turn", "role", "text"]
    for name in TABLES:
        pq.write_table(pa.table({"x": [1]}), tmp_path / f"{name}.parquet")
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)}), tmp_path / "conversations.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("own", [True, False])
def test_query_equals_its_sql(spark, tmp_path, own):
    folder = sql_of_rows(tmp_path, ROWS) if own else "/root/testdata/sf0.01"
    name = "op1_preference_format"
    assert compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name]) == ""
