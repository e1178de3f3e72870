"""Planted copies with short lines: one document of each group is left after the line and copy stages."""

from test_near_copies import FOLDER, changed, words

import corpus_pipeline


def text(own, *short):
    cut = [" ".join(own[i : i + 12]) for i in range(0, len(own), 12)]
    return "\n".join(x for pair in zip(cut, [*short, *["Ok."] * len(cut)]) for x in pair)


def test_one_document_of_each_group(spark):
    docs, groups = {}, []
    for k in range(12):
        own = words(k, 240)
        near = changed(own, {50, 150}, "q")
        groups.append([10 * k, 10 * k + 1, 10 * k + 2])
        docs |= dict(zip(groups[-1], [text(own, f"Head{k}."), text(own, f"Head{k}."), text(near, f"Head{k}.")]))
    # The near copy of the first group alone shares a line with another document, which keeps it.
    line = " ".join(words(77, 9))
    docs[2] += f"\n{line}"
    docs[500] = f"{' '.join(words(50, 60))}\n{line}"
    # Documents of nothing but recurring lines are emptied; one of them stays.
    docs |= {600: line, 601: line}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    left = corpus_pipeline.line_dedup(spark, rows, FOLDER)
    kept = {r.doc_id: r.text for r in corpus_pipeline.near_duplicates(spark, left, FOLDER).collect()}
    assert set(kept) == {g[0] for g in groups} | {500, 600}
    assert kept[500] == docs[500] and kept[0] == docs[0] and kept[600] == ""


def test_names_of_columns_change_nothing(spark):
    own = words(5, 200)
    rows = [(1, text(own), True, 7), (2, text(own), False, 8), (3, text(words(6, 200)), True, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_copy boolean, n long")
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_duplicates):
        docs = stage(spark, docs, FOLDER)
        assert docs.columns == ["doc_id", "text", "is_copy", "n"]
    assert sorted((r.doc_id, r.is_copy, r.n) for r in docs.collect()) == [(1, True, 7), (3, True, 9)]
