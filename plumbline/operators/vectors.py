"""Bag-of-words and TF-IDF in long form: (document, term, weight) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.text import STOP_WORDS, bind, drop_stop_words, tokens
from plumbline.operators.skew import join_per_key
from plumbline.session import written_table

# Rows whose words one task cuts; each has some hundreds.
DOCS_PER_TASK = 4_000
# Bytes of words whose terms are counted at once.
_PIECE = 8 << 20
# A piece reports so many times the terms wanted, and at most so many times them are counted again.
_REPORTED = 4
_COUNTED = 40


def document_words(
    df: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    stop_words: list[str] = STOP_WORDS,
    n_docs: int | None = None,
) -> DataFrame:
    """(id, words) of every document, stored: a line of kept words for each text of the id.

    Texts are shuffled once, by id, ``DOCS_PER_TASK`` rows a task, and cut into words once,
    whatever is counted of them afterwards.
    """
    n_docs = df.count() if n_docs is None else n_docs
    tasks = max(1, -(-n_docs // DOCS_PER_TASK))
    texts = (
        df.select(id_col, text_col).repartition(tasks, id_col).groupBy(id_col).agg(F.collect_list(text_col).alias("texts"))
    )
    lines = F.transform("texts", lambda t: F.array_join(drop_stop_words(tokens(t), stop_words), " "))
    return written_table(texts.select(id_col, F.array_join(lines, "\n").alias("words")), "words")


def _pieces(low: int, high: int):
    """Term counts of bounded pieces of a batch of documents.

    Built inside a function, so that it travels to the workers by value.
    """
    piece_bytes = _PIECE

    def counted(words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct terms, and by document: its place, number of the term, tf)."""
        lines = pc.split_pattern(words, "\n")
        toks = pc.split_pattern(pc.list_flatten(lines), " ")
        of_line, found = pc.list_parent_indices(toks).to_numpy(), pc.list_flatten(toks).dictionary_encode()
        known, codes = found.dictionary, found.indices.to_numpy().astype(np.int64)
        some = pc.not_equal(known, "").to_numpy(zero_copy_only=False)[codes] if len(codes) else np.zeros(0, bool)
        codes, of_line = codes[some], of_line[some]
        doc_of = pc.list_parent_indices(lines).to_numpy()[of_line]
        names, terms, docs, first = [], [], [], 0
        run, grams = codes, known
        for n in range(1, high + 1):
            if n > 1:
                starts = np.nonzero(of_line[: max(0, len(of_line) - n + 1)] == of_line[n - 1 :])[0]
                last = np.full(len(codes), -1)
                new, keys = pd.factorize(run[starts] * max(1, len(known)) + codes[starts + n - 1])
                grams = pc.binary_join_element_wise(
                    grams.take(pa.array(keys // max(1, len(known)))), known.take(pa.array(keys % max(1, len(known)))), " "
                )
                last[starts] = new
                run = last
            else:
                starts = np.arange(len(codes))
            if n >= low:
                names.append(grams)
                terms.append(first + run[starts])
                docs.append(doc_of[starts])
                first += len(grams)
        key, tf = np.unique(np.concatenate(docs).astype(np.int64) * max(1, first) + np.concatenate(terms), return_counts=True)
        return pa.concat_arrays(names), key // max(1, first), key % max(1, first), tf

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(ids, terms, places of documents, numbers of terms, tfs)."""
        for batch in batches:
            ids, words = batch.column(0), batch.column(1)
            ends = np.cumsum(pc.binary_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = np.nonzero(np.diff(ends // piece_bytes, prepend=0))[0]
            for a, b in zip([0, *cuts], [*cuts, len(words)]):
                if a < b:
                    yield ids[a:b], *counted(words[a:b])

    return pieces


def _mapped(words: DataFrame, low: int, high: int, make: Callable, schema: str) -> DataFrame:
    """Rows that ``make`` gives for each piece of documents."""
    pieces = _pieces(low, high)

    def run(batches):
        for piece in pieces(batches):
            yield pa.RecordBatch.from_pydict(make(*piece))

    return words.mapInArrow(run, schema)


def term_counts(
    df: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    low: int = 1,
    high: int = 2,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    """(id, term, tf) of every document, counted some thousands of documents at a time."""
    return _counts_of(document_words(df, id_col, text_col, stop_words), low, high)


def _counts_of(words: DataFrame, low: int, high: int) -> DataFrame:
    id_col = words.columns[0]

    def rows(ids, terms, docs, numbers, tf):
        return {id_col: ids.take(pa.array(docs)), "term": terms.take(pa.array(numbers)), "tf": pa.array(tf, pa.int64())}

    return _mapped(words, low, high, rows, f"`{id_col}` {words.schema[id_col].dataType.simpleString()}, term string, tf long")


def run_lengths(values: Column) -> Column:
    """(term, tf) of the runs of a sorted array."""

    def runs(v: Column) -> Column:
        places = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1))
        first = F.filter(places, lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))

        def lengths(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(v, at).alias("term"),
                    (F.coalesce(F.get(starts, k + 1), F.size(v)) - at).cast("long").alias("tf"),
                ),
            )

        return bind(first, lengths)

    return bind(values, runs)


def vocabulary(
    counts: DataFrame,
    n_docs: Column,
    min_df: int = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    counted: bool = False,
) -> DataFrame:
    """(term, df): terms in enough and not too many documents, most frequent first.

    ``counts`` has a row per document and term or, where ``counted``, sums of such rows with their ``df``.
    """
    df = F.sum("df") if counted else F.count(F.lit(1))
    terms = counts.groupBy("term").agg(df.alias("df"), F.sum("tf").alias("total"))
    kept = terms.where((F.col("df") >= min_df) & (F.col("df") <= n_docs * F.lit(float(max_df))))
    if max_features:
        kept = kept.orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    return kept.select("term", "df")


def _totals(terms: pa.Array, numbers: np.ndarray, tf: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(terms, df, total) of the terms that a piece has."""
    df = np.bincount(numbers, minlength=len(terms))
    total = np.bincount(numbers, tf, len(terms)).astype(np.int64)
    return terms.filter(pa.array(df > 0)).cast(pa.string()), df[df > 0], total[df > 0]


def frequent_terms(
    words: DataFrame, n_docs: int, min_df: int, max_df: float, max_features: int, low: int = 1, high: int = 2
) -> DataFrame:
    """``vocabulary`` of ``document_words``, without a shuffle of all terms.

    Each piece of documents reports its most frequent terms and the largest total of the
    others. A term's total exceeds what was reported of it by at most the sum of the latter,
    so few can be among the first ``max_features``; these alone are counted in all documents.
    Where the reports leave too many, all terms are counted.
    """
    wanted = max_features * _REPORTED

    def report(ids, terms, docs, numbers, tf):
        terms, df, total = _totals(terms, numbers, tf)
        order = np.argsort(-total, kind="stable")
        told, rest = order[:wanted], order[wanted:]
        names = pa.concat_arrays([terms.take(pa.array(told)), pa.array([None], pa.string())])
        # The row without a term has the largest total of those left out.
        most = int(total[rest[0]]) if len(rest) else 0
        return {"term": names, "df": np.append(df[told], 0), "total": np.append(total[told], most)}

    schema = "term string, df long, total long"
    reports = written_table(_mapped(words, low, high, report, schema), "reports")
    sums = reports.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    sums = written_table(sums, "reported")
    missed = sums.where(F.col("term").isNull()).agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    told = sums.where(F.col("term").isNotNull())
    sure = told.where((F.col("df") >= min_df) & (F.col("df") + missed <= n_docs * float(max_df)))
    last = sure.orderBy(F.desc("total")).limit(max_features).agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("t")).first()
    least = last["t"] if last["n"] == max_features else 0
    n = F.lit(n_docs)
    if not missed:
        return vocabulary(told.withColumnRenamed("total", "tf"), n, min_df, max_df, max_features, counted=True)
    possible = told.where(F.col("total") + missed >= least).select("term").limit(max_features * _COUNTED + 1)
    asked = [r["term"] for r in possible.collect()] if least > missed else []
    enough = bool(asked) and len(asked) <= max_features * _COUNTED

    def count(ids, terms, docs, numbers, tf):
        terms, df, total = _totals(terms, numbers, tf)
        if enough:
            mine = pc.is_in(terms, value_set=pa.array(asked, terms.type)).to_numpy(zero_copy_only=False)
            terms, df, total = terms.filter(pa.array(mine)), df[mine], total[mine]
        return {"term": terms, "df": df, "total": total}

    counts = _mapped(words, low, high, count, schema).withColumnRenamed("total", "tf")
    return vocabulary(counts, n, min_df, max_df, max_features, counted=True)


def document_count(df: DataFrame) -> Column:
    """Number of rows as a scalar subquery."""
    return df.select(F.count(F.lit(1))).scalar()


def bag_of_words(
    df: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    min_df: int = 5,
    low: int = 1,
    high: int = 2,
    stop_words: list[str] = STOP_WORDS,
) -> DataFrame:
    counts = term_counts(df, id_col, text_col, low, high, stop_words)
    kept = vocabulary(counts, document_count(df), min_df)
    joined = join_per_key(counts, kept, ["term"], id_col, how="inner", counts=kept)
    return joined.select(id_col, "term", "tf")


def tfidf(
    df: DataFrame,
    id_col: str = "review_id",
    text_col: str = "review_text",
    min_df: int = 5,
    max_df: float = 0.9,
    max_features: int | None = 5000,
    low: int = 1,
    high: int = 2,
    stop_words: list[str] = STOP_WORDS,
    kept: DataFrame | None = None,
    words: DataFrame | None = None,
    by_document: bool = False,
) -> DataFrame:
    """(id, term, weight): tf * (ln((1+n)/(1+df)) + 1), each document of length 1.

    The vocabulary is sent to the tasks only when ``max_features`` bounds it; otherwise
    terms of very many documents are salted. ``kept`` is that vocabulary, (term, df), and
    ``words`` the ``document_words`` of ``df``, where they are known already. ``by_document`` gives
    one row per document, (id, weights), so that joins by id move documents and not terms.
    """
    n_docs = df.count()
    if words is None:
        words = document_words(df, id_col, text_col, stop_words, n_docs)
    idf = F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1
    if max_features:
        if kept is None:
            kept = frequent_terms(words, n_docs, min_df, max_df, max_features, low, high)
        return _weights(words, kept.select("term", idf.alias("idf")).collect(), low, high, by_document)
    counts = _counts_of(words, low, high)
    if kept is None:
        kept = vocabulary(counts, F.lit(n_docs), min_df, max_df)
    raw = join_per_key(counts, kept.select("term", idf.alias("idf")), ["term"], id_col, how="inner", counts=kept)
    raw = raw.withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id_col)))
    weights = raw.select(id_col, "term", (F.col("w") / length).alias("weight"))
    if not by_document:
        return weights
    return weights.groupBy(id_col).agg(F.collect_list(F.struct("term", "weight")).alias("weights"))


def _weights(words: DataFrame, vocab: list, low: int, high: int, by_document: bool) -> DataFrame:
    """Weights over a bounded vocabulary of (term, idf) rows."""
    id_col = words.columns[0]
    names, idfs = [r["term"] for r in vocab], np.array([r["idf"] for r in vocab])

    def weigh(ids, terms, docs, numbers, tf):
        place = pc.index_in(terms, value_set=pa.array(names, terms.type)).fill_null(-1).to_numpy()[numbers]
        mine = place >= 0
        docs, numbers, w = docs[mine], numbers[mine], tf[mine] * idfs[place[mine]]
        w = w / np.sqrt(np.bincount(docs, w * w, len(ids)))[docs]
        held = terms.take(pa.array(numbers)).cast(pa.string())
        if not by_document:
            return {id_col: ids.take(pa.array(docs)), "term": held, "weight": w}
        n = np.bincount(docs, minlength=len(ids))
        some = pa.array(n > 0)
        rows = pa.StructArray.from_arrays([held, pa.array(w)], ["term", "weight"])
        cuts = pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32))
        return {id_col: ids.filter(some), "weights": pa.ListArray.from_arrays(cuts, rows)}

    kind = words.schema[id_col].dataType.simpleString()
    more = "weights array<struct<term: string, weight: double>>" if by_document else "term string, weight double"
    return _mapped(words, low, high, weigh, f"`{id_col}` {kind}, {more}")


def _joined(weights: DataFrame, others: DataFrame, id_col: str) -> DataFrame:
    """Weights, in long form or by document, with the columns of ``others``."""
    joined = weights.join(others, id_col)
    if "weights" not in weights.columns:
        return joined
    return joined.select(*[c for c in joined.columns if c != "weights"], F.inline("weights"))


def mean_weights(weights: DataFrame, n_docs: Column) -> DataFrame:
    """Mean weight per term over all documents, absent terms counting 0."""
    return weights.groupBy("term").agg((F.sum("weight") / F.first(n_docs)).alias("mean_weight"))


def top_terms(means: DataFrame, n: int = 15, words: int | None = None) -> DataFrame:
    """Highest mean weights; ``words=2`` keeps bigrams only."""
    if words:
        means = means.where(F.size(F.split("term", " ")) == words)
    return means.orderBy(F.desc("mean_weight"), F.asc("term")).limit(n)


def lexical_lean(
    weights: DataFrame, df: DataFrame, id_col: str = "review_id", n: int = 8
) -> DataFrame:
    """Terms whose mean weight differs most between unverified and verified rows."""
    flag = F.col("verified_purchase")
    sizes = df.select(
        F.struct(F.count_if(flag).alias("yes"), F.count_if(~flag).alias("no"))
    ).scalar()
    flagged = _joined(weights, df.select(id_col, "verified_purchase").where(flag.isNotNull()), id_col)
    sums = flagged.groupBy("term").agg(
        F.sum(F.when(flag, F.col("weight")).otherwise(0.0)).alias("yes"),
        F.sum(F.when(~flag, F.col("weight")).otherwise(0.0)).alias("no"),
    )
    lean = sums.select("term", (F.col("no") / sizes["no"] - F.col("yes") / sizes["yes"]).alias("lean"))
    low = lean.orderBy(F.asc("lean"), F.asc("term")).limit(n).withColumn("side", F.lit("verified"))
    high = lean.orderBy(F.desc("lean"), F.asc("term")).limit(n).withColumn("side", F.lit("unverified"))
    return low.unionAll(high)


def cluster_top_terms(
    weights: DataFrame, clusters: DataFrame, id_col: str = "review_id", n: int = 8
) -> DataFrame:
    """Terms with the highest mean weight in each cluster; nothing is made dense."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    sums = (
        _joined(weights, clusters.select(id_col, "cluster"), id_col)
        .groupBy("cluster", "term")
        .agg(F.sum("weight").alias("total"))
    )
    means = sums.join(sizes, "cluster").withColumn("mean_weight", F.col("total") / F.col("size"))
    order = W.partitionBy("cluster").orderBy(F.desc("mean_weight"), F.asc("term"))
    return (
        means.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
        .select("cluster", "place", "term", "mean_weight")
    )
