"""How sources differ within a language: term shares against other sources and against the whole language.

Texts become terms in Arrow: ASCII letters to small ones, a split at everything
but letters, terms as dictionary codes, and grouped counts of (language, source,
term) with the documents they occur in. A task adds up its batches and hands on
partial counts. These are merged by (language, term); terms in enough documents
of their language are kept, each as one row with its counts by source.

Kept terms are dealt into columnar shards of bounded size, each of one language,
with the totals of all its sources. A shard has a row of whole-number shares per
source, a slice of terms at a time, and yields for each pair of sources the sum of
its divergences and for each source its first terms. Sums over shards and ranks
are ordinary aggregates.

Shares are p = 1 + floor(SCALE * (count + 2) / (N + 2 * V)), divergences
floor((p - q)**2 / (p + q)), all in whole numbers; the long division goes in three
steps of a thousand, so that counts up to 9 * 10**15 stay exact.

Cases: null texts, languages and sources are the empty string. Every row is a
document, also one with a repeated or null id. A source without terms has all
counts 0; a language without kept terms gives each pair the value 0 and no terms.
Ties go to the item that is smaller in UTF-8. A very long text is a slice of its
own. Without documents there are no rows. Only the named columns are read, so
others may have any names.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.llm.common import ship
from plumbline.operators.skew import join_per_key
from plumbline.session import written_table

SPLIT = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCUMENTS = 10
SCALE_STEPS = (1000, 1000, 1000)
TOP = 10
SLICE_BYTES = 4 << 20
HELD_ROWS = 400_000
SHARD_TERMS = 8_192
_CELLS = 1 << 20

GROUP = ["lang", "source"]
PARTIAL = "lang string, source string, term string, n long, docs long"
FOUND = "lang string, source string, part string, item string, value long"


def _slices(batch: pa.RecordBatch, limit: int):
    """Runs of rows of about ``limit`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero(np.diff(ends // limit)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def _grouped(rows: pa.Table, keys: list[str], sums: list[str]) -> pa.Table:
    out = rows.group_by(keys, use_threads=False).aggregate([(c, "sum") for c in sums])
    return out.rename_columns([c.removesuffix("_sum") for c in out.column_names]).select([*keys, *sums])


def slice_counts(rows: pa.RecordBatch) -> pa.Table:
    """(lang, source, term, n, docs) of some documents."""
    lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(rows.column("text"), "")), SPLIT)
    terms = pc.list_flatten(lists)
    own = pc.not_equal(terms, "")
    codes = pc.filter(terms, own).dictionary_encode()
    of = pc.filter(pc.list_parent_indices(lists), own)
    per_doc = pa.table({"doc": of, "code": codes.indices})
    per_doc = per_doc.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    names = {c: pc.fill_null(rows.column(c), "").dictionary_encode() for c in GROUP}
    found = {c: pc.take(names[c].indices, per_doc.column("doc")) for c in GROUP}
    found |= {"term": per_doc.column("code"), "n": per_doc.column("count_all"), "docs": pa.array(np.ones(per_doc.num_rows, np.int64))}
    counts = _grouped(pa.table(found), [*GROUP, "term"], ["n", "docs"])
    spelled = {c: pc.take(names[c].dictionary, counts.column(c)) for c in GROUP}
    spelled |= {"term": pc.take(codes.dictionary, counts.column("term")), "n": counts.column("n"), "docs": counts.column("docs")}
    return pa.table(spelled)


def partial_counts(docs: DataFrame, slice_bytes: int = SLICE_BYTES, held_rows: int = HELD_ROWS) -> DataFrame:
    """Counts by language, source and term, added up within each task as far as ``held_rows`` allow."""
    ship(docs.sparkSession)

    def run(batches):
        held, n = [], 0
        for part in (s for batch in batches for s in _slices(batch, slice_bytes)):
            held.append(slice_counts(part))
            n += held[-1].num_rows
            if n > held_rows:
                total = _grouped(pa.concat_tables(held), [*GROUP, "term"], ["n", "docs"])
                held, n = [total], total.num_rows
                if 2 * n > held_rows:
                    yield from total.combine_chunks().to_batches(max_chunksize=20_000)
                    held, n = [], 0
        if held:
            total = _grouped(pa.concat_tables(held), [*GROUP, "term"], ["n", "docs"])
            yield from total.combine_chunks().to_batches(max_chunksize=20_000)

    return docs.select("text", *GROUP).mapInArrow(run, PARTIAL)


def kept_terms(partial: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, total, by_source): terms in enough documents of their language."""
    dealt = partial.repartition("lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = sums.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("by_source")
    )
    return terms.where(F.col("docs") >= min_documents).drop("docs")


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10**9 * (counts + 2) / total), exact."""
    rest, out = counts + 2, np.zeros(np.broadcast_shapes(np.shape(counts), np.shape(total)), np.int64)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, total)
        out = out * step + more
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _first(rows: list[tuple[int, bytes]], top: int) -> list[tuple[int, bytes]]:
    return sorted(rows, key=lambda r: (-r[0], r[1]))[:top]


def shard_divergences(terms: pa.Table, groups: pa.Table, top: int = TOP) -> pa.Table:
    """Partial results of one shard: sums for pairs of sources (the first before the second), first terms of each source."""
    lang = groups.column("lang")[0].as_py()
    groups = groups.sort_by("source")
    names = groups.column("source").to_pylist()
    n, of_lang, kinds = (groups.column(c).to_numpy() for c in ("n", "n_lang", "kinds"))
    sums, firsts = np.zeros((len(names), len(names)), np.int64), [[] for _ in names]
    step = max(1, _CELLS // len(names))
    for at in range(0, terms.num_rows, step):
        part = terms.slice(at, step).combine_chunks()
        words = part.column("term").cast(pa.binary()).to_pylist()
        lists = part.column("by_source").combine_chunks()
        entries = lists.flatten()
        row = pc.index_in(entries.field("source"), value_set=pa.array(names, entries.field("source").type)).to_numpy()
        counts = np.zeros((len(names), len(words)), np.int64)
        counts[row, pc.list_parent_indices(lists).to_numpy()] = entries.field("n").to_numpy()
        p = shares(counts, (n + 2 * kinds)[:, None])
        q = shares(part.column("total").to_numpy(), int(of_lang[0] + 2 * kinds[0]))
        for a in range(len(names)):
            sums[a, a + 1 :] += divergence(p[a], p[a + 1 :]).sum(axis=1)
            above = np.flatnonzero((counts[a] > 0) & (p[a] > q))
            value = divergence(p[a, above], q[above])
            if len(value) > top:  # ties at the last place stay until the items are compared
                least = np.partition(value, len(value) - top)[len(value) - top]
                above, value = above[value >= least], value[value >= least]
            firsts[a] = _first([*firsts[a], *((v, words[i]) for v, i in zip(value.tolist(), above.tolist()))], top)
    rows = [(a, "pair", names[b], int(sums[i, b])) for i, a in enumerate(names) for b in range(i + 1, len(names))]
    rows += [(a, "term", w.decode(), v) for a, own in zip(names, firsts) for v, w in own]
    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.Table.from_arrays(
        [pa.array([lang] * len(rows), pa.string()), *[pa.array(list(c), t) for c, t in zip(columns, kinds)]],
        names=["lang", "source", "part", "item", "value"],
    )


def divergences(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by divergence, and the terms a source stands out by."""
    named = docs.select("text", *[F.coalesce(c, F.lit("")).alias(c) for c in GROUP])
    kept = written_table(kept_terms(partial_counts(named), min_documents), "terms")
    per_lang = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count(F.lit(1)).alias("kinds"))
    counted = kept.select("lang", F.explode("by_source").alias("own")).groupBy("lang", F.col("own.source").alias("source"))
    counted = counted.agg(F.sum("own.n").alias("n"))
    groups = named.select(*GROUP).distinct().join(counted, GROUP, "left").join(per_lang, "lang", "left").fillna(0)
    shards = F.greatest(F.lit(1), F.ceil(F.col("kinds") / shard_terms)).cast("int")
    groups = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), shards - 1)))
    terms = join_per_key(kept, per_lang.select("lang", "kinds"), ["lang"], "term", "inner", per_lang.select("lang", "kinds"), shard_terms)
    terms = terms.withColumn("shard", F.pmod(F.xxhash64("term"), shards).cast("int")).drop("kinds")
    found = terms.groupBy("lang", "shard").cogroup(groups.groupBy("lang", "shard")).applyInArrow(
        lambda left, right: shard_divergences(left, right, top), FOUND
    )
    found = written_table(found, "divergences")
    one_way = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    ways = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = one_way.select("lang", "value", F.explode(ways).alias("way")).select(
        "lang", "way.source", F.lit("pair").alias("part"), "way.item", "value"
    )
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = reduce(DataFrame.unionByName, [pairs, found.where("part = 'term'")]).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS text FROM documents),
terms AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM (
    SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs)
  GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n) AS total FROM terms GROUP BY lang, term HAVING sum(docs) >= {MIN_DOCUMENTS}),
kinds AS (SELECT lang, count(*)::HUGEINT AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(t.n, 0)::HUGEINT AS n FROM groups g JOIN kept k ON g.lang = k.lang
  LEFT JOIN terms t ON t.lang = g.lang AND t.source = g.source AND t.term = k.term),
shares AS (
  SELECT c.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY c.lang, source)::HUGEINT + 2 * v) AS p,
    1 + (1000000000::HUGEINT * (total::HUGEINT + 2)) // (n_lang::HUGEINT + 2 * v) AS q
  FROM counts c JOIN kinds k ON c.lang = k.lang),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
