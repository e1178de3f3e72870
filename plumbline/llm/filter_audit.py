"""How filters interact: what each removes in every order of application.

Documents are reduced to cells: a part, the set of filters they fail as a bit
mask, and counts. The states of the lattice are the sets of filters already
applied; an edge leads from a state to the state with one filter more and removes
the cells that fail this filter and none of the state. A forward pass counts the
orders that reach each state, a backward pass those that leave it for the end, so
an edge lies on forward * backward orders. Its removals times that number add up,
per filter, to what the filter removes over all orders (Shapley); the steps of
every single order are the same edges, looked up by state and filter.

The lattice has 2**k states for k filters whatever the data. Cells are at most
2**k per part, and all counting is a grouped sum.

Copies are told by a digest of the text. Rows of one digest, part, label and mask
are added up before they are shuffled to their digest, together with their
smallest id, so thousands of copies cost a few rows.

Cases: a null text is empty, a null part the empty string. A null id is larger
than all others and no smaller than another null; rows of one id are no copies of
each other by themselves, and each row counts as a document. Several labels of one
id count once: good if any says so, toxic if any does. Without documents there are
no rows. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NAMES = "ABCDE"
COPY = NAMES.index("E")
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 3
SPACE = r"[ \t-\r]+"
SYMBOL = r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")
# Null ids are spread over this many keys, since none of them has a label.
_SPREAD = 1024


def text_failures(text: Column) -> list[Column]:
    """Whether a text fails filters A to D."""
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    return [
        n < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITAL_PERCENT * F.length(text),
        text.rlike(SYMBOL),
    ]


def as_mask(failures: list[Column]) -> Column:
    """The failed filters as bits, the first the lowest."""
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures)), F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and failed filters, copies among them."""
    text = F.coalesce("text", F.lit(""))
    key = F.col("doc_id").cast("long")
    narrow = docs.select(
        key.alias("id"),
        F.when(key.isNull(), F.pmod(F.xxhash64("text"), F.lit(_SPREAD))).otherwise(0).cast("int").alias("salt"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.coalesce("lang", F.lit("")).alias("part"),
        as_mask(text_failures(text)).alias("mask"),
    )
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id"), F.lit(0).alias("salt")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("is_good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("is_toxic"),
    )
    kinds = ["part", "mask", "is_good", "is_toxic"]
    rows = narrow.join(flags, ["id", "salt"], "left").fillna(0, ["is_good", "is_toxic"])
    rows = rows.groupBy("id", "salt", "digest", *kinds).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("anonymous"), "id", "n"))
    groups = rows.groupBy("digest", *kinds).agg(F.sum("n").alias("n"), first.alias("first"))
    smallest = F.min(F.struct("first.anonymous", "first.id")).over(W.partitionBy("digest"))
    marked = groups.withColumn("smallest", smallest)
    # Rows of the smallest id are the originals; if no row has an id, all are.
    originals = (
        F.when(F.col("smallest.anonymous"), F.col("n"))
        .when(F.struct("first.anonymous", "first.id") == F.col("smallest"), F.col("first.n"))
        .otherwise(0)
    )
    split = F.array(
        F.struct(F.col("mask").alias("mask"), originals.alias("n")),
        F.struct(F.col("mask").bitwiseOR(1 << COPY).alias("mask"), (F.col("n") - originals).alias("n")),
    )
    counted = marked.select("part", "is_good", "is_toxic", F.explode(split).alias("cell")).where("cell.n > 0")
    n = F.col("cell.n")
    return counted.groupBy("part", F.col("cell.mask").alias("mask")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("is_good")).alias("good"), F.sum(n * F.col("is_toxic")).alias("toxic")
    )


def edges(k: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders): the lattice's edges and how many of the k! orders take each."""
    states = range(1 << k)
    forward, backward = [0] * (1 << k), [0] * (1 << k)
    forward[0] = backward[-1] = 1
    for state in states:
        for f in range(k):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(states):
        for f in range(k):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s in states for f in range(k) if not s >> f & 1]


def steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state, filter): the edge that each step of each order takes."""
    out = []
    for order in permutations(range(len(names))):
        state = 0
        for i, f in enumerate(order):
            out.append(("".join(names[x] for x in order), i + 1, state, f))
            state |= 1 << f
    assert len(out) == factorial(len(names)) * len(names)
    return out


def audit(counted: DataFrame, names: str = NAMES) -> DataFrame:
    """Counts of every step of every order, per part, from cells (part, mask, n, good, toxic)."""
    spark, k = counted.sparkSession, len(names)
    lattice = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(w).cast("long").alias("orders")) for s, f, w in edges(k)
    ])
    met = counted.select("*", F.explode(lattice).alias("edge")).select("part", "mask", *COUNTS, "edge.*")
    bit = F.expr("shiftleft(1, filter)")
    fails = F.col("mask").bitwiseAND(bit) != 0
    alive = F.col("mask").bitwiseAND(F.col("state")) == 0

    def total(where: Column, of: str = "n") -> Column:
        return F.sum(F.when(where, F.col(of)).otherwise(0))

    passed = met.groupBy("part", "state", "filter", "orders").agg(
        total(alive & ~fails).alias("kept"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(alive & fails, "good").alias("good_lost"),
        total(alive & fails, "toxic").alias("toxic_lost"),
    )
    over = F.sum(F.col("removed") * F.col("orders")).over(W.partitionBy("part", "filter"))
    passed = passed.withColumn("shapley", over)
    taken = spark.createDataFrame(steps(names), "filter_order string, step int, state int, filter int")
    # k! * k rows whatever the data.
    return passed.join(F.broadcast(taken), ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(cells(docs, labels))


_WORDS = "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH flags AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
words AS (
  SELECT doc_id, text, part, {_WORDS} AS words, first IS NOT NULL AND (doc_id IS NULL OR first < doc_id) AS fails_e
  FROM texts JOIN firsts USING (text)),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < {MIN_WORDS} THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '{SYMBOL}') THEN 'D' ELSE '' END || CASE WHEN fails_e THEN 'E' ELSE '' END AS fails
  FROM words w LEFT JOIN flags l ON w.doc_id = l.doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
met AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS failing, fails = own AS only_own,
    length(translate(fails, before, '')) = length(fails) AS alive
  FROM cells, steps),
counted AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (alive AND NOT failing), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (alive AND failing), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (NOT alive AND failing), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (alive AND failing), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (alive AND failing), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
