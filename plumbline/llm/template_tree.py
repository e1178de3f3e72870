"""Line de-duplication by a tree of line templates.

A line's path in the tree is its number of tokens, then its leading tokens.
Tokens with a digit are variable and read as one mark, in the path too. Below the
path, lines are one template if they are equal up to one variable field: the
tokens after the leading ones are cut into ``FIELDS`` fields, and all but one
field must agree. Short lines must agree throughout.

A template that occurs in more than one document is recurring. Its lines stay in
the document with the smallest id and are dropped from all others. Lines of under
``MIN_TOKENS`` tokens, blank ones among them, are left alone.

With ``spare``, near copies are left whole: documents of which so large a share of
words, by Jaccard similarity, lies in lines that recur in one same earlier
document. Lines that only such a copy held before go to the next document, so that
a stage which removes copies loses no text. Without it copies are cut down like all.

Everything is a built-in function of DataFrames. A template is a 64-bit hash,
its documents are told by their smallest and largest id, so a very common line
costs a row per task before the shuffle.

Cases: a null text stays null and has no lines; an empty one has one, blank. A
null id comes before all others. Rows with the same id are one document. Lines
are parted by line feeds alone. Further columns are kept; ``n_lines`` and
``dropped_lines`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import join_per_key
from plumbline.session import written_table

DEPTH = 2
FIELDS = 5
MIN_TOKENS = 4
MIN_FIELD_TOKENS = 15
HOT_ROWS = 2_000
# Words as in the other operators: runs of anything but ASCII white space.
TOKEN = r"[^ \t-\r]+"
VARIABLE = r"[^ \t-\r]*[0-9][^ \t-\r]*"
MARK = "<*>"
_FIRST = -(1 << 63)


def tokens_of(content: Column) -> Column:
    """Tokens of a line, those with a digit as one mark; lines of plain words are only cut at spaces."""
    masked = F.when(content.rlike("[0-9]"), F.regexp_replace(content, VARIABLE, MARK)).otherwise(content)
    odd = content.startswith(" ") | content.endswith(" ") | (content == "")
    for space in ("  ", "\t", "\x0b", "\x0c", "\r"):
        odd |= content.contains(space)
    return F.when(odd, F.regexp_extract_all(masked, F.lit(TOKEN), F.lit(0))).otherwise(F.split(masked, " "))


def _field(j: int) -> Column:
    """Hash of the j-th field of ``tokens``."""
    start, end = F.expr(f"(n - {DEPTH}) * {j} div {FIELDS}"), F.expr(f"(n - {DEPTH}) * {j + 1} div {FIELDS}")
    long = F.col("n") >= MIN_FIELD_TOKENS
    return F.when(long, F.xxhash64(F.slice("tokens", (start + DEPTH + 1).cast("int"), (end - start).cast("int"))))


def template_keys() -> Column:
    """Hashes of the templates that a line belongs to, from those of its parts; none for short lines."""
    fields = [f"field{j}" for j in range(FIELDS)]
    looser = [F.xxhash64(F.lit(j), "n", "lead", *fields[:j], *fields[j + 1 :]) for j in range(FIELDS)]
    return (
        F.when(F.col("n") >= MIN_FIELD_TOKENS, F.array("whole", *looser))
        .when(F.col("n") >= MIN_TOKENS, F.array("whole"))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _document() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))


def line_templates(docs: DataFrame, sized: bool = False) -> DataFrame:
    """(row, document, line, template): one row per template of every line; ``sized``: and its tokens ``n``."""
    lines = docs.select(
        _row().alias("row"),
        _document().alias("document"),
        F.posexplode(F.split("text", "\n")).alias("line", "content"),
    )
    place = ["row", "document", "line"]
    tokens = lines.select(*place, tokens_of(F.col("content")).alias("tokens")).withColumn("n", F.size("tokens"))
    parts = tokens.select(
        *place,
        "n",
        F.xxhash64(F.lit(-1), "tokens").alias("whole"),
        F.xxhash64(F.slice("tokens", 1, DEPTH)).alias("lead"),
        *[_field(j).alias(f"field{j}") for j in range(FIELDS)],
    )
    return parts.select(*place, *(["n"] if sized else []), F.explode(template_keys()).alias("template"))


def recurring(templates: DataFrame) -> DataFrame:
    """(template, first): templates of more than one document and the document that keeps them."""
    ids = templates.groupBy("template").agg(F.min("document").alias("first"), F.max("document").alias("last"))
    return ids.where("first != last").select("template", "first")


def copies(hits: DataFrame, docs: DataFrame, spare: float) -> DataFrame:
    """(row, document): rows that resemble one earlier document line by line."""
    sizes = docs.select(_row().alias("row"), _document().alias("document"), F.size(tokens_of(F.col("text"))).alias("words"))
    sizes = sizes.groupBy("row", "document").agg(F.max("words").alias("words"))
    shared = hits.groupBy("row", "document", "first", "line").agg(F.max("n").alias("n"))
    shared = shared.groupBy("row", "document", "first").agg(F.sum("n").alias("shared"))
    own = shared.join(sizes.select("row", "words"), "row")
    enough = own.where(F.col("shared") >= spare * F.col("words"))
    firsts = sizes.groupBy(F.col("document").alias("first")).agg(F.max("words").alias("first_words"))
    met = join_per_key(enough, firsts, ["first"], "row", "inner", enough.groupBy("first").count(), HOT_ROWS)
    alike = F.col("shared") >= spare * (F.col("words") + F.col("first_words") - F.col("shared"))
    return met.where(alike).select("row", "document").distinct()


def _without_copies(hits: DataFrame, docs: DataFrame, spare: float) -> DataFrame:
    """``hits`` but for those of near copies, and of lines that no document but near copies held before."""
    found = written_table(copies(hits, docs, spare), "line-copies")
    hits = hits.join(found.select("row"), "row", "left_anti")
    keepers = found.select(F.col("document").alias("first")).distinct().withColumn("copy", F.lit(True))
    marked = join_per_key(hits, keepers, ["first"], "row", "left", hits.groupBy("first").count(), HOT_ROWS)
    marked = written_table(marked, "line-hits")
    moved = marked.where("copy")
    heirs = moved.groupBy("template").agg(F.min("document").alias("heir"))
    left = join_per_key(moved, heirs, ["template"], "row", "inner", moved.groupBy("template").count(), HOT_ROWS)
    names = ["row", "document", "line"]
    return marked.where("copy IS NULL").select(*names).union(left.where("document != heir").select(*names))


def drop_recurring_lines(docs: DataFrame, spare: float | None = None) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``, and with ``n_lines`` and ``dropped_lines``."""
    templates = written_table(line_templates(docs, spare is not None), "templates")
    hits = templates.join(recurring(templates), "template").where("document != first")
    if spare is not None:
        hits = _without_copies(written_table(hits, "line-hits"), docs, spare)
    dropped = hits.groupBy("row").agg(F.collect_set("line").alias("__gone")).withColumnRenamed("row", "__row")
    lines = F.split("text", "\n")
    own = docs.drop("n_lines", "dropped_lines")
    joined = own.withColumn("__row", _row()).join(dropped, "__row", "left").withColumn("__lines", lines)
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.array_join(F.transform(kept, lambda i: F.get("__lines", i)), "\n")
    return joined.select(
        *[F.when(F.col("__gone").isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else c for c in own.columns],
        F.greatest(F.size("__lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("dropped_lines"),
    )


_TOKENS = "regexp_extract_all(regexp_replace(content, '[^\\x20\\x09-\\x0D]*[0-9][^\\x20\\x09-\\x0D]*', '<*>', 'g'), '[^\\x20\\x09-\\x0D]+')"


def _loose_sql(j: int) -> str:
    start, end = f"(n - {DEPTH}) * {j} // {FIELDS} + {DEPTH}", f"(n - {DEPTH}) * {j + 1} // {FIELDS} + {DEPTH}"
    return (
        f"SELECT doc_id, pos, '{j} ' || n || ' ' || array_to_string(tokens[1:{start}], ' ') || ' / ' || "
        f"array_to_string(tokens[{end} + 1:], ' ') AS template FROM tokens WHERE n >= {MIN_FIELD_TOKENS}"
    )


SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS content,
    unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
tokens AS (SELECT doc_id, pos, tokens, len(tokens) AS n FROM (SELECT doc_id, pos, {_TOKENS} AS tokens FROM lines)),
templates AS (
  SELECT doc_id, pos, 'whole ' || array_to_string(tokens, ' ') AS template FROM tokens WHERE n >= {MIN_TOKENS}
  UNION ALL {" UNION ALL ".join(_loose_sql(j) for j in range(FIELDS))}),
keepers AS (SELECT template, min(doc_id) AS first FROM templates GROUP BY template HAVING min(doc_id) != max(doc_id)),
gone AS (SELECT DISTINCT t.doc_id, t.pos FROM templates t JOIN keepers k ON t.template = k.template AND t.doc_id != k.first)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS dropped_lines,
  md5(coalesce(string_agg(content, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '')) AS text_md5
FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
