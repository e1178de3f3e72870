"""Preference pairs rendered for training: one shared prompt, two masked completions.

A pair has a chosen and a rejected conversation. The longest run of leading turns
in which both agree, role and text, is rendered once as the prompt. What follows
in each is its completion, with a mask: per turn, the characters of its header,
which are not learnt, then those of its body, learnt where the assistant speaks.

Pairs come from conversations that open with the same turn: the one with the most
assistant text, then the smallest id, is chosen over each of the others. A
conversation that opens alone is chosen over a copy of itself whose last assistant
turn only repeats the turn before; without an assistant turn it makes no pair.

Everything is a built-in function of DataFrames. A conversation is one row; the
chosen one of an opening is joined to the others as a stored table, so that a very
common opening is split by Spark's skew join.

Cases: turns of a null id belong to no conversation and are left out. A null turn
number comes first; equal numbers are ordered by role and text. Null roles and
texts are empty. Repeated rows are turns of their own. Conversations that agree
throughout have empty completions. Texts are rendered as they are; masks count
characters, so markers inside a text cannot move them. No turns give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import written_table

ASSISTANT = "assistant"
_FIRST = -(1 << 63)
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    one = F.struct(
        F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("all"))
    return whole.select(
        "conv_id", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")
    )


def _last_reply(turns: Column) -> Column:
    """Place of the last assistant turn, from 1; 0 if there is none."""
    back = F.array_position(F.reverse(F.transform(turns, lambda t: t["role"] == ASSISTANT)), True)
    return F.when(back > 0, F.size(turns) - back + 1).otherwise(0).cast("int")


def echoed(turns: Column) -> Column:
    """The conversation with its last assistant turn repeating the turn before it."""
    last = _last_reply(turns)
    before = F.coalesce(F.get(turns, last - 2)["text"], F.lit(""))
    return F.transform(
        turns,
        lambda t, i: F.struct(
            t["role"].alias("role"), F.when(i + 1 == last, before).otherwise(t["text"]).alias("text")
        ),
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, kind, chosen, rejected)"""
    replies = F.aggregate(
        "turns", F.lit(0).cast("long"), lambda n, t: n + F.when(t["role"] == ASSISTANT, F.length(t["text"])).otherwise(0)
    )
    opening = F.sha2(F.concat_ws("\n", F.length(F.col("turns")[0]["role"]), F.col("turns")[0]["role"], F.col("turns")[0]["text"]), 256)
    whole = written_table(
        conversations(turns).withColumns({"opening": opening, "replies": replies}), "conversations"
    )
    groups = (
        whole.groupBy("opening")
        .agg(F.count("*").alias("n"), F.max_by("conv_id", F.struct("replies", -F.col("conv_id"))).alias("chosen_id"))
        .where("n > 1")
    )
    best = written_table(
        groups.select("opening", "chosen_id").join(
            whole.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen")), "chosen_id"
        ),
        "chosen",
    )
    joined = whole.join(best, "opening", "left")
    alone = F.col("chosen_id").isNull()
    return joined.where(
        F.when(alone, _last_reply(F.col("turns")) > 0).otherwise(F.col("chosen_id") != F.col("conv_id"))
    ).select(
        F.coalesce("chosen_id", "conv_id").alias("chosen_id"),
        F.col("conv_id").alias("rejected_id"),
        F.when(alone, "echo").otherwise("sibling").alias("kind"),
        F.coalesce("chosen", "turns").alias("chosen"),
        F.when(alone, echoed(F.col("turns"))).otherwise(F.col("turns")).alias("rejected"),
    )


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Per turn the characters of header and body, and whether the body is learnt."""
    return F.transform(
        turns,
        lambda t: F.struct(
            F.length(_header(t)).alias("header"), F.length(_body(t)).alias("body"), (t["role"] == ASSISTANT).alias("learnt")
        ),
    )


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with n_shared, prompt, and text and mask of both completions in place of the turns."""
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.zip_with(F.slice("chosen", 1, shorter), F.slice("rejected", 1, shorter), lambda a, b: a == b)
    differs = F.array_position(same, False).cast("int")
    shared = pairs.withColumn("n_shared", F.when(differs > 0, differs - 1).otherwise(shorter))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n_shared") + 1, F.size(name))

    others = [c for c in pairs.columns if c not in ("chosen", "rejected", "n_shared", "prompt", "chosen_mask", "rejected_mask")]
    return shared.select(
        *others,
        "n_shared",
        rendered(F.slice("chosen", 1, F.col("n_shared"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"),
        mask(rest("chosen")).alias("chosen_mask"),
        rendered(rest("rejected")).alias("rejected"),
        mask(rest("rejected")).alias("rejected_mask"),
    )


def mask_text(column: str) -> Column:
    """A mask as text: characters left out after -, learnt after +."""
    return F.array_join(
        F.transform(
            column,
            lambda m: F.concat(F.lit("-"), m["header"], F.when(m["learnt"], "+").otherwise("-"), m["body"]),
        ),
        "",
    )


def _part_sql(side: str) -> str:
    turn = f"'<|' || {side}.role || '|>' || chr(10) || {side}.text || '<|end|>' || chr(10)"
    sizes = (
        f"'-' || (length({side}.role) + 5) || CASE WHEN {side}.role = '{ASSISTANT}' THEN '+' ELSE '-' END "
        f"|| (length({side}.text) + 8)"
    )
    return (
        f"{side}_parts AS (SELECT p.chosen_id, p.rejected_id, "
        f"coalesce(string_agg({turn}, '' ORDER BY i) FILTER (i <= n_shared), '') AS {side}_prompt, "
        f"coalesce(string_agg({turn}, '' ORDER BY i) FILTER (i > n_shared), '') AS {side}, "
        f"coalesce(string_agg({sizes}, '' ORDER BY i) FILTER (i > n_shared), '') AS {side}_mask "
        f"FROM shared p JOIN {side}_turns {side} ON {side}.chosen_id = p.chosen_id AND {side}.rejected_id = p.rejected_id "
        f"GROUP BY ALL)"
    )


SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, coalesce(sum(length(text)) FILTER (role = '{ASSISTANT}'), 0) AS replies,
    max(i) FILTER (role = '{ASSISTANT}') AS last FROM t GROUP BY conv_id),
opened AS (SELECT c.*, t.role, t.text FROM c JOIN t ON c.conv_id = t.conv_id AND i = 1),
ranked AS (
  SELECT *, first_value(conv_id) OVER (PARTITION BY role, text ORDER BY replies DESC, conv_id) AS best,
    count(*) OVER (PARTITION BY role, text) AS n FROM opened),
pairs AS (
  SELECT best AS chosen_id, conv_id AS rejected_id, CASE WHEN n = 1 THEN 'echo' ELSE 'sibling' END AS kind, last
  FROM ranked WHERE CASE WHEN n = 1 THEN last IS NOT NULL ELSE best != conv_id END),
chosen_turns AS (SELECT p.chosen_id, rejected_id, i, role, text FROM pairs p JOIN t ON p.chosen_id = t.conv_id),
rejected_turns AS (
  SELECT chosen_id, rejected_id, t.i, t.role,
    CASE WHEN kind = 'echo' AND t.i = last THEN coalesce(b.text, '') ELSE t.text END AS text
  FROM pairs p JOIN t ON p.rejected_id = t.conv_id LEFT JOIN t b ON b.conv_id = t.conv_id AND b.i = t.i - 1),
compared AS (
  SELECT coalesce(a.chosen_id, b.chosen_id) AS chosen_id, coalesce(a.rejected_id, b.rejected_id) AS rejected_id,
    coalesce(a.i, b.i) AS i, a.role = b.role AND a.text = b.text AS same
  FROM chosen_turns a FULL JOIN rejected_turns b ON a.chosen_id = b.chosen_id AND a.rejected_id = b.rejected_id AND a.i = b.i),
shared AS (
  SELECT chosen_id, rejected_id, CAST(coalesce(min(i) FILTER (same IS NOT TRUE) - 1, max(i)) AS INTEGER) AS n_shared
  FROM compared GROUP BY chosen_id, rejected_id),
{_part_sql("chosen")}, {_part_sql("rejected")}
SELECT p.chosen_id, p.rejected_id, kind, n_shared, chosen_prompt AS prompt, chosen, chosen_mask, rejected, rejected_mask
FROM pairs p JOIN shared s ON p.chosen_id = s.chosen_id AND p.rejected_id = s.rejected_id
JOIN chosen_parts c ON p.chosen_id = c.chosen_id AND p.rejected_id = c.rejected_id
JOIN rejected_parts r ON p.chosen_id = r.chosen_id AND p.rejected_id = r.rejected_id
"""
