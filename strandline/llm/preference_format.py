"""Operator 8: preference pairs as one prompt and two masked completions, in DataFrame operations only.

The longest common turn prefix of the chosen and the rejected conversation (roles and texts equal, nulls
equal to nulls) is rendered once as the prompt; what follows in either is its completion.  A completion's mask
lists the code point ranges start:end (end exclusive) that are learnt from: the assistant's turns, each with
its end mark and without its header.

Defined results: turns are ordered by turn, then role, then text (so repeated turn numbers have one order, and
repeated rows stay); a null turn sorts first; a null role is rendered as `unknown`, a null text as empty; a side
without turns has an empty completion; a conversation or text of any length is rendered whole, as one row; rows with a null pair are ignored; an empty table gives an empty table;
columns not named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def conversations(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: array<struct<role, text>> in order, one row per conversation (null keys are ignored)."""
    rows = turns.select(F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").cast("string").alias("role"), F.col(f"`{text}`").cast("string").alias("text"))
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading elements that two arrays have in common."""
    n = F.least(F.size(a), F.size(b))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0), lambda done, i: F.when((done == i - 1) & F.element_at(a, i).eqNullSafe(F.element_at(b, i)), i).otherwise(done))


def header(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t), body(t))), "")


def learnt(turns: Column) -> Column:
    """start:end of each assistant turn's body within the rendered turns, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(header(t))
        end = begin + F.length(body(t))
        span = F.array(F.concat_ws(":", begin, end))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda state: F.array_join(state["spans"], ","))


def preference_format(pairs: DataFrame, key: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask; chosen and rejected come as array<struct<role, text>>."""
    empty = F.array().cast("array<struct<role:string,text:string>>")
    own = pairs.select(F.col(f"`{key}`").alias("pair_id"), F.coalesce(F.col(f"`{chosen}`"), empty).alias("c"), F.coalesce(F.col(f"`{rejected}`"), empty).alias("r")).where("pair_id is not null")
    own = own.withColumn("n", common_prefix(F.col("c"), F.col("r")))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("n") + 1, F.size(side))

    own = own.select("pair_id", "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), F.when(F.size("c") > F.col("n"), rest("c")).otherwise(empty).alias("c"), F.when(F.size("r") > F.col("n"), rest("r")).otherwise(empty).alias("r"))
    return own.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        rendered(F.col("p")).alias("prompt"),
        rendered(F.col("c")).alias("chosen"),
        learnt(F.col("c")).alias("chosen_mask"),
        rendered(F.col("r")).alias("rejected"),
        learnt(F.col("r")).alias("rejected_mask"),
    )


def swapped_replies(grouped: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: rejected has the last reply of the neighbour (ids 2k and 2k + 1) in place of its own.

    Each conversation with an integer id is the chosen side of one pair.  Its rejected side is its turns before its last
    assistant turn, then the neighbour's last assistant turn where there is one.
    """
    roles = F.transform("turns", lambda t: F.coalesce(t["role"] == "assistant", F.lit(False)))
    last = F.size("turns") - F.array_position(F.reverse(roles), True) + 1  # of the last assistant turn; size + 1 if none
    own = grouped.select("conv_id", "turns", last.cast("int").alias("last"))
    replies = own.where(F.col("last") <= F.size("turns")).select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.element_at("turns", F.col("last")).alias("reply"))
    joined = own.join(replies, "conv_id", "left")
    before = F.slice("turns", F.lit(1), F.col("last") - 1)
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), F.when(F.col("reply").isNull(), before).otherwise(F.concat(before, F.array("reply"))).alias("rejected"))


#: DuckDB SQL for preference_format(swapped_replies(conversations(conversations))).
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, role, text
  FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, coalesce(max(i) FILTER (WHERE role = 'assistant'), max(i) + 1) AS last, max(i) AS n FROM t GROUP BY conv_id),
s AS (
  SELECT conv_id AS pair_id, 'c' AS side, i, role, text FROM t
  UNION ALL SELECT t.conv_id, 'r', i, role, text FROM t JOIN l USING (conv_id) WHERE i < last
  UNION ALL SELECT l.conv_id, 'r', l.last, t.role, t.text FROM l JOIN l AS o ON o.conv_id = xor(l.conv_id, 1) AND o.last <= o.n JOIN t ON t.conv_id = o.conv_id AND t.i = o.last),
d AS (
  SELECT pair_id, i, count(*) FILTER (WHERE side = 'c') = 1 AND count(*) FILTER (WHERE side = 'r') = 1
    AND min(role) IS NOT DISTINCT FROM max(role) AND min(text) IS NOT DISTINCT FROM max(text) AND count(role) IN (0, 2) AND count(text) IN (0, 2) AS same
  FROM s GROUP BY pair_id, i),
p AS (SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same), max(i) + 1) - 1 AS n FROM d GROUP BY pair_id),
h AS (
  SELECT s.pair_id, CASE WHEN s.i <= p.n THEN 'p' ELSE side END AS part, s.i, s.role, p.n,
    '<|' || coalesce(s.role, 'unknown') || '|>' || chr(10) AS head, coalesce(s.text, '') || '<|end|>' || chr(10) AS body
  FROM s JOIN p USING (pair_id) WHERE NOT (side = 'r' AND s.i <= p.n)),
o AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY pair_id, part ORDER BY i) AS upto FROM h),
g AS (
  SELECT pair_id, part, string_agg(head || body, '' ORDER BY i) AS txt,
    string_agg(CAST(upto - length(body) AS BIGINT)::VARCHAR || ':' || CAST(upto AS BIGINT)::VARCHAR, ',' ORDER BY i) FILTER (WHERE role = 'assistant') AS mask
  FROM o GROUP BY pair_id, part)
SELECT p.pair_id, CAST(p.n AS BIGINT) AS n_prompt_turns, coalesce(a.txt, '') AS prompt, coalesce(b.txt, '') AS chosen, coalesce(b.mask, '') AS chosen_mask,
  coalesce(c.txt, '') AS rejected, coalesce(c.mask, '') AS rejected_mask
FROM p LEFT JOIN g a ON a.pair_id = p.pair_id AND a.part = 'p' LEFT JOIN g b ON b.pair_id = p.pair_id AND b.part = 'c' LEFT JOIN g c ON c.pair_id = p.pair_id AND c.part = 'r'
"""
