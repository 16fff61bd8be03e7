"""Chat formatting by perspective rotation: each participant in turn is the assistant, the others named users.

One row a conversation and participant, with the rendered dialogue and the character ranges to train on
(the turns of that participant, with their end marks).

Defined results
- Turns are in order of turn (nulls last), then role, then text; repeated turns are repeated.
- A null or blank role is the participant `unknown`; a role `system` stays system and is nobody's perspective, so
  a conversation of system turns alone gives no row. A null text is an empty turn.
- Rows without conv_id are one conversation.
- `<|` in texts and roles becomes `< |`, so that no text can forge a mark; line breaks in roles become spaces.
- Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import fields


def rotate_perspectives(conversations: DataFrame) -> DataFrame:
    """conv_id, perspective, n_turns, rendered, mask: `start:end` of the trained ranges, joined by commas."""
    conversations = fields(conversations, "conv_id", "turn", "role", "text")
    role = F.trim(F.regexp_replace(F.replace(F.coalesce("role", F.lit("")), F.lit("<|"), F.lit("< |")), r"[\r\n]", " "))
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").isNull().alias("last"), F.col("turn"), F.when(role == "", "unknown").otherwise(role).alias("role"),
            F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
        ).alias("m"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("turns"))
    each = whole.select(
        "conv_id", "turns",
        F.explode(F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda m: m["role"]), lambda r: r != "system")))).alias("perspective"),
    )
    own = lambda m: m["role"] == F.col("perspective")
    pieces = F.transform("turns", lambda m: F.struct(
        F.concat(F.lit("<|im_start|>"), F.when(own(m), "assistant").when(m["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), m["role"])), F.lit("\n")).alias("head"),
        F.concat(m["text"], F.lit("<|im_end|>")).alias("body"), own(m).alias("own"),
    ))
    spans = F.aggregate(
        "pieces", F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["head"]) + F.length(p["body"]) + 1).alias("at"),
            F.when(p["own"], F.concat(a["spans"], F.array(F.concat_ws(":", a["at"] + F.length(p["head"]), a["at"] + F.length(p["head"]) + F.length(p["body"]))))).otherwise(a["spans"]).alias("spans"),
        ),
    )["spans"]
    return each.withColumn("pieces", pieces).select(
        "conv_id", "perspective", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(spans, ",").alias("mask"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, CASE WHEN r = '' THEN 'unknown' ELSE r END AS role, text
  FROM (SELECT conv_id, turn, trim(regexp_replace(replace(coalesce(role, ''), '<|', '< |'), '[\r\n]', ' ', 'g')) AS r,
               replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations)
), p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
m AS (
  SELECT p.conv_id, p.perspective, t.turn, t.role, t.text, t.role = p.perspective AS own,
         '<|im_start|>' || CASE WHEN t.role = p.perspective THEN 'assistant' WHEN t.role = 'system' THEN 'system'
                                ELSE 'user name=' || t.role END || chr(10) AS head,
         t.text || '<|im_end|>' AS body
  FROM p JOIN t ON p.conv_id IS NOT DISTINCT FROM t.conv_id
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS LAST, role, text) AS i FROM m
), o AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY i)
            - length(body) - 1 AS pos FROM n
)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY i) AS rendered,
       coalesce(string_agg(CAST(pos AS BIGINT) || ':' || CAST(pos + length(body) AS BIGINT), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
