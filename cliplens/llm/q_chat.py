"""op3: all conversations from every participant's point of view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.chat import NOBODY, PART_TURNS, render_perspectives


def op3_chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    masks = F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"]))
    return render_perspectives(turns).select(
        "conv_id", "speaker", "part", "first_turn", "n_turns", "rendered",
        F.array_join(masks, ",").alias("masks"),
        F.aggregate("masks", F.lit(0), lambda n, m: n + m["end"] - m["start"]).cast("bigint").alias(
            "learned_chars"))


def _safe(c: str) -> str:
    return (rf"replace(replace({c}, '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>')")


SQL = rf"""
WITH r AS (SELECT conv_id, turn, trim(regexp_replace(coalesce(role, ''), '\s+', ' ', 'g')) AS role,
                  {_safe("coalesce(text, '')")} AS text FROM conversations),
t AS (SELECT conv_id, turn, role = 'system' AS system, text,
             CASE WHEN role NOT IN ('', 'system') THEN {_safe("role")} END AS name FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, name NULLS FIRST, system, text) - 1 AS pos FROM t),
s AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE name IS NOT NULL),
m AS (SELECT p.conv_id, s.speaker, pos, pos // {PART_TURNS} AS part, name IS NOT DISTINCT FROM speaker AS own,
             CASE WHEN name = speaker THEN '<|im_start|>assistant' || chr(10)
                  WHEN name IS NULL AND system THEN '<|im_start|>system' || chr(10)
                  ELSE '<|im_start|>user name=' || coalesce(name, '{NOBODY}') || chr(10) END AS head,
             text || '<|im_end|>' || chr(10) AS body
      FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (
        PARTITION BY conv_id, speaker, part ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, CAST(min(pos) AS BIGINT) AS first_turn,
       CAST(count(*) AS BIGINT) AS n_turns, string_agg(head || body, '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CAST(before + length(head) AS BIGINT) || '-' ||
                           CAST(before + length(head) + length(body) - 1 AS BIGINT), ','
                           ORDER BY pos) FILTER (own), '') AS masks,
       CAST(coalesce(sum(length(body) - 1) FILTER (own), 0) AS BIGINT) AS learned_chars
FROM o GROUP BY conv_id, speaker, part
"""

QUERIES = {"op3_chat": op3_chat}
ORACLES = {"op3_chat": SQL}
