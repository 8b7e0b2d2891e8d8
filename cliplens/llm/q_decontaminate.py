"""op1: benchmark decontamination of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.decontaminate import decontaminate


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text")
    c = F.col("contamination")
    return decontaminate(docs, benchmark).select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"),
        F.size(c["item_ids"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["item_ids"], ","), 256).alias("items_sha256"),
        (c["n_hit"] > 0).alias("contaminated"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

SQL = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
levels AS (SELECT DISTINCT least(len(w), 10) AS n FROM iw WHERE len(w) > 0),
ip AS (SELECT item_id, w, least(len(w), 10) AS n,
              unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM iw WHERE len(w) > 0),
iwin AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS s FROM ip),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, levels WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM dp),
hit AS (SELECT d.doc_id, d.p, d.n, i.item_id FROM dwin d JOIN iwin i ON i.n = d.n AND i.s = d.s),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
              SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words,
       CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered c ON c.doc_id = dw.doc_id LEFT JOIN named n ON n.doc_id = dw.doc_id
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": SQL}
