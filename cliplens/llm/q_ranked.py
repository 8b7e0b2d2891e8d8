"""op12: the 50 best documents for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliplens.llm.ranked import search


def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))


def _terms(table: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table}"""


ORACLES = {"op12_ranked_search": f"""
    WITH tf AS (SELECT doc_id, term, count(*) AS tf FROM ({_terms('documents', 'doc_id')}) GROUP BY 1, 2),
    size AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
    weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
               FROM tf, total GROUP BY term),
    item AS (SELECT DISTINCT item_id, term FROM ({_terms('benchmark', 'item_id')})),
    scores AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf)
        // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
      FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY 1, 2),
    ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST)
                 AS rank, doc_id, score FROM scores WHERE score > 0)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 50"""}
QUERIES = {"op12_ranked_search": op12_ranked_search}
