"""op10: exact top-k over all embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.topk import integer_vectors, top_k

K, SCALE, EVERY = 20, 64, 20


def op10_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = integer_vectors(
        spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding", SCALE)
    return top_k(vectors.where(F.col("id") % EVERY == 0), vectors, K)


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""

QUERIES = {"op10_topk": op10_topk}
ORACLES = {"op10_topk": SQL}
