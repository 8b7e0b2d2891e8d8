"""op2: token counts of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.tokens import count_tokens

LIMIT = 1024


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
