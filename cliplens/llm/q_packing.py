"""op13: all documents packed into sequences of 4096 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cliplens.llm.packing import pack_documents


def op13_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_packing": op13_packing}
ORACLES: dict[str, str] = {}
