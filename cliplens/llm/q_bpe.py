"""op8: BPE encoding and decoding of all documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cliplens.llm.bpe import encode_bpe


def encoded_documents(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_bpe(docs, path, digest=True).select(
        "doc_id", "encoded.n_tokens", "encoded.ids_sha256", "encoded.decoded_sha256")


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return encoded_documents(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
