"""op5: the language of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cliplens.llm.language import held_out, identify


def op5_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    return identify(docs).select(
        "doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
