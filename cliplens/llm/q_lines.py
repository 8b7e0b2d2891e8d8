"""op6: line dedup of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.llm.lines import dedup_lines


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = F.col("line_dedup")
    return dedup_lines(docs).select(
        "doc_id", r["n_lines"].alias("n_lines"), r["n_removed"].alias("n_removed"),
        r["text"].alias("text"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLES: dict[str, str] = {}
