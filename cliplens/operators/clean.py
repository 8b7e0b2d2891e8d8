"""Validation, cleaning and de-duplication of item records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplens.functions.numbers import crawl_number, load_number
from cliplens.functions.title import UNKNOWN, publish_time_of_epoch
from cliplens.schema import COUNTERS, REQUEST


def validate_items(items: DataFrame) -> DataFrame:
    """Repair counters and name the reason for every item the crawl would drop.

    Required fields are tested for being falsy: NULL, empty text and zero.
    """

    def missing(name):
        c = F.col(name)
        return c.isNull() | (c == "")

    views = F.col("view_count")
    reason = (
        F.when(missing("video_id"), "video_id")
        .when(missing("title"), "title")
        .when(missing("view_count") | views.isin("0", "0.0"), "view_count")
    )
    repaired = {c: crawl_number(F.col(c)) for c in COUNTERS if c != "comment_count"}
    return items.withColumn("reject_reason", reason).withColumns(repaired)


def first_per_key(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key under an explicit order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def clean_items(raw: DataFrame, order: list | None = None) -> DataFrame:
    """Raw text items to typed rows: coerce, fill, parse tags, keep first per id."""
    numbers = {c: load_number(F.col(c)) for c in [*COUNTERS, "author_id"]}
    tags = F.from_json("tags", "array<string>")
    typed = (
        raw.withColumns(numbers)
        .withColumn("publish_time",
                    publish_time_of_epoch(F.col("publish_time").try_cast("double")))
        .withColumn("tags", F.coalesce(tags, F.array().cast("array<string>")))
        .fillna({"description": "", "author": "Unknown", "category": "Uncategorized"})
    )
    return first_per_key(typed, ["video_id"], order) if order else typed


def validate_requests(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse JSON request bodies; rows without a title carry an ``error``."""
    parsed = bodies.withColumn("_r", F.from_json(body, REQUEST))
    error = F.when(F.col("_r.title").isNull(), F.lit("title: field required"))
    return parsed.select(
        *[c for c in bodies.columns if c != body],
        F.col("_r.title").alias("title"),
        F.coalesce("_r.category", F.lit(UNKNOWN)).alias("category"),
        F.col("_r.author_id").alias("author_id"),
        F.col("_r.publish_time").alias("publish_time"),
        error.alias("error"),
    )


def has_rows(df: DataFrame, at_least: int = 20) -> bool:
    """Guard for jobs that need a minimum of rows; reads no more than that."""
    return df.limit(at_least).count() >= at_least
