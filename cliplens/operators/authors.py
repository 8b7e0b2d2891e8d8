"""Author statistics and their defaults for unknown authors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.functions.title import AUTHOR_FEATURES
from cliplens.operators.joins import lookup_join
from cliplens.operators.quantiles import grouped_quantiles


def author_stats(videos: DataFrame) -> DataFrame:
    """Mean, exact median and count of views per author with a numeric id.

    Materialize the result before it is used more than once.
    """
    rows = videos.select(
        F.col("author_id").try_cast("bigint").alias("author_id"), "view_count"
    ).where(F.col("author_id").isNotNull())
    means = rows.groupBy("author_id").agg(
        F.avg("view_count").alias("author_mean_view"),
        F.count("view_count").alias("author_video_count"),
    )
    medians = grouped_quantiles(rows, ["author_id"], "view_count", {"author_median_view": 0.5})
    return means.join(medians, "author_id", "left")


def author_defaults(stats: DataFrame) -> DataFrame:
    """One row: mean of means, median of medians, mean count; zeros if there are none."""
    median = grouped_quantiles(
        stats.withColumn("_all", F.lit(1)), ["_all"], "author_median_view", {"m": 0.5}
    )
    return stats.agg(
        F.coalesce(F.avg("author_mean_view"), F.lit(0.0)).alias("author_mean_view"),
        F.coalesce(median.agg(F.max("m")).scalar(), F.lit(0.0)).alias("author_median_view"),
        F.coalesce(F.avg("author_video_count"), F.lit(0.0)).alias("author_video_count"),
    )


def add_author_features(rows: DataFrame, stats: DataFrame, defaults: DataFrame) -> DataFrame:
    """Attach the statistics; unknown or non-numeric authors get the defaults."""
    keyed = rows.withColumn("_aid", F.col("author_id").try_cast("bigint"))
    known = stats.select(F.col("author_id").alias("_aid"), *AUTHOR_FEATURES)
    joined = lookup_join(keyed, known, ["_aid"], "left")
    fills = defaults.first()  # one row of three numbers
    return joined.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))) for c in AUTHOR_FEATURES
    }).drop("_aid")
