"""Descriptive statistics of numeric columns, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.operators.quantiles import grouped_quantiles

BINS = 20
KDE_POINTS = 64


def long_form(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, value) rows, one per cell."""
    doubles = df.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    return doubles.unpivot([], metrics, "metric", "value")


def describe(df: DataFrame, metrics: list[str]) -> DataFrame:
    """count, mean, std, min, exact quartiles and max of each column."""
    cells = long_form(df, metrics)
    moments = cells.groupBy("metric").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = grouped_quantiles(cells, ["metric"], "value",
                                  {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return moments.join(quartiles, "metric", "left")


def correlations(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Pearson coefficient of every ordered pair, from one pass."""
    pairs = [(a, b) for a in metrics for b in metrics]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    entries = F.array(*[
        F.struct(F.lit(a).alias("metric_a"), F.lit(b).alias("metric_b"),
                 F.col(f"`{a}|{b}`").alias("r"))
        for a, b in pairs
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def histogram(df: DataFrame, metrics: list[str], bins: int = BINS) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins included."""
    cells = long_form(df, metrics).where(F.col("value").isNotNull())
    bounds = cells.groupBy("metric").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per metric, so the bounds are safe to broadcast.
    width = F.col("hi") - F.col("lo")
    place = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), F.floor((F.col("value") - F.col("lo")) / width * bins) + 1)
    )
    filled = (
        cells.join(F.broadcast(bounds), "metric")
        .groupBy("metric", place.cast("bigint").alias("bin")).agg(F.count("*").alias("n"))
    )
    frame = bounds.withColumn(
        "bin", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint")))
    )
    return frame.join(filled, ["metric", "bin"], "left").select(
        "metric", "bin",
        (F.col("lo") + width * (F.col("bin") - 1) / bins).alias("bin_start"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


def kde(df: DataFrame, metrics: list[str], points: int = KDE_POINTS) -> DataFrame:
    """Gaussian density on a grid from min to max, bandwidth ``n^(-1/5) * std``.

    Equal values are merged first; each distinct value then adds to all grid
    points inside its own task, and only grid sums are shuffled.
    """
    cells = long_form(df, metrics).where(F.col("value").isNotNull())
    stats = cells.groupBy("metric").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        (F.pow(F.count("*").cast("double"), F.lit(-0.2)) * F.stddev_samp("value")).alias("h"),
    )
    merged = cells.groupBy("metric", "value").agg(F.count("*").alias("c"))
    spread = (
        merged.join(F.broadcast(stats), "metric")  # one row per metric
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1))
    )
    # A constant column has no bandwidth and so no density.
    z = F.try_divide(F.col("x") - F.col("value"), "h")
    return (
        spread.groupBy("metric", "point", "x", "n", "h")
        .agg(F.sum(F.col("c") * F.exp(-0.5 * z * z)).alias("s"))
        .select("metric", F.col("point").cast("bigint").alias("point"), "x",
                F.try_divide(F.col("s"), F.col("n") * F.col("h") * F.sqrt(F.lit(2.0) * F.pi()))
                .alias("density"))
    )


def table_profile(df: DataFrame) -> DataFrame:
    """Non-null count, null count and type of each column, from one pass."""
    names = df.columns
    row = df.agg(
        F.count("*").alias("_rows"), *[F.count(F.col(c)).alias(c) for c in names]
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("non_null"),
                 (F.col("_rows") - F.col(c)).alias("nulls"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"))
        for c in names
    ])
    return row.select(F.explode(entries).alias("e")).select("e.*")
