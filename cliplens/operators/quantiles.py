"""Exact quantiles of groups of any size.

Equal values are counted first. The built-in exact percentile then keeps every
distinct value of a group in one task, which is fine while their measured
number is small. Beyond that, the distinct values of a group are split into
ranges by an approximate sketch, and the exact position is found by adding up
counts inside ranges, so a hot group is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplens.operators.joins import lookup_join
from cliplens.session import materialize

RANGE_VALUES = 50_000
MAX_DISTINCT = 100_000


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      ranges: int | None = None, max_distinct: int = MAX_DISTINCT) -> DataFrame:
    """One row per group with a column per entry of ``probs``, linearly interpolated.

    The number of ranges of a group follows the widest group.
    """
    counts = materialize(
        df.where(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias("_v"))
        .groupBy(*keys, "_v").agg(F.count("*").alias("_c")), "value-counts")
    widest = counts.groupBy(*keys).agg(F.count("*").alias("d")).agg(F.max("d")).first()[0] or 0
    if widest <= max_distinct:
        return counts.groupBy(*keys).agg(*[
            F.percentile("_v", p, F.col("_c")).alias(name) for name, p in probs.items()])
    return _ranked_quantiles(counts, keys, probs, ranges or max(2, -(-widest // RANGE_VALUES)))


def _ranked_quantiles(counts: DataFrame, keys: list[str], probs: dict[str, float],
                      ranges: int) -> DataFrame:
    cuts = [i / ranges for i in range(1, ranges)]
    sketch = counts.groupBy(*keys).agg(
        F.percentile_approx("_v", cuts, max(1000, 4 * ranges)).alias("_cuts"), F.sum("_c").alias("_n")
    )
    # A hot group is a heavy key of this join, so it is spread over tasks.
    ranged = lookup_join(counts, materialize(sketch, "sketches"), keys, "inner", salt_by=["_v"]).withColumn(
        "_range", F.size(F.filter("_cuts", lambda s: s < F.col("_v")))
    ).drop("_cuts")
    in_range = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = ranged.groupBy(*keys, "_range").agg(F.sum("_c").alias("_size")).select(
        *keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    placed = ranged.withColumn("_upto", F.sum("_c").over(in_range)).join(
        starts, [*keys, "_range"]
    ).select(
        *keys, "_v", "_n",
        (F.col("_start") + F.col("_upto") - F.col("_c")).alias("_lo"),
        (F.col("_start") + F.col("_upto")).alias("_hi"),
    )

    def at(rank):
        return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("_v")))

    aggs, outs = [], []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * p
        aggs += [at(F.floor(pos)).alias(f"_{name}_lo"), at(F.ceil(pos)).alias(f"_{name}_hi")]
        frac = pos - F.floor(pos)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((low + (high - low) * frac).alias(name))
    return placed.groupBy(*keys).agg(F.max("_n").alias("_n"), *aggs).select(*keys, *outs)
