"""A uniform shuffle into shards of exact sizes by a communication matrix.

Every input partition permutes its rows by itself. How many of them go to each
shard is drawn beforehand: the counts are multivariate hypergeometric, as a
permutation of all rows would give them, so each shard gets exactly its size.
The rows are exchanged accordingly and permuted again inside their shard, in
ranges of a random key that are ranked one by one.

Only counts reach the driver: one row of the matrix for each partition, drawn
and written a bounded number of rows at a time.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplens.session import materialize, scratch_path

RANGE_ROWS = 100_000
MATRIX_ROWS = 4096
_NUMPY_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` taken from good + bad are good; exact at any size."""
    if good + bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    low, high = max(0, draws - bad), min(draws, good)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode)
                 - log_choose(good + bad, draws))
    # Take from the mode outwards until the uniform number is used up.
    left = rng.random()
    if left < p:
        return mode
    left -= p
    up = down = mode
    p_up = p_down = p
    while up < high or down > low:
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            if left < p_up:
                return up
            left -= p_up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            if left < p_down:
                return down
            left -= p_down
        if p_up < 1e-18 and p_down < 1e-18:
            break
    return mode


def draw_row(rng: np.random.Generator, left: list[int], draws: int) -> list[int]:
    """One partition's counts: ``draws`` of the places ``left`` in the shards."""
    total, counts = sum(left), []
    for places in left:
        n = hypergeometric(rng, places, total - places, draws) if draws else 0
        counts.append(n)
        total -= places
        draws -= n
    return counts


def _write_matrix(spark: SparkSession, sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, ends): for each partition the last local rank + 1 of each shard."""
    total = sizes.agg(F.sum("n").alias("n")).first()["n"] or 0
    left = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.default_rng(seed)
    path, schema = scratch_path(spark, "matrix"), "part int, ends array<bigint>"
    rows: list[tuple[int, list[int]]] = []

    def write():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    for r in sizes.orderBy("part").toLocalIterator():
        counts = draw_row(rng, left, r["n"])
        left = [a - b for a, b in zip(left, counts)]
        rows.append((r["part"], np.cumsum(counts).tolist()))
        if len(rows) == MATRIX_ROWS:
            write()
    if rows or not total:
        write()
    return spark.read.schema(schema).parquet(path)


def shuffle_into_shards(rows: DataFrame, shards: int, seed: int = 42, shard_col: str = "shard",
                        slot_col: str = "slot", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with a shard and a slot: a uniform permutation cut into equal shards.

    Shard sizes differ by one at most, the first ones being the larger; slots
    count from 0 without gaps in each shard. Every order of the rows is as
    likely as any other, up to the quality of the random keys. A run is
    repeatable for the same seed and the same input partitions.

    No column is looked at, so NULLs, ties and repeated rows are moved like any
    other row. Fewer rows than shards leave the last shards empty; an empty
    table stays empty. Existing columns named like the two new ones are replaced.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c.lower() not in (shard_col.lower(), slot_col.lower())]
    # Permute locally: the row's place after a sort inside the partition is its rank.
    local = materialize(
        rows.select(*columns).withColumn("__first", F.rand(seed)).withColumn("__again", F.rand(seed + 1))
        .sortWithinPartitions("__first").withColumn("__place", F.monotonically_increasing_id())
        .select(*columns, "__again",
                F.shiftright("__place", 33).cast("int").alias("__part"),
                F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)).alias("__rank")), "permuted")
    sizes = local.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n"))
    matrix = _write_matrix(spark, sizes, shards, seed).select(
        F.col("part").alias("__part"), F.col("ends").alias("__ends"))
    total = local.count()
    ranges = max(1, -(-total // (shards * range_rows)))
    # The number of shards that end at or before the rank is the shard's number.
    sent = local.join(matrix, "__part").select(
        *columns, "__again", F.size(F.filter("__ends", lambda end: end <= F.col("__rank"))).alias(shard_col))
    sent = materialize(
        sent.withColumn("__range", F.floor(F.col("__again") * ranges).cast("int")), "exchanged")
    # Permute again: ranges of the second key follow one another inside a shard.
    before = Window.partitionBy(shard_col).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy(shard_col, "__range").agg(F.count("*").alias("__n")).select(
        shard_col, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard_col, "__range").orderBy("__again")
    return sent.withColumn("__row", F.row_number().over(inside)).join(
        starts, [shard_col, "__range"]).select(
        *columns, shard_col, (F.col("__start") + F.col("__row") - 1).cast("bigint").alias(slot_col))
