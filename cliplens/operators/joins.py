"""Many-to-one joins that pick broadcast by measured size and split off heavy keys otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplens.session import materialize

MAX_BROADCAST_BYTES = 64 << 20


def _width(field: T.StructField) -> Column:
    col = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and not isinstance(
            field.dataType.elementType, (T.StringType, T.ArrayType, T.MapType, T.StructType)):
        return F.greatest(F.size(col), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0)) * 2
    return F.lit(16)


def fits_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure rows and bytes of ``df`` with one distributed aggregate."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field)
    total = df.agg(F.sum(width.cast("bigint")).alias("b")).first()["b"] or 0
    return total <= max_bytes


HEAVY_SHARES = 2000


def lookup_join(big: DataFrame, dim: DataFrame, on: list[str], how: str = "left",
                proven_small: bool = False, max_bytes: int = MAX_BROADCAST_BYTES,
                salt_by: list[str] | None = None) -> DataFrame:
    """Join rows to a dimension that is unique on ``on``.

    A dimension of proven or measured size is broadcast, so no key of ``big``
    is shuffled. Otherwise the keys of ``big`` are counted, the rows of
    ``dim`` for its heavy keys are broadcast, and only the others are shuffled.
    """
    if proven_small or fits_broadcast(dim, max_bytes):
        return big.join(F.broadcast(dim), on, how)
    counts = materialize(
        big.select(*on).dropna().groupBy(*on).agg(F.count("*").alias("_n")), "key-counts")
    spread = salt_by or [c for c in big.columns if c not in on] or on
    values = [c for c in dim.columns if c not in on]
    joined = _split_join(big, dim, counts, on, values, spread, HEAVY_SHARES)
    matched = F.coalesce(F.col("_heavy"), F.col("_light")).isNotNull()
    columns = [*on, *[c for c in big.columns if c not in on]]  # as a join by names has them
    if how in ("left_semi", "left_anti"):
        return joined.where(matched if how == "left_semi" else ~matched).select(*columns)
    if how == "inner":
        joined = joined.where(matched)
    return joined.select(*columns, *[F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in values])


def _split_join(big: DataFrame, dim: DataFrame, counts: DataFrame, on: list[str],
                values: list[str], spread_by: list[str], shares: int) -> DataFrame:
    """``big`` with the values of heavy keys (_h_) by broadcast and of light ones (_l_) by shuffle.

    ``counts`` has the rows of ``big`` per key in ``_n``. A key is heavy if it
    holds at least one of ``shares`` parts of all rows, so there are ``shares``
    of them at most. Rows of heavy keys are spread by a hash of ``spread_by``.
    """
    total = counts.agg(F.sum("_n").alias("n")).first()["n"] or 0
    bound = max(2, -(-total // shares))
    keys = counts.where(F.col("_n") >= bound).select(*on)
    hot = dim.select(*on, *values).join(F.broadcast(keys), on, "left_semi").select(
        *on, F.lit(True).alias("_found"), *[F.col(c).alias(f"_h_{c}") for c in values])
    heavy = keys.join(hot, on, "left").select(
        *on, F.lit(True).alias("_known"), F.col("_found").alias("_heavy"),
        *[f"_h_{c}" for c in values])
    light = dim.select(*on, F.lit(0).cast("bigint").alias("_spread"), F.lit(True).alias("_light"),
                       *[F.col(c).alias(f"_l_{c}") for c in values])
    missing = F.lit(False)
    for c in on:
        missing = missing | F.col(c).isNull()
    split = big.join(F.broadcast(heavy), on, "left").withColumn(
        "_spread", F.when(F.col("_known") | missing,
                          F.pmod(F.xxhash64(*spread_by), F.lit(1 << 30)) + 1)
        .otherwise(F.lit(0).cast("bigint")))
    return split.join(light, [*on, "_spread"], "left")


def weighted_join(big: DataFrame, dim: DataFrame, on: str, weight: str, how: str,
                  spread_by: list[str], shares: int = HEAVY_SHARES) -> DataFrame:
    """Join ``big`` to ``dim``, unique and never NULL on ``on``, without a hot task.

    ``weight`` is a column of ``dim`` with the number of rows of ``big`` per
    key. The keys that hold at least one of ``shares`` parts of all rows are at
    most ``shares`` many, so broadcasting them is bounded at any size; the
    others are shuffled and none is larger than such a part. Rows that the
    broadcast has settled are spread by a hash of ``spread_by``. The weight is
    not part of the result; ``how`` is inner or left.
    """
    columns = [c for c in dim.columns if c not in (on, weight)]
    total = dim.agg(F.sum(weight).alias("n")).first()["n"] or 0
    bound = max(2, -(-total // shares))
    heavy = dim.where(F.col(weight) >= bound).select(
        on, F.lit(True).alias("_heavy"), *[F.col(c).alias(f"_h_{c}") for c in columns])
    light = dim.where(F.col(weight) < bound).select(
        on, F.lit(0).cast("bigint").alias("_spread"), F.lit(True).alias("_light"),
        *[F.col(c).alias(f"_l_{c}") for c in columns])
    split = big.join(F.broadcast(heavy), on, "left").withColumn(
        "_spread", F.when(F.col("_heavy") | F.col(on).isNull(),
                          F.pmod(F.xxhash64(*spread_by), F.lit(1 << 30)) + 1)
        .otherwise(F.lit(0).cast("bigint")))
    joined = split.join(light, [on, "_spread"], "left")
    if how == "inner":
        joined = joined.where(F.col("_heavy") | F.col("_light"))
    return joined.select(*big.columns, *[
        F.coalesce(f"_h_{c}", f"_l_{c}").alias(c) for c in columns])
