"""Upsert, insert-only and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, key: str = "video_id") -> DataFrame:
    """Rows of ``delta`` replace those of ``base`` whole, NULLs included."""
    return base.join(delta, key, "left_anti").unionByName(delta)


def upsert_counts(base: DataFrame, delta: DataFrame, key: str = "video_id") -> DataFrame:
    known = base.select(key, F.lit(1).alias("_known"))
    return delta.select(key).join(known, key, "left").agg(
        F.count_if(F.col("_known").isNull()).alias("inserted"),
        F.count("_known").alias("updated"),
    )


def unseen(items: DataFrame, history: DataFrame, key: str = "video_id") -> DataFrame:
    """Items whose key is not in the history.

    AQE splits the partition of an item key that is repeated very often.
    """
    return items.join(history.select(key), key, "left_anti")


def get_by_id(df: DataFrame, value, key: str = "video_id") -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def get_by_ids(df: DataFrame, ids: DataFrame, key: str = "video_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def sample_rows(df: DataFrame, n: int, key: str = "video_id", seed: int = 42) -> DataFrame:
    """A seeded sample of ``n`` rows, the same in every plan."""
    from cliplens.functions.numbers import hash_order

    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def split_train_test(df: DataFrame, key: str = "video_id", test_share: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """Adds ``is_train`` from a stable hash of the key."""
    from cliplens.functions.numbers import hash_int

    cut = round((1 - test_share) * 1000)
    return df.withColumn("is_train", F.pmod(hash_int(F.col(key), seed), F.lit(1000)) < cut)
