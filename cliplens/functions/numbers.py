"""Number repair, rounding and stable hash order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def crawl_number(value: Column) -> Column:
    """Text that is not a whole number counts as 0, so '12.7' gives 0."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def load_number(value: Column) -> Column:
    """Any number, truncated, so '12.7' gives 12; the rest is 0."""
    return F.coalesce(value.try_cast("double").cast("bigint"), F.lit(0).cast("bigint"))


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.cast("double"), F.lit(0.0)), F.lit(0.0))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(value, digits) + F.lit(0.0)


def hash_order(key: Column, seed: int) -> Column:
    """A seeded order that is the same in every plan, run and engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def hash_int(key: Column, seed: int) -> Column:
    """28 bits of the seeded hash as a number."""
    return F.conv(F.substring(hash_order(key, seed), 1, 7), 16, 10).cast("bigint")
