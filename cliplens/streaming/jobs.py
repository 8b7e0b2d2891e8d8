"""Incremental jobs: de-duplicating, appending, upserting and refreshing streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.session import path_exists

# Whole microseconds survive a round trip through text formats.
TIMESTAMPS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.format(fmt).load(path)


def dedup_stream(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """First arrival per key; state of a key is dropped ``delay`` after its time."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def run_append(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> None:
    """Process what is available and append it."""
    stream.writeStream.format(fmt).outputMode("append").options(**TIMESTAMPS).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_batches(stream: DataFrame, handle, checkpoint: str) -> None:
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


class VersionedTable:
    """Upserts of micro-batches as a log of changes, merged when read.

    The table lives at ``path`` and can be opened again after a restart. Each
    batch writes only its own rows with its number, so its cost does not grow
    with the table, and a repeated batch overwrites its own folder. The newest
    version of a key wins, whichever batch brings it; of equal versions the
    later batch, and inside a batch the largest row. ``compact`` folds the
    batches so far into a base, and reading merges the newest base with the
    batches after it.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str):
        self.spark, self.path, self.key, self.order = spark, path, key, order

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        self._newest(batch.withColumn("batch", F.lit(batch_id))).drop("batch").write.mode(
            "overwrite").parquet(f"{self.path}/log/batch={batch_id}")

    def compact(self) -> None:
        rows = self._rows()
        last = rows.agg(F.max("batch")).first()[0]
        if last is not None:
            self._newest(rows).withColumnRenamed("batch", "from_batch").write.mode("overwrite").parquet(
                f"{self.path}/base/upto={last}")

    def read(self) -> DataFrame:
        return self._newest(self._rows()).drop("batch")

    def _rows(self) -> DataFrame:
        log = self.spark.read.parquet(f"{self.path}/log")
        if not path_exists(self.spark, f"{self.path}/base"):
            return log
        base = self.spark.read.parquet(f"{self.path}/base")
        upto = base.agg(F.max("upto")).first()[0]
        folded = base.where(F.col("upto") == upto).drop("upto").withColumnRenamed("from_batch", "batch")
        return folded.unionByName(log.where(F.col("batch") > upto))

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in (self.key, self.order, "batch")]
        winner = F.max(F.struct(self.order, "batch", *others)).alias("v")
        return rows.groupBy(self.key).agg(winner).select(self.key, "v.*")


class RunningTotals:
    """Sums and counts per group at ``path``, kept as one small partial row set per batch."""

    def __init__(self, spark: SparkSession, path: str, group: str, value: str):
        self.spark, self.path, self.group, self.value = spark, path, group, value

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(self.group).agg(
            F.count("*").alias("n"), F.sum(self.value).alias("total")
        ).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).groupBy(self.group).agg(
            F.sum("n").alias("n"), F.sum("total").alias("total"))
