"""Totals per group that follow inserts, updates, moves between groups and deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplens.operators.joins import lookup_join
from cliplens.session import _file_system, materialize, path_exists

INDEX = "bucket int, batch long"
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class TakeBackTotals:
    """Counts and sums per group at ``path``; a changed or deleted item leaves its old group.

    The newest row of each key is kept in buckets by key hash. A batch opens
    the buckets of its own keys only: what it replaces is subtracted from the
    old group, what it brings is added to the new one, and just these buckets
    are written again, next to the old ones. The kept rows are not shuffled
    while the changes are small enough to be sent to them. Choose ``buckets``
    so that one is some hundred megabytes.

    A batch has the columns ``key``, ``order``, ``group``, ``value`` (whole or
    decimal numbers, so that taking back is exact) and ``deleted``. The highest
    order wins, whichever batch brings it; of equal ones the later batch, and
    inside a batch a deletion, then the largest row. Deleted keys are kept
    without counting, so a late old version does not bring them back. Rows
    without key or order are no change. A NULL group is a group; a NULL value
    counts as an item and adds nothing. A table of empty batches only gives no rows.

    The index is written last and commits a batch; one that is repeated after
    a failure starts from the batches before it and overwrites its own files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, group: str, value: str,
                 deleted: str = "deleted", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.names = {"k": key, "v": order, "gone": deleted, "g": group, "x": value}

    def write_batch(self, batch: DataFrame, batch_id: int) -> None:
        changes = self._changes(batch)
        before = self._current(batch_id)
        touched = [r["bucket"] for r in changes.select("bucket").distinct().collect()]
        if not touched:
            if not before:  # the columns, for readers of a table that holds nothing yet
                changes.write.mode("overwrite").parquet(f"{self.path}/none")
            return
        kept = self._kept({b: before[b] for b in touched if b in before}, changes.schema)
        pairs = materialize(lookup_join(
            kept, changes.select("k", F.col("v").alias("nv")), ["k"], "inner"), "replaced")
        late = pairs.where(F.col("nv") < F.col("v")).select("k")
        winners = materialize(lookup_join(changes, late, ["k"], "left_anti").select(*changes.columns), "winners")
        self._next(kept, winners).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/rows/batch={batch_id}")

        taken = pairs.where((F.col("nv") >= F.col("v")) & ~F.col("gone"))
        n, x = F.lit(1).cast("bigint"), F.coalesce("x", F.lit(0))
        moves = taken.select("g", (-n).alias("n"), (-x).alias("total")).unionByName(
            winners.where(~F.col("gone")).select("g", n.alias("n"), x.alias("total")))
        if before:
            moves = moves.unionByName(self.spark.read.parquet(
                f"{self.path}/totals/batch={max(before.values())}"))
        kind = T.DecimalType(38, changes.schema["x"].dataType.scale) if isinstance(
            changes.schema["x"].dataType, T.DecimalType) else T.LongType()
        moves.groupBy("g").agg(F.sum("n").alias("n"), F.sum("total").cast(kind).alias("total")).where(
            "n <> 0").write.mode("overwrite").parquet(f"{self.path}/totals/batch={batch_id}")
        self.spark.createDataFrame([(b, batch_id) for b in touched], INDEX).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.path}/index/{batch_id}")

    def totals(self) -> DataFrame:
        """(group, n, total) after the last committed batch; groups without items are gone."""
        now = self._current()
        if now:
            t = self.spark.read.parquet(f"{self.path}/totals/batch={max(now.values())}")
        else:
            t = self._none().select("g", F.lit(0).cast("bigint").alias("n"), F.col("x").alias("total"))
        return t.select(F.col("g").alias(self.names["g"]), "n", "total")

    def rows(self) -> DataFrame:
        """The newest row of each key that is not deleted."""
        now = self._current()
        rows = (self._kept(now, None) if now else self._none()).where(~F.col("gone"))
        return rows.select(*[F.col(c).alias(self.names[c]) for c in ("k", "v", "g", "x")])

    def vacuum(self) -> int:
        """Drop files that neither the last batch nor a repetition of it needs; returns their folders."""
        now = self._current()
        if not now:
            return 0
        last = max(now.values())
        used = set(now.items()) | set(self._current(last).items())
        dropped = [f"rows/batch={r['batch']}/bucket={r['bucket']}" for r in self._index().collect()
                   if (r["bucket"], r["batch"]) not in used]
        for folder in dropped:
            store, where = _file_system(self.spark, f"{self.path}/{folder}")
            store.delete(where, True)
        return len(dropped)

    def _changes(self, batch: DataFrame) -> DataFrame:
        c = {short: F.col(f"`{name}`") for short, name in self.names.items()}
        rows = batch.select(c["k"].alias("k"), c["v"].alias("v"), F.coalesce(c["gone"], F.lit(False)).alias("gone"),
                            c["g"].alias("g"), c["x"].alias("x")).where("k IS NOT NULL AND v IS NOT NULL")
        if not isinstance(rows.schema["x"].dataType, (T.DecimalType, *WHOLE)):
            raise ValueError(f"{self.names['x']} must be a whole or decimal number to be taken back exactly")
        newest = rows.groupBy("k").agg(F.max(F.struct("v", "gone", "g", "x")).alias("r")).select("k", "r.*")
        bucket = F.pmod(F.xxhash64("k"), F.lit(self.buckets)).cast("int")
        # By bucket, so that a task writes few of the bucket folders.
        return materialize(newest.withColumn("bucket", bucket).repartition("bucket"), "changes")

    def _none(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/none")

    def _index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index/*")

    def _current(self, before: int | None = None) -> dict[int, int]:
        """The last committed batch of each bucket, of those below ``before``."""
        if not path_exists(self.spark, f"{self.path}/index"):
            return {}
        rows = self._index()
        if before is not None:
            rows = rows.where(F.col("batch") < before)
        return {r["bucket"]: r["batch"] for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}

    def _kept(self, where: dict[int, int], schema) -> DataFrame:
        if not where:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in sorted(where.items())]
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*paths).drop("batch")

    @staticmethod
    def _next(kept: DataFrame, winners: DataFrame) -> DataFrame:
        left = lookup_join(kept, winners.select("k"), ["k"], "left_anti")
        return left.select(*winners.columns).unionByName(winners)
