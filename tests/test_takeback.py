"""Totals with take-back against counting everything again."""

import random
from decimal import Decimal

import pytest

from cliplens.operators import joins
from cliplens.streaming.takeback import TakeBackTotals

SCHEMA = "id long, version long, deleted boolean, topic string, views long, id_2 string"


def store(spark, path, **how):
    return TakeBackTotals(spark, str(path), "id", "version", "topic", "views", **how)


def recount(batches):
    """Newest row per id by version, then batch, then deletion and row."""
    best = {}
    for n, rows in enumerate(batches):
        for i, v, gone, topic, views, _ in rows:
            if i is None or v is None:
                continue
            rank = (v, n, bool(gone), (topic is not None, topic or ""), (views is not None, views or 0))
            if i not in best or rank > best[i][0]:
                best[i] = (rank, gone, topic, views)
    totals = {}
    for _, gone, topic, views in best.values():
        if not gone:
            n, x = totals.get(topic, (0, 0))
            totals[topic] = (n + 1, x + (views or 0))
    return totals


def found(table):
    return {r["topic"]: (r["n"], r["total"]) for r in table.totals().collect()}


def make(seed, n_batches=4, size=60):
    rng = random.Random(seed)
    return [[(rng.choice([None, *range(40)]), rng.choice([None, *range(6)]), rng.choice([True, False, False, None]),
              rng.choice([None, "a", "b", "c"]), rng.choice([None, *range(-5, 50)]), "x") for _ in range(size)]
            for _ in range(n_batches)]


@pytest.mark.parametrize("seed, small", [(1, True), (2, False)])
def test_equals_recount_after_every_batch(spark, tmp_path, monkeypatch, seed, small):
    if not small:
        monkeypatch.setattr(joins, "fits_broadcast", lambda *a: False)
    batches = make(seed)
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, SCHEMA)
        store(spark, tmp_path / "t", buckets=5).write_batch(frame, n)
        assert found(store(spark, tmp_path / "t", buckets=5)) == recount(batches[:n + 1])


def test_repeated_batch_and_vacuum(spark, tmp_path):
    batches = make(3)
    for n, rows in enumerate(batches):
        table = store(spark, tmp_path / "t", buckets=3)
        for _ in range(2 if n in (0, 2) else 1):
            table.write_batch(spark.createDataFrame(rows, SCHEMA), n)
    want = recount(batches)
    assert found(table) == want
    assert table.vacuum() == 6 and found(table) == want  # three buckets, two batches of four
    table.write_batch(spark.createDataFrame(batches[-1], SCHEMA), 3)
    assert found(table) == want
    live = table.rows().collect()
    assert len(live) == sum(n for n, _ in want.values())


def test_uncommitted_batch_is_not_seen(spark, tmp_path):
    table = store(spark, tmp_path / "t", buckets=2)
    table.write_batch(spark.createDataFrame([(1, 1, False, "a", 5, "")], SCHEMA), 0)
    # What a batch leaves that stops before its index is written.
    spark.createDataFrame([(1, 2, False, "b", 9)], "k long, v long, gone boolean, g string, x long").selectExpr(
        "*", "0 AS bucket").write.partitionBy("bucket").parquet(f"{tmp_path}/t/rows/batch=1")
    assert found(table) == {"a": (1, 5)}
    table.write_batch(spark.createDataFrame([(1, 2, False, "b", 7, "")], SCHEMA), 1)
    assert found(table) == {"b": (1, 7)}


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = store(spark, tmp_path / "t", buckets=8)
    table.write_batch(spark.range(200).selectExpr(
        "id", "1L AS version", "false AS deleted", "'a' AS topic", "id AS views"), 0)
    table.write_batch(spark.createDataFrame([(7, 2, True, None, None, "")], SCHEMA), 1)
    assert len(list((tmp_path / "t/rows/batch=0").glob("bucket=*"))) == 8
    assert len(list((tmp_path / "t/rows/batch=1").glob("bucket=*"))) == 1
    assert found(table) == {"a": (199, sum(range(200)) - 7)}


def test_kept_rows_are_not_shuffled(spark, tmp_path):
    table = store(spark, tmp_path / "t", buckets=4)
    table.write_batch(spark.range(50).selectExpr(
        "id", "1L AS version", "false AS deleted", "'a' AS topic", "id AS views"), 0)
    kept = table._kept(table._current(), None)
    plan = table._next(kept, kept.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_decimals_are_exact_and_doubles_refused(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    base = spark.range(3).selectExpr("id", "1L AS version", "false AS deleted", "'a' AS topic",
                                     "CAST(0.1 AS DECIMAL(9,2)) AS views")
    table.write_batch(base, 0)
    table.write_batch(base.where("id = 0").selectExpr("id", "2L AS version", "true AS deleted", "topic", "views"), 1)
    assert found(table) == {"a": (2, Decimal("0.20"))}
    with pytest.raises(ValueError):
        table.write_batch(base.selectExpr("id", "version", "deleted", "topic", "0.5D AS views"), 2)


def test_empty_batch_changes_nothing(spark, tmp_path):
    table = store(spark, tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    table.write_batch(empty, 0)
    assert found(table) == {} and table.rows().collect() == [] and table.vacuum() == 0
    table.write_batch(spark.createDataFrame([(1, 1, False, "a", 5, "")], SCHEMA), 1)
    table.write_batch(empty, 2)
    assert found(table) == {"a": (1, 5)} and table.vacuum() == 0
