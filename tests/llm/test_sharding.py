"""op4: exact sizes, whole results and the law of the counts."""

import collections

import numpy as np

from cliplens.llm import sharding
from cliplens.llm.sharding import draw_row, hypergeometric, shuffle_into_shards


def test_rows_are_whole_and_sizes_exact(spark):
    rows = spark.range(1003).selectExpr("id", "'same' AS text", "id % 2 AS slot").repartition(7)
    out = shuffle_into_shards(rows, 40, range_rows=5).collect()
    assert sorted(r["id"] for r in out) == list(range(1003))
    by = collections.defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(40)) and {len(v) for v in by.values()} == {25, 26}
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_hot_and_few_rows(spark, edge_docs, edge_rows, no_docs):
    out = shuffle_into_shards(edge_docs, 40).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in out) == collections.Counter(edge_rows)
    assert {r["slot"] for r in out} == {0} and len({r["shard"] for r in out}) == len(edge_rows)
    assert "src0" in {r["source"] for r in out}
    assert shuffle_into_shards(no_docs, 40).count() == 0


def test_places_are_uniform(spark):
    """Rows of one partition reach every shard and slot about equally often."""
    rows = spark.range(40, numPartitions=4)
    seen = np.zeros((40, 8))
    for seed in range(12):
        for r in shuffle_into_shards(rows, 4, seed=seed * 7).collect():
            seen[r["shard"] * 10 + r["slot"], r["id"] // 5] += 1
    assert seen.sum() == 480 and seen.max() <= 8  # 1.5 are expected of each


def test_counts_follow_the_hypergeometric_law(monkeypatch):
    want = np.random.default_rng(2).hypergeometric(50, 150, 40, 20_000)
    monkeypatch.setattr(sharding, "_NUMPY_LIMIT", 0)  # the way taken at any larger size
    rng = np.random.default_rng(1)
    mine = [hypergeometric(rng, 50, 150, 40) for _ in range(20_000)]
    assert abs(np.mean(mine) - want.mean()) < 0.08 and abs(np.var(mine) - want.var()) < 0.25
    big = [hypergeometric(rng, 10 ** 10, 39 * 10 ** 10, 40_000) for _ in range(300)]
    assert abs(np.mean(big) - 1000) < 10 and 25 < np.std(big) < 37
    assert hypergeometric(rng, 5, 0, 5) == 5 and hypergeometric(rng, 0, 5, 5) == 0
    left = [26] * 3 + [25] * 37
    for draws in (100, 0, 903):
        row = draw_row(rng, left, draws)
        assert sum(row) == draws and all(0 <= a <= b for a, b in zip(row, left))
        left = [b - a for a, b in zip(row, left)]
    assert sum(left) == 0
