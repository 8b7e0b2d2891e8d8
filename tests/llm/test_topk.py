"""op10: against all inner products."""

import math

import numpy as np
import pytest

from cliplens.llm.topk import integer_vectors, search_shard, top_k, Block, _NONE


def brute(rows, k, scale=64):
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {i: a for i, a in sorted(kept, reverse=True) if i % 20 == 0}.items():
        scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in kept if i != q))[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


def search(spark, rows, kind="float", **options):
    df = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>").repartition(3)
    vectors = integer_vectors(df, "vec_id", "embedding", 64)
    return sorted(map(tuple, top_k(vectors.where("id % 20 = 0"), vectors, 20, **options).collect()))


@pytest.mark.parametrize("block_bytes", [32 << 20, 200])
def test_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) / 3]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(300, 420)]  # a vector with very many copies
    rows += [(500, None), (501, [1.0, None] * 4), (520, [float("nan")] * 8), (521, [float("inf")] * 8),
             (None, rows[1][1]), (540, [0.0] * 8), (541, [-0.01] * 8)]
    assert search(spark, rows, block_bytes=block_bytes) == brute(rows, 20)


def test_few_candidates_wide_values_and_empty(spark):
    rows = [(20, [1e6, -1e6]), (21, [1e6, 3.0]), (22, [-5.5, 1e9]), (40, [2.0])]
    assert search(spark, rows, "double") == brute(rows, 20)
    assert search(spark, []) == [] and search(spark, [(20, [1.0])]) == []


def test_bounds_leave_no_answer_out():
    rng = np.random.default_rng(5)
    shard, queries = rng.integers(-20, 20, (3000, 16)), rng.integers(-20, 20, (30, 16))
    ids = np.arange(3000)
    block = Block(np.arange(5000, 5030), queries, np.full(30, _NONE), 7)
    floors, best = block.floor.copy(), [(np.empty(0, np.int64), np.empty(0, np.int64))] * 30
    for at in range(0, 3000, 500):
        search_shard(block, ids[at:at + 500], shard[at:at + 500], floors, best)
    scores = queries @ shard.T
    for i in range(30):
        want = sorted(zip(-scores[i], ids))[:7]
        assert [(-s, j) for j, s in zip(*best[i])] == want
