"""Rows are copied to few blocks, however many cells a query probes, and the answers stay exact."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cliplens.operators import blocks, joins, search


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} bigint, embedding array<double>")


def test_blocks_cover_all_cells_and_stay_bounded(monkeypatch):
    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 10)
    monkeypatch.setattr(blocks, "MAX_BLOCK_ROWS", 50)
    monkeypatch.setattr(blocks, "SIDE_BLOCKS", 1)
    monkeypatch.setattr(blocks, "MASK_CELLS", 8)
    rng = np.random.default_rng(1)
    size = np.r_[rng.integers(0, 9, 60), 120, 51]
    first, parts, place = blocks.bundles(size, rng.normal(size=(62, 5)))
    assert parts.tolist() == [1] * 60 + [3, 2]
    held = {}
    for c in range(62):
        for b in range(first[c], first[c] + parts[c]):
            held.setdefault(int(b), []).append(c)
    for cells in held.values():
        assert len(cells) == 1 or sum(size[cells]) <= blocks.block_rows(int(size.sum()))
        assert len(cells) <= 8 and len(set(place[cells])) == len(cells)
    probed = rng.random((40, 62)) < 0.2
    row, block, mask = blocks.visits(probed, first, parts, place)
    assert len(set(zip(row.tolist(), block.tolist()))) == len(row)
    got = {(r, c, b) for r, b, m in zip(row.tolist(), block.tolist(), mask.tolist()) for c in held[b] if m >> int(place[c]) & 1}
    assert got == {(int(r), int(c), int(b)) for r, c in zip(*np.nonzero(probed)) for b in range(first[c], first[c] + parts[c])}
    assert all(len(part) == 0 for part in blocks.visits(probed[:0], first, parts, place))


@pytest.mark.parametrize("most", [4096, 20])
def test_all_pairs_are_measured_from_few_copies(spark, monkeypatch, most):
    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 1)
    monkeypatch.setattr(blocks, "SIDE_BLOCKS", 4)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", most)
    x = np.random.default_rng(2).normal(size=(600, 6))
    points, queries = frame(spark, x), frame(spark, x, "query_id")
    cells, copies = blocks.Cells(points, 40), []
    real = blocks.visits
    probed = cells.probes(x, 5, None)
    assert probed.sum(1).mean() > 30
    copies = real(probed, *blocks.bundles(cells.size, cells.centers))[0]
    assert len(copies) <= 8 * len(x)  # one for each probed cell before: over 30 times the rows
    seen = blocks.pair_blocks(queries, cells, lambda q, p: pd.DataFrame(
        {"q": [len(q)], "p": [len(p)], "pairs": [len(q) * len(p)]}), "q bigint, p bigint, pairs bigint", k=5)
    largest = seen.agg(F.max("q"), F.max("p"), F.sum("pairs")).first()
    assert largest[0] <= most and largest[1] <= most
    assert largest[2] == (probed * cells.size[None, :]).sum()
    hits = blocks._knn_blocks(queries, points, 5).collect()
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 9)
    want = {(i, int(j)) for i in range(600) for j in np.lexsort((np.arange(600), d[i]))[:5]}
    assert {(r.query_id, r.id) for r in blocks.top_k(spark.createDataFrame(hits), 5).collect()} == want


def test_a_block_returns_the_best_of_each_query(spark, monkeypatch):
    monkeypatch.setattr(blocks, "MIN_BLOCK_ROWS", 1 << 10)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 8)
    x = np.random.default_rng(4).normal(size=(200, 3))

    def all_hits(q, p):
        d = blocks.squared_distances(blocks.matrix(q["embedding"]), blocks.matrix(p["embedding"]))
        return pd.DataFrame({"query_id": np.repeat(q["query_id"].to_numpy(), len(p)),
                             "id": np.tile(p["id"].to_numpy(), len(q)), "distance": d.ravel()})

    cells = blocks.Cells(frame(spark, x), 9)
    found = blocks.pair_blocks(frame(spark, x, "query_id"), cells, all_hits, blocks.HIT_SCHEMA, eps=100.0, best=3)
    rows = found.collect()
    assert len(rows) == 600
    want = np.sort(((x[:, None] - x[None]) ** 2).sum(2), axis=1)[:, :3]
    got = np.array(sorted((r.query_id, r.distance) for r in rows))[:, 1].reshape(200, 3)
    assert np.allclose(np.sort(got, axis=1), want, atol=1e-9)


def test_texts_stay_where_they_are_read_unless_they_are_asked_for(spark, monkeypatch):
    monkeypatch.setattr(search, "fits_broadcast", lambda df, *a: False)
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, *a: False)
    corpus = spark.createDataFrame(
        [(1, "same", 5, "a", 1), (2, "same", 7, "b", 2), (3, "other", 1, "c", None), (4, None, 2, "d", 3), (4, "twice", 2, "d", 3)],
        "video_id bigint, title string, view_count bigint, category string, cluster_id bigint")
    hits = spark.createDataFrame([(q, v, 1.0 / v) for q in range(9) for v in (1, 2, 3, 4)] + [(0, 1, 3.0)],
                                 "query_id bigint, video_id bigint, score double")
    whole = search.merge_by_title(hits, corpus, "dense")
    slim = search.merge_by_title(hits, corpus, "dense", titles=False)
    assert slim.columns == [c for c in whole.columns if c != "title"] and whole.count() == 36
    assert sorted(map(str, slim.collect())) == sorted(map(str, whole.drop("title").collect()))
    assert "title" not in slim._jdf.queryExecution().optimizedPlan().toString().replace("_title", "")
