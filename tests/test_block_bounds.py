"""Blocks of queries and routed frames stay bounded where one center is the nearest of most rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplens.operators import blocks, silhouettes


def test_a_home_of_many_queries_is_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 32)
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(0, 0.01, (600, 4)), rng.uniform(-90, 90, (40, 4))])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    queries = points.withColumnRenamed("id", "query_id")
    cells = blocks.Cells(points, 8)
    seen = blocks.pair_blocks(queries, cells, lambda q, p: pd.DataFrame(
        {"q": [len(q)], "p": [len(p)], "pairs": [len(q) * len(p)]}), "q bigint, p bigint, pairs bigint", eps=1000.0)
    most = seen.agg(F.max("q"), F.max("p"), F.sum("pairs")).first()
    assert most[0] <= 96 and most[1] <= 96 and most[2] == len(x) ** 2


def test_repeated_rows_come_in_bounded_frames(monkeypatch):
    monkeypatch.setattr(blocks, "ROUTE_ROWS", 7)
    batch = pd.DataFrame({"a": [10, 11, 12, 13]})
    found = [(int(v), int(i), int(c)) for out, place, copy in blocks.repeated(batch, np.array([3, 1, 20, 2]))
             for v, i, c in zip(out["a"], place, copy) if len(out) <= 7]
    assert found == [(10 + i, i, c) for i, n in enumerate([3, 1, 20, 2]) for c in range(n)]
    assert list(blocks.repeated(batch[:0], np.array([], int))) == []


def test_nearest_center_in_pieces(monkeypatch):
    monkeypatch.setattr(blocks, "PIECE_CELLS", 1)
    x, centers = np.random.default_rng(1).normal(size=(2, 300, 5))
    d = blocks.squared_distances(x, centers)
    near, gap = blocks.nearest_center(x, centers)
    assert (near == d.argmin(1)).all() and np.allclose(gap, d.min(1))


def test_silhouette_routes_in_bounded_frames(spark, monkeypatch):
    monkeypatch.setattr(silhouettes, "BLOCK_ROWS", 4)
    monkeypatch.setattr(blocks, "ROUTE_ROWS", 50)
    x = np.random.default_rng(5).normal(size=(90, 3))
    summaries = type("S", (), {})()
    summaries.n = np.array([60, 30])
    summaries.opened = lambda some, own: np.ones((len(some), 2), bool)
    frames = []

    class Table:
        schema = {"embedding": T.StructField("embedding", T.ArrayType(T.DoubleType()))}

        def select(self, *columns):
            return self

        def mapInPandas(self, route, schema):
            batch = pd.DataFrame({"id": np.arange(90), "embedding": list(x), "label": np.arange(90) % 2})
            frames.extend(route([batch]))

    silhouettes.routed(Table(), summaries)
    assert max(map(len, frames)) <= 50
    rows = pd.concat(frames).groupby(["query_id", "cluster"])["chunk"].apply(sorted)
    assert rows.map(list).to_dict() == {(i, c): list(range(n)) for i in range(90) for c, n in [(0, 15), (1, 8)]}
