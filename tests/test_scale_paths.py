"""The paths for large or skewed data give the same results as brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliplens.operators import (
    blocks, components, density, joins, models, profile, quantiles, ranking, search, silhouettes, vectors,
)


@pytest.fixture(scope="module")
def cloud():
    """Three tight groups and noise; a third of all points are copies of one vector."""
    rng = np.random.default_rng(7)
    groups = [rng.normal(c, 0.1, (40, 4)) for c in (0.0, 3.0, 6.0)]
    noise = rng.uniform(-10, 10, (40, 4))
    copies = np.repeat(rng.normal(3.0, 0.1, (1, 4)), 80, axis=0)
    return np.round(np.vstack([*groups, noise, copies]), 6)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    monkeypatch.setattr(blocks, "pivot_count", lambda n: 8)
    monkeypatch.setattr(blocks, "QUERY_SPLIT", 2)


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)],
                                 f"{name} bigint, embedding array<double>")


def brute_knn(x, k):
    d = np.round(((x[:, None] - x[None]) ** 2).sum(2), 9)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k]}


@pytest.mark.parametrize("max_bytes", [1 << 30, 0])
def test_knn_both_paths(spark, cloud, small_blocks, max_bytes):
    got = blocks.knn(frame(spark, cloud, "query_id"), frame(spark, cloud), 5, max_bytes)
    assert {(r.query_id, r.id) for r in got.collect()} == brute_knn(cloud, 5)


def test_approximate_knn_reaches_its_recall(spark, cloud, small_blocks):
    found, cells = blocks.knn_approx(frame(spark, cloud, "query_id"), frame(spark, cloud), 5)
    want = brute_knn(cloud, 5)
    assert len(want & {(r.query_id, r.id) for r in found.collect()}) >= 0.85 * len(want) and cells < 8


def brute_dbscan(x, eps, min_samples):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= min_samples
    label, n = np.full(len(x), -1), 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = n
            while todo:
                for j in np.nonzero(near[todo.pop()] & core & (label < 0))[0]:
                    label[j] = n
                    todo.append(j)
            n += 1
    for i in np.nonzero(~core)[0]:
        touched = label[near[i] & core]
        label[i] = touched.min() if len(touched) else -1
    return near.sum(1), core, label


@pytest.mark.parametrize("split_joins", [False, True])
def test_dbscan_equals_brute_force(spark, cloud, small_blocks, monkeypatch, split_joins):
    if split_joins:
        monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    n, core, label = brute_dbscan(cloud, 0.35, 5)
    rows = density.dbscan(frame(spark, cloud), 0.35, 5).collect()
    assert {(r.id, r.is_core, r.cluster) for r in rows} == {
        (i, bool(core[i]), int(label[i])) for i in range(len(cloud))}
    counts = density.neighbor_counts(frame(spark, cloud), 0.35).collect()
    assert {(r.id, r.n_neighbors) for r in counts} == {(i, int(n[i])) for i in range(len(cloud))}


def test_long_chain_is_one_component(spark):
    nodes = spark.range(300)
    edges = spark.range(299).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = density.connected_labels(nodes, edges)
    assert got.where("root = 0").count() == 300


def test_zigzag_path_is_one_component(spark):
    """Neighbouring ids jump up and down, so no label can run along the path by itself."""
    order = [x for pair in zip(range(0, 200), range(399, 199, -1)) for x in pair]
    edges = spark.createDataFrame(list(zip(order, order[1:])), "u bigint, v bigint")
    got = density.connected_labels(spark.range(402), edges)
    assert got.where("root = 0").count() == 400
    assert {r.root for r in got.where("id >= 400").collect()} == {400, 401}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (190, 2))] + [(5, 5), (7, None)]
    edges += [(1000, i) for i in range(1001, 1100)]  # a hub
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components.connected_components(spark.createDataFrame(edges, "u bigint, v bigint"))
    assert {r.id: r.root for r in got.collect()} == {x: find(x) for x in list(parent)}
    assert components.connected_components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_dbscan_of_a_long_line(spark):
    line = frame(spark, [(i * 0.1, 0.0) for i in range(600)])
    assert {r.cluster for r in density.dbscan(line, 0.15, 2).collect()} == {0}


def test_numbering_has_no_gaps(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    got = {r.x: r.n for r in ranking.numbered(rows, [F.col("x").desc()], "n").collect()}
    assert got == {x: i for i, x in enumerate(sorted(got, reverse=True), 1)}


def test_variant_ids_never_collide(spark):
    rows = [(1, f"v{i}") for i in range(120)] + [(2, f"v{i}") for i in range(5)]
    got = search.number_variants(spark.createDataFrame(rows, "query_id bigint, variant string")).collect()
    assert len({r.variant_id for r in got}) == 125


def test_null_labels_are_in_no_cluster(spark):
    x = np.array([[0.0, i * 0.01] for i in range(20)] + [[9.0, i * 0.01] for i in range(20)] + [[50.0, 50.0]] * 10)
    pts = frame(spark, x).withColumn("label", F.when(F.col("id") < 20, 0).when(F.col("id") < 40, 1))
    assert vectors.silhouette(pts, ["label"]).first().score > 0.97


def test_far_clusters_are_not_opened(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(scale=0.1, size=(50, 4)) + c * 10 for c in range(8)])
    pts = frame(spark, x).withColumn("label", F.floor(F.col("id") / 50))
    summaries = silhouettes.Summaries(pts.withColumn("labeling", F.lit(0)))
    met = silhouettes.routed(pts, summaries).groupBy("query_id").count().collect()
    assert len(met) == 400 and max(r["count"] for r in met) <= 3  # its own, and one neighbour on each side
    assert vectors.silhouette(pts, ["label"]).first().score > 0.95


def test_silhouette_in_blocks(spark, cloud, small_blocks, monkeypatch):
    monkeypatch.setattr(silhouettes, "BLOCK_ROWS", 16)
    label = np.arange(len(cloud)) % 3
    label[0] = 9  # a cluster of one
    pts = frame(spark, cloud).withColumn("label", F.when(F.col("id") == 0, 9).otherwise(
        F.col("id") % 3).cast("bigint"))
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(2))
    s = []
    for i in range(len(cloud)):
        own = label == label[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        s.append((b - a) / max(a, b))
    got = vectors.silhouette(pts, ["label"]).first().score
    assert abs(got - np.mean(s)) < 1e-9


def test_kmeans_finds_the_groups(spark, cloud):
    pts = frame(spark, cloud[:120])
    chosen = vectors.choose_k(pts, range(2, 6), n_init=5)
    assert [r.k for r in chosen.where("is_best").collect()] == [3]
    centers = vectors.kmeans_sweep(pts, [3], 5)[3]
    sizes = vectors.assign_centers(pts, {"c": centers}).groupBy("c").count().collect()
    assert sorted(r["count"] for r in sizes) == [40, 40, 40]


def test_starts_come_from_all_points_and_empty_centers_move(spark, cloud):
    far = np.vstack([np.zeros((200, 2)), [[100.0, 100.0]], [[-100.0, 50.0]]])
    centers = vectors.kmeans_sweep(frame(spark, far), [3], 2)[3]
    assert sorted(map(tuple, np.round(centers))) == [(-100, 50), (0, 0), (100, 100)]
    with pytest.warns(UserWarning, match="not settled"):
        vectors.kmeans_sweep(frame(spark, cloud), [9], 1, max_iter=0)


def test_pca_equals_svd(spark, cloud):
    centred = cloud - cloud.mean(0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    got = {r.id: (r.pca_x, r.pca_y) for r in vectors.pca_2d(frame(spark, cloud)).collect()}
    for axis in range(2):
        v = vt[axis] * np.sign(vt[axis][np.abs(vt[axis]).argmax()])
        want = centred @ v
        assert max(abs(got[i][axis] - want[i]) for i in got) < 1e-6


def test_quantiles_of_a_hot_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        F.pmod(F.col("id") * 7919, F.lit(1013)).alias("v"))
    probs = {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    a = quantiles.grouped_quantiles(rows, ["g"], "v", probs)
    b = quantiles.grouped_quantiles(rows, ["g"], "v", probs, ranges=8, max_distinct=0)
    fast, slow = ({r.g: tuple(r)[1:] for r in x.collect()} for x in (a, b))
    assert fast.keys() == slow.keys()
    assert all(np.allclose(fast[g], slow[g]) for g in fast)


def test_heavy_keys_are_not_shuffled(spark):
    """A key of a third of the rows is settled by broadcast and its rows are spread."""
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    dim = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = joins.lookup_join(big, dim, ["k"], "left", max_bytes=0, salt_by=["id"])
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString() and got.where("v = k * 10").count() == 3000
    counts = dim.join(big.groupBy("k").agg(F.count("*").alias("n")), "k")
    weighted = joins.weighted_join(big, counts, "k", "n", "inner", ["id"], shares=100)
    assert weighted.columns == ["id", "k", "v"] and weighted.where("v = k * 10").count() == 3000


def test_split_join_equals_broadcast(spark):
    big = spark.range(500).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 9).alias("k"))
    dim = spark.range(8).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ["left", "inner", "left_semi", "left_anti"]:
        a = joins.lookup_join(big, dim, ["k"], how, proven_small=True)
        b = joins.lookup_join(big, dim, ["k"], how, max_bytes=0)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=(200, 5)), 200
    y = x @ np.arange(5.0) + 2 + rng.normal(size=n) * 0.3
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"])
    model = models.fit_ridge(df)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + np.eye(5), xc.T @ yc)
    assert np.abs(model.coefficients.toArray() - want).max() < 1e-6


def test_constant_column_histogram(spark):
    df = spark.createDataFrame([(5,), (5,)], "v int")
    assert [r.n for r in profile.histogram(df, ["v"], 3).orderBy("bin").collect()] == [2, 0, 0]
    assert {r.density for r in profile.kde(df, ["v"], 3).collect()} == {None}


def test_model_hook(spark):
    def make():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([("banana",), (None,)], "t string")
    got = [r.embedding for r in vectors.embed_with_model(df, "t", make, 2).collect()]
    assert got == [[6.0, 3.0], [0.0, 0.0]]
