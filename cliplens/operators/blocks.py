"""Distances between two sets of vectors in bounded blocks.

``pair_blocks`` brings together only those blocks of queries and points that
can hold an answer. Points are assigned to the nearest of a bounded number of
pivots; by the triangle inequality a query skips every cell that lies farther
away than its search radius. Neighbouring cells share a block, and a cell that
holds a third of all points is cut into several by a hash of the id. Blocks grow
with the tables up to a bound, so a row is copied to few of them; inside a block
a query is compared only with the cells it probes, in pieces. A block returns
reduced results (the best k, a count, a sum), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliplens.operators.joins import fits_broadcast, lookup_join
from cliplens.session import materialize

BLOCK_ROWS = 2048
MIN_PIVOTS, MAX_PIVOTS = 8, 1024
TIE_DIGITS = 9
SLACK = 1e-6
QUERY_SPLIT = 1
SIDE_BLOCKS, MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 16, 512, 1 << 16
MASK_CELLS = 63  # cells of a block, one bit each
PIECE_CELLS, ROUTE_ROWS = 1 << 21, 1 << 14


def pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of ``rows`` whose matrix against ``width`` others stays within ``PIECE_CELLS``."""
    step = max(64, PIECE_CELLS // max(1, width))
    for at in range(0, rows, step):
        yield slice(at, min(rows, at + step))


def nearest_center(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each row and its squared distance, piece by piece."""
    near, gap = np.empty(len(x), np.int64), np.empty(len(x))
    for some in pieces(len(x), len(centers)):
        d = squared_distances(x[some], centers)
        near[some] = d.argmin(1)
        gap[some] = np.take_along_axis(d, near[some][:, None], 1)[:, 0]
    return near, gap


def repeated(batch: pd.DataFrame, reps: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """Row ``i`` of ``batch`` ``reps[i]`` times in bounded frames: (frame, place in batch, number of the copy)."""
    ends = np.cumsum(reps)
    for at in range(0, int(ends[-1]) if len(ends) else 0, ROUTE_ROWS):
        copies = np.arange(at, min(int(ends[-1]), at + ROUTE_ROWS))
        place = np.searchsorted(ends, copies, side="right")
        yield batch.iloc[place], place, copies - (ends - reps)[place]


def matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def arrow_matrix(vectors: pa.Array) -> np.ndarray:
    """The rows of a batch of vectors, without a Python object for each."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), -1)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def nearest(q: np.ndarray, qids: np.ndarray, c: np.ndarray, cids: np.ndarray, k: int):
    """(query position, id, squared distance) of the k nearest, ties by id."""
    approx = squared_distances(q, c)
    if len(cids) > k:
        kth = np.partition(approx, k - 1, axis=1)[:, k - 1]
        rows, cols = np.nonzero(approx <= kth[:, None] + SLACK)
    else:
        rows, cols = np.nonzero(np.ones_like(approx, dtype=bool))
    d = np.round(((q[rows] - c[cols]) ** 2).sum(1), TIE_DIGITS)
    return best_k(rows, cids[cols], d, k)


def best_k(rows: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int):
    order = np.lexsort((ids, d, rows))
    rows, ids, d = rows[order], ids[order], d[order]
    starts = np.r_[0, np.nonzero(np.diff(rows))[0] + 1] if len(rows) else np.array([0])
    place = np.arange(len(rows)) - np.repeat(starts, np.diff(np.r_[starts, len(rows)]))
    keep = place < k
    return rows[keep], ids[keep], d[keep]


def top_k(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def knn(queries: DataFrame, points: DataFrame, k: int, max_bytes: int = 32 << 20) -> DataFrame:
    """Exact k nearest points of each query by squared L2: (query_id, id, distance, rank).

    ``queries`` has (query_id, embedding) and ``points`` (id, embedding), both
    with numeric keys. A query batch whose measured size is small is sent to
    the tasks that read the points; a larger one goes through blocks.
    """
    if fits_broadcast(queries.select("query_id", "embedding"), max_bytes):
        hits = _knn_scan(queries, points, k)
    else:
        hits = _knn_blocks(queries, points, k)
    return top_k(hits, k)


HIT_SCHEMA = "query_id bigint, id bigint, distance double"


def _knn_scan(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    local = queries.select("query_id", "embedding").toPandas()  # measured by the caller
    if local.empty:
        return queries.sparkSession.createDataFrame([], HIT_SCHEMA)
    shared = queries.sparkSession.sparkContext.broadcast(
        (local["query_id"].to_numpy(), matrix(local["embedding"]))
    )

    def scan(batches):
        qids, q = shared.value
        kept = (np.empty(0, int), np.empty(0, np.int64), np.empty(0))
        for batch in batches:
            if batch.empty:
                continue
            c, cids = matrix(batch["embedding"]), batch["id"].to_numpy()
            found = [kept]
            for at in range(0, len(q), 256):
                r, i, d = nearest(q[at:at + 256], qids, c, cids, k)
                found.append((r + at, i, d))
            kept = best_k(*(np.concatenate(part) for part in zip(*found)), k)
        rows, ids, d = kept
        yield pd.DataFrame({"query_id": qids[rows], "id": ids, "distance": d})

    return points.select("id", "embedding").mapInPandas(scan, HIT_SCHEMA)


def distinct_vectors(points: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Exact copies share a ``rep``, the smallest id: (rep, embedding, weight), (id, rep).

    Only the hash of a vector is shuffled together with it; grouping counts
    copies before the shuffle, so a vector with very many copies is cheap.
    """
    reps = materialize(points.groupBy("embedding").agg(
        F.min(id_col).alias("rep"), F.count("*").alias("weight")), "distinct-vectors")
    members = lookup_join(
        points.select(id_col, "embedding"), reps.select("embedding", "rep"), ["embedding"],
        "inner", salt_by=[id_col],
    ).select(id_col, "rep")
    return reps, members


def pivot_count(n: int) -> int:
    """Pivots grow with the square root of the points, within what a task can compare."""
    return min(MAX_PIVOTS, max(MIN_PIVOTS, math.isqrt(n) // 4))


class Cells:
    """Points by nearest pivot, written once, with the size and radius of each cell."""

    def __init__(self, points: DataFrame, pivots: int | None = None):
        pivots = pivots or pivot_count(points.count())
        chosen = (
            points.select("id", "embedding").orderBy(F.md5(F.col("id").cast("string")), "id")
            .limit(pivots).collect()
        )
        self.centers = matrix([r["embedding"] for r in chosen]) if chosen else np.empty((0, 1))
        centers = self.centers

        def assign(batches):
            for batch in batches:
                if batch.empty:
                    continue
                cell, gap = nearest_center(matrix(batch["embedding"]), centers)
                yield batch.assign(cell=cell.astype("int32"), reach=np.sqrt(gap))

        schema = T.StructType(points.schema.fields + [
            T.StructField("cell", T.IntegerType()), T.StructField("reach", T.DoubleType())])
        self.points = materialize(points.mapInPandas(assign, schema), "cells")
        self.size = np.zeros(len(centers), dtype=np.int64)
        self.radius = np.zeros(len(centers))
        if len(centers):
            for r in self.points.groupBy("cell").agg(
                    F.count("*").alias("n"), F.max("reach").alias("r")).collect():
                self.size[r["cell"]], self.radius[r["cell"]] = r["n"], r["r"]

    def probes(self, q: np.ndarray, k: int | None, eps: float | None,
               nearest_cells: int | None = None) -> np.ndarray:
        """Which cells each query must visit, or its nearest ones if their number is given."""
        d = np.sqrt(squared_distances(q, self.centers))
        filled = self.size > 0
        if nearest_cells is not None:
            order = np.argsort(np.where(filled, d, np.inf), axis=1)[:, :nearest_cells]
            out = np.zeros(d.shape, dtype=bool)
            np.put_along_axis(out, order, True, axis=1)
            return out & filled
        if eps is None:
            upper = np.where(filled, d + self.radius, np.inf)
            order = np.argsort(upper, axis=1)
            reached = np.cumsum(self.size[order], axis=1) >= k
            first = reached.argmax(1)
            at = np.take_along_axis(order, first[:, None], 1)
            limit = np.where(reached.any(1), np.take_along_axis(upper, at, 1)[:, 0], np.inf)
        else:
            limit = np.full(len(q), eps)
        return filled & (d - self.radius <= limit[:, None] + SLACK)


def block_rows(n: int) -> int:
    """Rows of a block: a fixed share of all rows, within what a task can hold."""
    return max(MIN_BLOCK_ROWS, min(MAX_BLOCK_ROWS, -(-n // SIDE_BLOCKS)))


def bundles(size: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell its first block, its number of blocks and its place inside the block.

    Small cells share a block with those next to them on the main axis of the
    centers; a cell beyond the bound has blocks of its own.
    """
    rows = block_rows(int(size.sum()))
    first, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    parts = np.maximum(1, -(-size // rows))
    if len(size) < 2:
        return first, parts, place
    centers = np.where(np.isfinite(centers), centers, 0.0)
    axis = np.linalg.svd(centers - centers.mean(0), full_matrices=False)[2][0]
    at, held, cells = 0, 0, 0
    for c in np.argsort(centers @ axis, kind="stable").tolist():
        if parts[c] > 1:
            continue
        if cells and (held + size[c] > rows or cells == MASK_CELLS):
            at, held, cells = at + 1, 0, 0
        first[c], place[c] = at, cells
        held, cells = held + size[c], cells + 1
    wide = np.flatnonzero(parts > 1)
    first[wide] = at + 1 + np.cumsum(parts[wide]) - parts[wide]
    return first, parts, place


def visits(probed: np.ndarray, first: np.ndarray, parts: np.ndarray, place: np.ndarray):
    """(row, block, mask): the blocks that each row of ``probed`` visits, and a bit for each cell it probes there."""
    rows, cols = np.nonzero(probed)
    reps = parts[cols]
    starts = np.cumsum(reps) - reps
    block = np.repeat(first[cols] - starts, reps) + np.arange(int(reps.sum()))
    row, bit = np.repeat(rows, reps), np.repeat(np.int64(1) << place[cols], reps)
    order = np.lexsort((block, row))
    row, block, bit = row[order], block[order], bit[order]
    new = np.flatnonzero(np.r_[True, (np.diff(row) != 0) | (np.diff(block) != 0)][:len(row)])
    return row[new], block[new], np.bitwise_or.reduceat(bit, new) if len(new) else bit


def pair_blocks(queries: DataFrame, cells: Cells, reducer, schema: str, k: int | None = None,
                eps: float | None = None, nearest_cells: int | None = None,
                best: int | None = None) -> DataFrame:
    """Run ``reducer(query_frame, point_frame)`` on every piece of blocks that matters.

    The points of a call are of one cell and the queries those that probe it,
    ``BLOCK_ROWS`` of each at most. Queries are blocked by their own nearest
    pivot, so those of a block probe much the same cells, and a point goes only
    to the query blocks that probe its block. With ``best``, a pair of blocks
    returns that many rows of the least (distance, id) for each query.
    """
    first, parts, place = bundles(cells.size, cells.centers)
    probe_args = _ProbeArgs(cells.centers, cells.size, cells.radius)
    q_first, q_parts, _ = bundles(_at_home(queries, cells.centers), cells.centers)

    def route(batches):
        for whole in batches:
            for some in pieces(len(whole), len(first)):
                batch = whole.iloc[some]
                q = matrix(batch["embedding"])
                row, block, mask = visits(Cells.probes(probe_args, q, k, eps, nearest_cells), first, parts, place)
                home = nearest_center(q, probe_args.centers)[0]
                for at in range(0, len(row), ROUTE_ROWS):
                    some_rows = row[at:at + ROUTE_ROWS]
                    yield batch.iloc[some_rows].assign(
                        block=block[at:at + ROUTE_ROWS], mask=mask[at:at + ROUTE_ROWS], home=home[some_rows])

    routed_schema = T.StructType(queries.schema.fields + [
        T.StructField(name, T.LongType()) for name in ("block", "mask", "home")])
    at_home = F.element_at(_constants(q_parts * QUERY_SPLIT), (F.col("home") + 1).cast("int"))
    routed = queries.mapInPandas(route, routed_schema).withColumn(
        "q_block", F.element_at(_constants(q_first * QUERY_SPLIT), (F.col("home") + 1).cast("int"))
        + F.pmod(F.xxhash64("query_id"), at_home)).drop("home")
    if not len(first):
        routed = routed.limit(0)
    cell = F.col("cell") + 1
    placed = cells.points.withColumn("block", F.element_at(_constants(first), cell) + F.pmod(
        F.xxhash64("id"), F.element_at(_constants(parts), cell)))
    # Blocks of queries by block of points: a small table next to the queries themselves.
    asked = materialize(routed.groupBy("block").agg(F.collect_set("q_block").alias("q_blocks")), "probes")
    split = lookup_join(placed, asked, ["block"], "inner", salt_by=["id"]).withColumn(
        "q_block", F.explode("q_blocks")).drop("q_blocks")
    keys = ["block", "q_block"]
    out_fields = T.StructType.fromDDL(schema).fields

    def reduce_pair(q, p):
        found = [pd.DataFrame({f.name: [] for f in out_fields})]
        for c, at in p.groupby("cell").indices.items():
            mine = q[(q["mask"].to_numpy() >> place[c]) & 1 == 1]
            for a in range(0, len(at), BLOCK_ROWS):
                points = p.iloc[at[a:a + BLOCK_ROWS]]
                found += [reducer(mine.iloc[b:b + BLOCK_ROWS], points) for b in range(0, len(mine), BLOCK_ROWS)]
                if best is not None and sum(map(len, found[1:])) > 4 * best * max(len(q), BLOCK_ROWS):
                    found = [found[0], _least(found, best)]
        return _least(found, best) if best is not None else pd.concat(found[1:]) if found[1:] else found[0]

    return routed.groupBy(*keys).cogroup(split.groupBy(*keys)).applyInPandas(reduce_pair, schema)


def _least(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """The k rows of the least (distance, id) of each query."""
    rows = pd.concat(found[1:]) if found[1:] else found[0]
    if rows.empty:
        return rows
    names, ids = rows["query_id"].to_numpy(), rows["id"].to_numpy()
    codes, known = pd.factorize(names, use_na_sentinel=False)
    at, ids, d = best_k(codes, ids, rows["distance"].to_numpy(), k)
    return pd.DataFrame({"query_id": known[at], "id": ids, "distance": d})


def _constants(values: np.ndarray):
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values] or [F.lit(1).cast("bigint")])


def _at_home(queries: DataFrame, centers: np.ndarray) -> np.ndarray:
    """How many queries have each center as their nearest."""
    def count(batches):
        n = np.zeros(len(centers), np.int64)
        for batch in batches:
            if len(batch) and len(centers):
                n += np.bincount(nearest_center(matrix(batch["embedding"]), centers)[0], minlength=len(centers))
        yield pd.DataFrame({"home": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(len(centers), np.int64)
    if len(centers):
        for r in queries.select("embedding").mapInPandas(count, "home bigint, n bigint").groupBy("home").agg(
                F.sum("n").alias("n")).collect():  # one row for each center
            out[r["home"]] = r["n"]
    return out


class _ProbeArgs:
    """The numpy part of ``Cells``, which is what tasks need."""

    def __init__(self, centers, size, radius):
        self.centers, self.size, self.radius = centers, size, radius


def _knn_blocks(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    # Copies of a point beyond the k smallest ids can never be an answer.
    copies = Window.partitionBy("embedding").orderBy("id")
    slim = points.select("id", "embedding").withColumn(
        "_rn", F.row_number().over(copies)).where(F.col("_rn") <= k).drop("_rn")
    reps, members = distinct_vectors(
        queries.select(F.col("query_id").alias("id"), "embedding"))
    unique = reps.select(F.col("rep").alias("query_id"), "embedding")

    def best(q, p):
        qids = q["query_id"].to_numpy()
        r, ids, d = nearest(matrix(q["embedding"]), qids, matrix(p["embedding"]),
                            p["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": qids[r], "id": ids, "distance": d})

    hits = pair_blocks(unique, Cells(slim), best, HIT_SCHEMA, k=k, best=k)
    return _of_members(top_k(hits, k), members)


def _of_members(answers: DataFrame, members: DataFrame) -> DataFrame:
    """The answers of a vector for each query that has it; few answers, maybe very many members."""
    grouped = answers.groupBy(F.col("query_id").alias("rep")).agg(
        F.collect_list(F.struct("id", "distance")).alias("_answers"))
    named = lookup_join(members.withColumnRenamed("id", "query_id"), materialize(grouped, "answers"),
                        ["rep"], "inner", salt_by=["query_id"])
    return named.select("query_id", F.explode("_answers").alias("a")).select("query_id", "a.id", "a.distance")


def knn_approx(queries: DataFrame, points: DataFrame, k: int, recall: float = 0.9,
               check_queries: int = 200) -> tuple[DataFrame, int]:
    """Approximate k nearest points from the nearest cells only, and how many cells that is.

    Every point is indexed. The number of cells is doubled until the answers to
    ``check_queries`` queries reach ``recall`` of the exact ones; a hot cell is
    split into chunks by hash and each chunk is cut to its best k.
    """
    cells = Cells(points.select("id", "embedding"))

    def best(q, p):
        qids = q["query_id"].to_numpy()
        r, ids, d = nearest(matrix(q["embedding"]), qids, matrix(p["embedding"]),
                            p["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": qids[r], "id": ids, "distance": d})

    some = materialize(queries.select("query_id", "embedding").orderBy(
        F.xxhash64("query_id"), "query_id").limit(check_queries), "check-queries")
    exact = materialize(top_k(_knn_scan(some, points, k), k).select("query_id", "id"), "exact")
    wanted, probes = exact.count(), 1
    while probes < len(cells.centers):
        found = top_k(pair_blocks(some, cells, best, HIT_SCHEMA, nearest_cells=probes, best=k), k)
        if found.join(exact, ["query_id", "id"]).count() >= recall * wanted:
            break
        probes *= 2
    hits = pair_blocks(queries.select("query_id", "embedding"), cells, best, HIT_SCHEMA,
                       nearest_cells=probes, best=k)
    return top_k(hits, k), probes
