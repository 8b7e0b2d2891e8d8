"""Exact top-k by inner product with MaxScore bounds.

Components are the terms of a query, the coordinates of the candidates their
postings. In a shard of candidates the largest possible contribution of each
term is known; terms are taken in order of that bound, and those whose bounds
together cannot lift a candidate past the k-th score known so far are
non-essential. The essential postings are traversed for all candidates of the
shard at once; the others are probed only for candidates that can still
compete. Shards keep their best k and are merged at the end.

Queries go to the shards in blocks of bounded size, one pass over the
candidates for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20
PROBE_ROWS = 4096
SHARD_ROWS = 4096
QUERY_ROWS = 128
PROBE_TERMS = 4
_NONE = np.iinfo(np.int64).min


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, vector): floor(scale * x) of each component; rows that can't take part go.

    NULL vectors and those with a NULL, NaN or infinite component take no part.
    """
    whole = F.col(vector_col).isNotNull() & F.forall(
        vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def _matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of equal width; missing components are 0."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v[:width]
    return out


def _number_type(q: np.ndarray, c: np.ndarray):
    """The fastest type in which every sum of products is exact."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    return np.float32 if top < 1 << 24 else np.float64 if top < 1 << 53 else np.int64


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Block:
    """A block of queries, with the k-th score known of each at the start."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.vectors, self.floor, self.k = ids, vectors, floor, k


def search_shard(block: Block, ids: np.ndarray, shard: np.ndarray, floors: np.ndarray, best: list) -> None:
    """Take the shard's candidates into ``best`` and raise ``floors``, the k-th scores."""
    kind = _number_type(block.vectors, shard)
    c = shard.astype(kind)
    top, low = c.max(0), c.min(0)
    for at in range(0, len(block.ids), QUERY_ROWS):
        rows = np.arange(at, min(at + QUERY_ROWS, len(block.ids)))
        q = block.vectors[rows].astype(kind)
        bounds = np.maximum(q * top, q * low)  # of each term, over this shard
        # One order of the terms for these queries: the weakest bounds last.
        order = np.argsort(-bounds.mean(0), kind="stable")
        rest = np.cumsum(bounds[:, order][:, ::-1], axis=1)[:, ::-1]
        rest = np.concatenate([rest, np.zeros((len(rows), 1), rest.dtype)], axis=1)
        floor = floors[rows]
        # Essential terms: without them no candidate reaches a floor.
        essential = int(np.argmin((rest > floor[:, None]).any(0))) if (
            ~(rest > floor[:, None]).any(0)).any() else len(order)
        # Vectors with values in every component have few terms to spare; an eighth of
        # them, the weakest, is probed step by step for the candidates left.
        essential = min(essential, len(order) * 7 // 8)
        first, others = order[:essential], order[essential:]
        partial = q[:, first] @ c[:, first].T
        open_q, open_c = np.nonzero(partial + rest[:, essential][:, None] >= floor[:, None])
        if not len(open_q):
            continue
        scores = partial[open_q, open_c].astype(np.int64)
        for step in range(0, len(others), PROBE_TERMS):  # probe while competitive
            terms = others[step:step + PROBE_TERMS]
            scores += (q[open_q[:, None], terms] * c[open_c[:, None], terms]).sum(1).astype(np.int64)
            live = scores + rest[open_q, min(essential + step + PROBE_TERMS, len(order))] >= floor[open_q]
            open_q, open_c, scores = open_q[live], open_c[live], scores[live]
        keep = (scores >= floor[open_q]) & (block.ids[rows][open_q] != ids[open_c])
        open_q, open_c, scores = open_q[keep], open_c[keep], scores[keep]
        ends = np.searchsorted(open_q, np.arange(len(rows) + 1))
        for i in np.flatnonzero(np.diff(ends)).tolist():
            mine = slice(ends[i], ends[i + 1])
            old = best[at + i]
            best[at + i] = found = _best(
                np.concatenate([old[0], ids[open_c[mine]]]),
                np.concatenate([old[1], scores[mine]]), block.k)
            if len(found[0]) == block.k:
                floors[at + i] = max(floors[at + i], found[1][-1])


def _search_udf(shared):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        floors = block.floor.copy()
        empty = (np.empty(0, np.int64), np.empty(0, np.int64))
        best = [empty] * len(block.ids)
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD_ROWS):
                part = batch.slice(at, SHARD_ROWS)
                width = block.vectors.shape[1]
                shard = _matrix(part.column(1).to_pylist(), width)
                search_shard(block, part.column(0).to_numpy(zero_copy_only=False), shard, floors, best)
        sizes = [len(b[0]) for b in best]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(block.ids, sizes)),
             pa.array(np.concatenate([b[0] for b in best] or [empty[0]])),
             pa.array(np.concatenate([b[1] for b in best] or [empty[0]]))],
            names=["query_id", "id", "score"])

    return search


def _first_floors(ids: np.ndarray, queries: np.ndarray, probe_ids: np.ndarray,
                  probe: np.ndarray, k: int) -> np.ndarray:
    """The k-th score among a few candidates: the k-th of all is never below it."""
    floors = np.full(len(ids), _NONE)
    if len(probe) <= k:
        return floors
    kind = _number_type(queries, probe)
    p = probe.astype(kind).T
    for at in range(0, len(ids), 256):
        scores = (queries[at:at + 256].astype(kind) @ p).astype(np.int64)
        scores[ids[at:at + 256, None] == probe_ids[None, :]] = _NONE
        floors[at:at + 256] = np.partition(scores, -k, axis=1)[:, -k]
    return floors


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 20,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query.

    Both tables have (id bigint, vector array<bigint>) from ``integer_vectors``.
    A candidate with the query's own id is left out; ties go to the smaller id.
    Fewer candidates than k give them all.

    Of queries with one id the one of the smallest vector is asked; candidates
    that repeat an id are candidates each. Vectors of different lengths are
    filled up with zeros, which leaves inner products as they are. NULL ids take
    no part. Empty queries or candidates give no rows. The 4,096 candidates that
    give the first bounds change the speed and never the result.
    """
    spark = candidates.sparkSession
    asked = queries.where("id IS NOT NULL").groupBy("id").agg(F.min("vector").alias("vector"))
    given = candidates.where("id IS NOT NULL").select("id", "vector")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("w")).first()
    width = size["w"] or 0
    blocks = max(1, -(-size["n"] * (width + 1) * 8 // block_bytes))
    probe = given.limit(PROBE_ROWS).toArrow()
    probe_ids = probe.column("id").to_numpy()
    probe_rows = _matrix(probe.column("vector").to_pylist(), width)
    found = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").toArrow()
        ids, vectors = rows.column("id").to_numpy(), _matrix(rows.column("vector").to_pylist(), width)
        shared = spark.sparkContext.broadcast(
            Block(ids, vectors, _first_floors(ids, vectors, probe_ids, probe_rows, k), k))
        part = given.mapInArrow(_search_udf(shared), "query_id bigint, id bigint, score bigint")
        found = part if found is None else found.unionByName(part)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")
