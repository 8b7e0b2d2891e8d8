"""Latent text vectors: a randomised singular value decomposition of the TF-IDF matrix.

A pass over the documents multiplies a thin matrix, a row per vocabulary term,
by the transposed and the plain TF-IDF matrix, which is kept in small blocks of
documents with common terms; a task sums its blocks into one such thin matrix
and sends it in slices of terms. The driver keeps matrices of
vocabulary by block width only, whose size does not grow with the documents.

Passes build a block Krylov space from seeded random columns. Its Ritz pairs
come with exact residuals, and the passes go on until the wanted pairs are
accurate to ``tol``, the space holds everything, or ``max_passes`` is reached;
the model carries the residuals, so an early end is seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliplens.functions.text import sliced
from cliplens.operators.tfidf import (
    RETRIEVAL_TERMS, _flat, _in_rows, counted, document_weights, idf_of, vocabulary,
)
from cliplens.session import materialize, scratch_path

RANK = 64
EXTRA = 10  # columns of a block beyond the rank
SLICE = 256  # terms of one shuffled slice
FAN_IN = 64  # partial slices that one task adds up at first
MAX_TASKS = FAN_IN * FAN_IN
ENTRIES = 65_536  # matrix entries handled at a time inside a task
BLOCK_ENTRIES, BLOCK_DOCS = 16_384, 128  # of a block of the kept matrix, about and at most
POOL_ENTRIES = 1 << 20  # entries of the documents that are dealt to blocks together
PLACES = "array<struct<slot:int,weight:double>>"


def placed_weights(weights: DataFrame, doc: str, slots: dict[str, int]) -> DataFrame:
    """(doc, weights) with the number of each vocabulary term instead of its text."""
    shared = weights.sparkSession.sparkContext.broadcast(slots)

    def place(terms: pa.Array) -> pa.Array:
        flat, row = _flat(terms)
        coded = flat.field("term").dictionary_encode()
        number = np.array([shared.value[t] for t in coded.dictionary.to_pylist()], np.int32)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        items = pa.StructArray.from_arrays(
            [pa.array(number[codes] if len(codes) else np.empty(0, np.int32)), flat.field("weight")],
            names=["slot", "weight"])
        offsets = np.searchsorted(row, np.arange(len(terms) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), items)

    return _in_rows(weights.select(doc, "weights"), "weights", "places", PLACES, place)


def _pieces(places: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of whole documents with about ``ENTRIES`` entries: first and end row, row, slot, weight."""
    flat, row = _flat(places)
    slot = flat.field("slot").to_numpy(zero_copy_only=False)
    weight = flat.field("weight").to_numpy(zero_copy_only=False)
    ends = np.searchsorted(row, np.arange(len(places) + 1))
    first = 0
    while first < len(places):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + ENTRIES, "right")) - 1)
        a, b = ends[first], ends[end]
        yield first, end, row[a:b] - first, slot[a:b], weight[a:b]
        first = end


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by their key, which is in order."""
    out = np.zeros((n, values.shape[1]))
    if len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        out[keys[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents, terms, cells and weights of small matrices, documents by the terms that these have.

    Documents are dealt in the order of their heaviest term, so those of a block have
    terms in common and the matrix is dense enough for products of matrices.
    """
    flat, row = _flat(batch.column("places"))
    slot = flat.field("slot").to_numpy(zero_copy_only=False)
    weight = flat.field("weight").to_numpy(zero_copy_only=False)
    by_weight = np.lexsort((slot, -weight, row))
    filled, first = np.unique(row, return_index=True)
    docs = filled[np.argsort(slot[by_weight][first], kind="stable")]
    n = np.bincount(row, minlength=len(batch))
    starts = np.cumsum(n) - n
    sizes = np.maximum(n[docs], -(-BLOCK_ENTRIES // BLOCK_DOCS))  # short documents fill a block too
    for some in sliced(pa.array(docs), sizes, BLOCK_ENTRIES):
        mine = some.to_numpy(zero_copy_only=False)
        lengths = n[mine]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts[mine] - (ends - lengths), lengths)
        used, code = np.unique(slot[at], return_inverse=True)
        yield len(mine), used, np.repeat(np.arange(len(mine)), lengths) * len(used) + code, weight[at]


def blocked(places: DataFrame) -> DataFrame:
    """(docs, used, cells, weights): the document matrix in small blocks as bytes, which every pass reads."""
    kind = "docs int, used binary, cells binary, weights binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.fill_null(pc.list_value_length(whole.column("places")), 0).to_numpy(zero_copy_only=False)
            for batch in sliced(whole, lengths, POOL_ENTRIES):
                for docs, used, cells, weights in _blocks(batch):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([docs], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (
                            used.astype(np.int32), cells.astype(np.int64), weights.astype(np.float64)))],
                        names=["docs", "used", "cells", "weights"])

    return places.select("places").mapInArrow(cut, kind)


def _gram_times(matrix: DataFrame, block: np.ndarray) -> np.ndarray:
    """The transposed document matrix, in blocks, times itself times ``block``, in one pass."""
    spark = matrix.sparkSession
    shared = spark.sparkContext.broadcast(block)
    terms, width = block.shape

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = shared.value, np.zeros((terms, width))
        used = False
        for batch in batches:
            for docs, mine, cells, weights in zip(*(batch.column(c) for c in ("docs", "used", "cells", "weights"))):
                slots = np.frombuffer(mine.as_buffer(), np.int32)
                some = np.zeros((docs.as_py(), len(slots)))
                some.ravel()[np.frombuffer(cells.as_buffer(), np.int64)] = np.frombuffer(weights.as_buffer())
                total[slots] += some.T @ (some @ q[slots])
                used = True
        if used:
            starts = range(0, terms, SLICE)
            yield pa.RecordBatch.from_arrays([
                pa.array([s // SLICE for s in starts], pa.int32()),
                pa.array([total[s:s + SLICE].tobytes() for s in starts], pa.binary())], names=["part", "sums"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["sums"].iloc[0]) // 8)
        for sums in rows["sums"]:
            total += np.frombuffer(sums)
        return pd.DataFrame({"part": [key[0]], "sums": [total.tobytes()]})

    kind = "part int, sums binary"
    made = matrix.mapInArrow(sweep, kind).withColumn("turn", F.spark_partition_id() % FAN_IN)
    some = made.groupBy("part", "turn").applyInPandas(add, kind)
    parts = some.groupBy("part").applyInPandas(add, kind).collect()
    out = np.zeros((terms, width))
    for p in parts:
        rows = np.frombuffer(p["sums"]).reshape(-1, width)
        out[p["part"] * SLICE:p["part"] * SLICE + len(rows)] = rows
    shared.unpersist()
    return out


def _fresh(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Orthonormal columns for what ``block`` adds to the orthonormal ``basis``."""
    scale = np.linalg.norm(block)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10 * max(scale, 1e-300)]
    return np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.shape[1] else u


def decompose(matrix: DataFrame, terms: int, rank: int = RANK, seed: int = 42, tol: float = 1e-6,
              max_passes: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading right singular vectors (terms by rank), singular values and residuals.

    A residual is the length of what the Gram matrix leaves of a vector beside
    its squared singular value, as a share of the largest such value. Fewer
    than ``rank`` columns come back where the matrix has no more. The entry of
    largest size in a vector is positive.
    """
    width = min(terms, rank + EXTRA)
    start = np.random.default_rng(seed).standard_normal((terms, width))
    basis, images = np.empty((terms, 0)), np.empty((terms, 0))
    block = np.linalg.qr(start)[0]
    for _ in range(max_passes):
        image = _gram_times(matrix, block)
        basis, images = np.hstack([basis, block]), np.hstack([images, image])
        gram = basis.T @ images
        values, turns = np.linalg.eigh((gram + gram.T) / 2)
        best = np.argsort(-values, kind="stable")[:rank]
        values, turns = values[best], turns[:, best]
        vectors = basis @ turns
        top = max(values[0], 1e-300)
        residuals = np.linalg.norm(images @ turns - vectors * values, axis=0) / top
        if residuals.max() <= tol or basis.shape[1] >= terms:
            break
        block = _fresh(image, basis)[:, :terms - basis.shape[1]]
        if not block.shape[1]:
            break
    real = values > 1e-12 * top
    vectors, values, residuals = vectors[:, real], values[real], residuals[real]
    if vectors.size:
        signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
        vectors = vectors * signs
    return vectors, np.sqrt(values), residuals


class LatentModel:
    """A fitted vocabulary with the latent place of each term, kept as tables at ``path``.

    ``terms`` has (slot, term, idf, place), ``axes`` has (axis, value, residual).
    Both are bounded by the vocabulary, so an opened model fits every task.
    """

    def __init__(self, path: str, terms: list[str], idf: list[float], places: np.ndarray,
                 values: np.ndarray, residuals: np.ndarray):
        self.path, self.terms, self.places = path, terms, places
        self.idf = dict(zip(terms, idf))
        self.slots = {t: i for i, t in enumerate(terms)}
        self.values, self.residuals = values, residuals

    @classmethod
    def fit(cls, counts: DataFrame, doc: str, rank: int = RANK, max_terms: int = RETRIEVAL_TERMS,
            path: str | None = None, **how) -> LatentModel:
        """Fit on all of ``counts`` (doc, terms) as ``counted`` gives them, and save."""
        spark = counts.sparkSession
        idf = idf_of(vocabulary(counts, max_terms))
        terms = sorted(idf)
        vectors, values, residuals = np.empty((0, 0)), np.empty(0), np.empty(0)
        if terms:
            slots = {t: i for i, t in enumerate(terms)}
            places = placed_weights(document_weights(counts, doc, idf), doc, slots)
            matrix = materialize(blocked(places), "blocks")
            # One sum per task is shuffled, so the tasks follow the cores, not the documents.
            tasks = min(MAX_TASKS, 4 * spark.sparkContext.defaultParallelism)
            vectors, values, residuals = decompose(matrix.coalesce(tasks), len(terms), rank, **how)
        path = path or scratch_path(spark, "latent")
        spark.createDataFrame(
            [(i, t, idf[t], vectors[i].tolist()) for i, t in enumerate(terms)],
            "slot int, term string, idf double, place array<double>").write.parquet(f"{path}/terms")
        spark.createDataFrame(
            [(i, float(v), float(r)) for i, (v, r) in enumerate(zip(values, residuals))],
            "axis int, value double, residual double").write.parquet(f"{path}/axes")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LatentModel:
        rows = spark.read.parquet(f"{path}/terms").orderBy("slot").collect()
        axes = spark.read.parquet(f"{path}/axes").orderBy("axis").collect()
        places = np.array([r["place"] for r in rows]).reshape(len(rows), -1) if rows else np.empty((0, 0))
        return cls(path, [r["term"] for r in rows], [r["idf"] for r in rows], places,
                   np.array([a["value"] for a in axes]), np.array([a["residual"] for a in axes]))

    def vectors(self, counts: DataFrame, doc: str) -> DataFrame:
        """(doc, embedding): each document's unit place; one without a known term has the zero vector."""
        shared = counts.sparkSession.sparkContext.broadcast(self.places)
        dim = self.places.shape[1]

        def project(places: pa.Array) -> pa.Array:
            out = np.zeros((len(places), dim))
            for first, end, row, slot, weight in _pieces(places):
                out[first:end] = _sums(row, shared.value[slot] * weight[:, None], end - first)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            unit = np.divide(out, length, out=np.zeros_like(out), where=length > 1e-12)
            return pa.ListArray.from_arrays(
                pa.array(np.arange(len(places) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))

        placed = placed_weights(document_weights(counts, doc, self.idf), doc, self.slots)
        return _in_rows(placed, "places", "embedding", "array<double>", project)


def latent_vectors(docs: DataFrame, doc: str, tokens: Column, rank: int = RANK, **how) -> DataFrame:
    """(doc, embedding) of each text by a model fitted on all of them."""
    counts = counted(docs, [doc], tokens)
    return LatentModel.fit(counts, doc, rank, **how).vectors(counts, doc)
