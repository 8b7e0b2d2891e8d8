"""TF-IDF weights, keyword extraction and hashed text vectors.

A document is one row, so its terms are counted, weighted, normalised and
hashed inside the row, in Arrow batches. Texts are never shuffled; what is
shuffled are counts per term, added up before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cliplens.functions.text import sliced
from cliplens.operators.joins import MAX_BROADCAST_BYTES, lookup_join
from cliplens.session import materialize, spread

RETRIEVAL_TERMS = 10_000
MODEL_TERMS = 1_000
PART_ITEMS = 1 << 17  # what is changed at a time of a batch's lists
WEIGHTS = "array<struct<term:string,weight:double>>"


TERMS = "array<struct<term:string,tf:bigint>>"


def _in_rows(df: DataFrame, column: str, out: str, kind: str, change) -> DataFrame:
    """``df`` with the list column ``column`` replaced by ``out``: ``change`` maps a bounded part of a batch."""
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, *T.StructType.fromDDL(f"{out} {kind}").fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _item_parts(whole, column):
                made = change(batch.column(column)).cast(arrow.field(out).type)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), made], schema=arrow)

    return df.select(*[f.name for f in kept], column).mapInArrow(run, schema)


def _item_parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices with about ``PART_ITEMS`` items in the lists of a column; a longer list is one by itself."""
    lengths = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    yield from sliced(batch, lengths, PART_ITEMS)


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists end to end, and the row of each; a NULL list has none."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), lengths)


def _listed(rows: np.ndarray, n: int, **fields) -> pa.Array:
    """Lists of structs for ``n`` rows from items that are in order of their row."""
    offsets = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
    items = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets), items)


def _count_terms(tokens: pa.Array) -> pa.Array:
    flat, row = _flat(tokens)
    coded = flat.dictionary_encode()
    size = max(1, len(coded.dictionary))
    keys, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return _listed(keys // size, len(tokens), term=coded.dictionary.take(pa.array(keys % size)), tf=n)


def counted_rows(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, terms): one row per document with its distinct terms and their counts."""
    return _in_rows(docs.select(*keys, tokens.alias("tokens")), "tokens", "terms", TERMS, _count_terms)


def counted(docs: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """Like ``counted_rows`` over all cores, written once."""
    return materialize(counted_rows(spread(docs), keys, tokens), "terms", compression="zstd")


def vocabulary(rows: DataFrame, max_terms: int) -> DataFrame:
    """The ``max_terms`` commonest terms with document frequency and smooth idf."""
    n_docs = rows.count()
    counts = rows.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(
        F.count("*").alias("df"), F.sum("t.tf").alias("total"))
    return (
        counts.orderBy(F.col("total").desc(), "term").limit(max_terms)
        .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1)
    )


def idf_of(vocab: DataFrame) -> dict[str, float]:
    """The vocabulary as a dict; its size is bounded by ``max_terms``."""
    return {r["term"]: r["idf"] for r in vocab.select("term", "idf").collect()}


def document_weights(rows: DataFrame, doc: str, idf: dict[str, float]) -> DataFrame:
    """(doc, weights): unit length per document, over the vocabulary only."""
    shared = rows.sparkSession.sparkContext.broadcast(idf)

    def weigh(terms: pa.Array) -> pa.Array:
        known = shared.value
        flat, row = _flat(terms)
        coded = flat.field("term").dictionary_encode()
        idf_of_code = np.array([known.get(t, 0.0) for t in coded.dictionary.to_pylist()])
        codes = coded.indices.to_numpy(zero_copy_only=False)
        w = flat.field("tf").to_numpy() * idf_of_code[codes] if len(codes) else np.empty(0)
        use = w > 0
        row, codes, w = row[use], codes[use], w[use]
        length = np.sqrt(np.bincount(row, w * w, len(terms)))
        return _listed(row, len(terms), term=coded.dictionary.take(pa.array(codes)), weight=w / length[row])

    return _in_rows(rows.select(doc, "terms"), "terms", "weights", WEIGHTS, weigh)


def tfidf_weights(docs: DataFrame, doc: str, tokens: Column,
                  max_terms: int = RETRIEVAL_TERMS) -> DataFrame:
    """(doc, term, weight) rows."""
    rows = counted(docs, [doc], tokens)
    weights = document_weights(rows, doc, idf_of(vocabulary(rows, max_terms)))
    return weights.select(doc, F.explode("weights").alias("w")).select(doc, "w.term", "w.weight")


def keyword_counts(docs: DataFrame, words: Column) -> DataFrame:
    return docs.select(F.explode(words).alias("term")).groupBy("term").agg(
        F.count("*").alias("n"))


def topic_keywords(docs: DataFrame, words: Column, tokens: Column, top_k: int = 8,
                   cluster: str = "cluster_id", doc: str = "video_id") -> DataFrame:
    """(cluster, rank, term, score): the terms of highest mean weight per cluster.

    A cluster of fewer than three documents, or one where no term is left after
    pruning, falls back to plain counts of its words.
    """
    docs = docs.where(F.col(cluster).isNotNull())
    rows = counted(docs, [cluster, doc], tokens)
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n_docs"))
    # Tables with a few rows per cluster are broadcast if the clusters are few enough.
    few = sizes.count() * 2 * top_k * 256 <= MAX_BROADCAST_BYTES
    stats = rows.select(cluster, F.explode("terms").alias("t")).groupBy(
        cluster, F.col("t.term").alias("term")).agg(
        F.count("*").alias("df"), F.sum("t.tf").alias("total"))
    kept = lookup_join(stats, sizes, [cluster], "inner", few, salt_by=["term"]).where(
        (F.col("df") >= 2) & (F.col("df") <= 0.95 * F.col("n_docs"))
    )
    by_total = Window.partitionBy(cluster).orderBy(F.col("total").desc(), "term")
    vocab = (
        kept.withColumn("_rn", F.row_number().over(by_total)).where(F.col("_rn") <= 2 * top_k)
        .groupBy(cluster).agg(F.max("n_docs").alias("n_docs"), F.collect_list(F.struct(
            "term", (F.log((F.lit(1.0) + F.col("n_docs")) / (F.lit(1.0) + F.col("df"))) + 1)
            .alias("idf"))).alias("vocab"))
    )
    vocab = materialize(vocab, "cluster-terms")
    # A document meets its cluster's few terms in its own row.
    known = F.map_from_entries("terms")
    raw = F.filter(F.transform("vocab", lambda v: F.struct(
        v["term"].alias("term"),
        (F.coalesce(F.try_element_at(known, v["term"]), F.lit(0)) * v["idf"]).alias("w"))),
        lambda v: v["w"] > 0)
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda s, v: s + v["w"] * v["w"]))
    scored = (
        lookup_join(rows, vocab, [cluster], "inner", few, salt_by=[doc])
        .select(cluster, "n_docs", raw.alias("raw"))
        .select(cluster, "n_docs", length.alias("length"), F.explode("raw").alias("t"))
        .groupBy(cluster, "t.term").agg(
            (F.sum(F.col("t.w") / F.col("length")) / F.max("n_docs")).alias("score"))
    )
    bare = sizes.select(cluster).join(vocab.select(cluster), cluster, "left_anti")
    plain = (
        lookup_join(docs, bare, [cluster], "left_semi", few, salt_by=[doc])
        .select(cluster, F.explode(words).alias("term"))
        .groupBy(cluster, "term").agg(F.count("*").cast("double").alias("score"))
    )
    both = scored.unionByName(plain)
    by_score = Window.partitionBy(cluster).orderBy(F.round("score", 8).desc(), "term")
    return (
        both.withColumn("rank", F.row_number().over(by_score).cast("bigint"))
        .where(F.col("rank") <= top_k).select(cluster, "rank", "term", "score")
    )


def vectors_of_terms(rows: DataFrame, doc: str, dim: int = 64) -> DataFrame:
    """(doc, embedding) from counted terms: signed hashing to ``dim`` slots, unit length."""
    def embed(terms: pa.Array) -> pa.Array:
        flat, row = _flat(terms)
        coded = flat.field("term").dictionary_encode()
        hashes = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                           for t in coded.dictionary.to_pylist()], np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        mine = hashes[codes] if len(codes) else np.empty(0, np.int64)
        signed = np.where(mine // dim % 2 == 0, 1, -1) * flat.field("tf").to_numpy()
        slots = np.bincount(row * dim + mine % dim, signed, len(terms) * dim).reshape(-1, dim)
        length = np.sqrt((slots * slots).sum(1, keepdims=True))
        unit = np.divide(slots, length, out=np.zeros_like(slots), where=length > 0)
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(terms) + 1, dtype=np.int32) * dim), pa.array(unit.ravel()))

    return _in_rows(rows.select(doc, "terms"), "terms", "embedding", "array<double>", embed)


def hashed_vectors(docs: DataFrame, doc: str, tokens: Column, dim: int = 64) -> DataFrame:
    """(doc, embedding) of each text; one without tokens gets the zero vector."""
    return vectors_of_terms(counted(docs, [doc], tokens), doc, dim)
