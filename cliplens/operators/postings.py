"""A persisted posting table with block maxima, and block-max search over it.

Documents are dealt to shards by a hash of their id and numbered inside. A row
of the table is one term in one shard: its documents and weights in order, cut
into blocks by ranges of documents, with the greatest weight of each block. A
query adds up the maxima of its terms to a bound for each range and opens the
ranges in falling order of their bounds, more and more at a time, until no bound
reaches what the k-th best has; the blocks left are never scored. Queries are
joined to the postings by their terms and pass in bounded groups; none goes
through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplens.operators.joins import lookup_join
from cliplens.session import materialize, scratch_path

SHARD_DOCS, RANGE_DOCS, QUERY_GROUP = 8192, 64, 64
FIRST_RANGES = 4
SLACK = 2e-8  # results are ranked by scores of 8 digits
_KINDS = {"ranges": np.int32, "ends": np.int32, "most": np.float64, "docs": np.int32, "weights": np.float64}
_POSTINGS = "shard bigint, term string, ids array<bigint>, " + ", ".join(f"{c} binary" for c in _KINDS)
_FOUND = "variant_id bigint, video_id bigint, score double, opened bigint, blocks bigint"


def _invert(range_docs: int):
    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (shard, video_id, weights), those of a shard side by side -> its posting rows."""
        key, held = None, []

        def made():
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = rows.column("weights").combine_chunks()
            flat = lists.flatten()
            coded = flat.field("term").dictionary_encode()
            term = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((doc, term))
            term, doc, weight = term[order], doc[order], flat.field("weight").to_numpy()[order]
            block = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(doc // range_docs) != 0)][:len(term)])
            most = np.maximum.reduceat(weight, block) if len(block) else weight
            ends = np.r_[block[1:], len(term)][:len(block)]
            first = np.flatnonzero(np.r_[True, np.diff(term) != 0][:len(term)])  # of each term, in postings
            of_block = np.searchsorted(block, np.r_[first, len(term)])
            # The row without a term has the ids of the shard's documents.
            out = [[key, None, rows.column("video_id").to_pylist(), *[b""] * 5]]
            names = coded.dictionary.to_pylist()
            for lo, hi, a, b in zip(first, np.r_[first[1:], len(term)], of_block, of_block[1:]):
                values = (doc[block[a:b]] // range_docs, ends[a:b] - lo, most[a:b], doc[lo:hi], weight[lo:hi])
                out.append([key, names[term[lo]], None,
                            *[v.astype(kind).tobytes() for v, kind in zip(values, _KINDS.values())]])
            kinds = [pa.int64(), pa.string(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["shard", "term", "ids", *_KINDS])

        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)].tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if int(shards[lo]) != key:
                        if held:
                            yield made()
                        key, held = int(shards[lo]), []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield made()

    return invert


def _search(k: int, min_score: float, range_docs: int):
    def search(cells: pa.Table, asked: pa.Table) -> pa.Table:
        lists, ids = {}, []
        for row in cells.to_pylist():
            if row["term"] is None:
                ids = row["ids"]
            else:
                lists[row["term"]] = [np.frombuffer(row[c], kind) for c, kind in _KINDS.items()]
        out: list[list] = [[] for _ in range(5)]
        n_ranges = -(-len(ids) // range_docs)
        for variant, weights in zip(asked.column("variant_id").to_pylist(), asked.column("weights").to_pylist()):
            mine = [(w["weight"], *lists[w["term"]]) for w in weights if w["term"] in lists]
            found, scores, opened, blocks = _best(mine, len(ids), n_ranges, k, min_score)
            for column, values in zip(out, (
                    [variant] * (len(found) + 1), [*[ids[i] for i in found.tolist()], None],
                    [*scores.tolist(), None], [*[None] * len(found), opened], [*[None] * len(found), blocks])):
                column += values
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, kind) for c, kind in zip(out, kinds)],
                        names=["variant_id", "video_id", "score", "opened", "blocks"])

    return search


def _best(mine: list[tuple], n_docs: int, n_ranges: int, k: int, min_score: float):
    """(documents, scores, blocks opened, blocks): at least the k best of one shard for one query."""
    bound, scores = np.zeros(n_ranges), np.zeros(n_docs)
    for weight, ranges, _, most, _, _ in mine:
        bound[ranges] += weight * most
    order = np.argsort(-bound, kind="stable")
    least, at, step, opened = min_score - SLACK, 0, FIRST_RANGES, 0
    while at < len(order):
        chunk = order[at:at + step]
        chunk = chunk[(bound[chunk] >= least) & (bound[chunk] > 0)]
        if not len(chunk):
            break
        visit = np.zeros(n_ranges, bool)
        visit[chunk] = True
        for weight, ranges, ends, _, docs, weights in mine:
            here = np.flatnonzero(visit[ranges])
            lo = np.r_[0, ends[:-1]][here]
            size = ends[here] - lo
            spot = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
            scores[docs[spot]] += weight * weights[spot]
            opened += len(here)
        if n_docs > k:
            least = max(least, np.partition(scores, n_docs - k)[n_docs - k] - SLACK)
        at, step = at + step, 2 * step
    found = np.flatnonzero((scores >= min_score) & (scores >= least))
    return found, scores[found], opened, sum(len(m[1]) for m in mine)


@dataclass
class PostingIndex:
    """The posting table at ``path``; opening it reads nothing but its size."""

    spark: SparkSession
    path: str
    shards: int

    @classmethod
    def write(cls, weighted: DataFrame, path: str | None = None) -> PostingIndex:
        """Index rows (video_id, weights), the weights being positive, one for each term of a row.

        Ids are not NULL. Rows without weights are in no posting; without rows
        the index is empty.
        """
        spark = weighted.sparkSession
        path = path or scratch_path(spark, "postings")
        weighted = materialize(weighted, "weighted")
        shards = max(1, -(-weighted.count() // SHARD_DOCS))
        dealt = weighted.select(F.pmod(F.xxhash64("video_id"), F.lit(shards)).alias("shard"), "video_id", "weights")
        dealt.repartition("shard").sortWithinPartitions("shard", "video_id").mapInArrow(
            _invert(RANGE_DOCS), _POSTINGS).sortWithinPartitions("term").write.parquet(path)
        return cls(spark, path, shards)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PostingIndex:
        most = spark.read.parquet(path).where("term IS NULL").agg(F.max("shard").alias("s")).first()["s"]
        return cls(spark, path, (most or 0) + 1)

    def table(self) -> DataFrame:
        return self.spark.read.schema(_POSTINGS).parquet(self.path)

    def lists(self) -> DataFrame:
        """(term, n_docs, most): how many documents each term has and its greatest weight."""
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                most = [np.frombuffer(m, np.float64).max() for m in batch.column(2).to_pylist()]
                sizes = [len(d) // 4 for d in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(most, pa.float64())],
                    names=["term", "n_docs", "most"])

        return self.table().where("term IS NOT NULL").select("term", "docs", "most").mapInArrow(
            read, "term string, n_docs bigint, most double").groupBy("term").agg(
            F.sum("n_docs").alias("n_docs"), F.max("most").alias("most"))

    def visits(self, asked: DataFrame, k: int, min_score: float) -> DataFrame:
        """Hits of each shard, and for each query and shard a row of the blocks opened and of all.

        ``asked`` has (variant_id, weights). Rows without ``video_id`` are the counts.
        """
        groups = max(1, -(-asked.count() // QUERY_GROUP))
        asked = asked.withColumn("grp", F.pmod(F.xxhash64("variant_id"), F.lit(groups)))
        wanted = asked.select("grp", F.explode("weights.term").alias("term")).groupBy("term").agg(
            F.collect_set("grp").alias("groups"))
        every = F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))
        postings = self.table()
        ids = postings.where("term IS NULL").withColumn("groups", every)
        cells = lookup_join(postings.where("term IS NOT NULL"), materialize(wanted, "wanted"), ["term"],
                            "inner", salt_by=["shard"])
        cells = cells.unionByName(ids).withColumn("grp", F.explode("groups")).drop("groups")
        shards = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.shards - 1).cast("bigint")))
        queries = asked.select("grp", "variant_id", "weights", shards.alias("shard"))
        return cells.groupBy("shard", "grp").cogroup(queries.groupBy("shard", "grp")).applyInArrow(
            _search(k, min_score, RANGE_DOCS), _FOUND)

    def search(self, asked: DataFrame, k: int, min_score: float) -> DataFrame:
        """(variant_id, video_id, score): the k best of each query with at least ``min_score``.

        The same as scoring every document. Ranked by the score of 8 digits,
        equal ones by id.
        """
        order = Window.partitionBy("variant_id").orderBy(F.round("score", 8).desc(), "video_id")
        return self.visits(asked, k, min_score).where("video_id IS NOT NULL").withColumn(
            "_rn", F.row_number().over(order)).where(F.col("_rn") <= k).select("variant_id", "video_id", "score")
