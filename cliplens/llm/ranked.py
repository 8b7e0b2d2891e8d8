"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners. A bundle is a group of items with sparse accumulators
for the documents of one shard; it visits the owners one after another, and
each stage is a cogroup of the bundles with that owner's postings, which adds
whole-number contributions. Owners hold terms by how rare they are, and the
owner of the most frequent ones, which touch nearly every document, comes last,
where the best are picked in the same task. A bundle leaves a document behind
once what it has and the bounds of the owners to come are less than the k-th
best of the shard has already: such a document can be in no answer. Postings and
accumulators are cut by shards of a bounded number of documents, so a term that
every document holds is no hot key. The best k of the shards are merged in a
tree of bounded groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cliplens.llm import packed
from cliplens.operators.joins import lookup_join
from cliplens.operators.ranking import numbered
from cliplens.session import materialize, spread

SHARD_DOCS = 2048
GROUP_ITEMS = 256
VOCABULARY = 1 << 18
MERGE = 64
LONG_TERM = 64
OWNERS = [256, 32, 4]  # shares of all documents: rarer than the first, ..., more frequent than the last
_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FORWARD = "block bigint, spot bigint, n bigint, terms binary, tfs binary"
_QUERY = ["q_item", "q_term", "q_weight", "q_bound", "q_owner"]
_KINDS = {"q_item": np.int32, "q_term": np.int64, "q_weight": np.int64, "q_bound": np.int64,
          "q_owner": np.int32, "a_item": np.int32, "a_doc": np.uint16, "a_score": np.int64}
_CELL = "shard bigint, stage bigint, terms binary, ends binary, docs binary, gains binary, ids array<{}>"
_BEST = "part bigint, grp bigint, items array<int>, docs array<{}>, scores array<bigint>"


def _key(term: bytes) -> bytes:
    """The term, or a digest that no term can be if it is long."""
    return term if len(term) <= LONG_TERM else b"\0" + hashlib.sha256(term).digest()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term): the different terms of each item id, NULL included; long terms by digest."""
    words = F.regexp_extract_all(F.translate(F.col(text_col), _AZ, _AZ.lower()), F.lit(_TERM), F.lit(0))
    term = F.encode("word", "utf-8")
    long = F.concat(F.lit(b"\0"), F.unhex(F.sha2(term, 256)))
    return items.select(F.col(id_col).alias("item"), F.explode(words).alias("word")).select(
        "item", F.when(F.octet_length("word") > LONG_TERM, long).otherwise(term).alias("term")).distinct()


def _forward(shared, block: int, first: int):
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, size = shared.value, max(1, len(shared.value))
        spot = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = packed.text_bytes(batch.column(1))
            counts, terms, tfs = [], [], []
            for lo, hi in packed.chunks(offsets):
                part = packed.ascii_lower(data[offsets[lo]:offsets[hi]])
                begin = offsets[lo:hi + 1] - offsets[lo]
                starts, ends = packed.cut_runs(_WORD[part], begin)
                of = packed.owners(starts, begin)
                counts.append(np.bincount(of, minlength=hi - lo))
                one, back = packed.distinct_runs(part, starts, ends)
                known = np.array([place.get(_key(part[a:b].tobytes()), -1)
                                  for a, b in zip(starts[one].tolist(), ends[one].tolist())], np.int64)
                term = known[back]
                hit = np.flatnonzero(term >= 0)
                pairs, tf = np.unique(of[hit] * size + term[hit], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(1, hi - lo) * size)
                terms += [t.tobytes() for t in np.split(pairs % size + first, cuts)]
                tfs += [t.tobytes() for t in np.split(tf.astype(np.int32), cuts)]
            n = np.concatenate(counts) if counts else np.empty(0, np.int64)
            full = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), block)), pa.array(np.arange(len(n)) + spot),
                 pa.array(n), pa.array(terms, pa.binary()), pa.array(tfs, pa.binary())],
                names=["doc", "block", "spot", "n", "terms", "tfs"])
            spot += len(n)
            yield full.filter(pa.array(n > 0))

    return forward


class Gain:
    """What one document adds to a score for a term, before the term's weight."""

    def __init__(self, docs: int, words: int):
        self.docs, self.words = docs, words

    def __call__(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + 50 * n * self.docs // self.words
        return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _flat(terms: list[bytes], tfs: list[bytes]):
    sizes = np.array([len(t) // 8 for t in terms], np.int64)
    return (np.frombuffer(b"".join(terms), np.int64),
            np.frombuffer(b"".join(tfs), np.int32).astype(np.int64), sizes)


def _statistics(gain: Gain):
    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, most = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64)
        block = None

        def found():
            at = np.flatnonzero(df)
            return pa.RecordBatch.from_arrays(
                [pa.array(at + (block or 0) * VOCABULARY), pa.array(df[at]), pa.array(most[at])],
                names=["id", "df", "most"])

        for batch in batches:
            blocks, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            terms, tfs = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)].tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if block is not None and blocks[lo] != block:
                        yield found()
                        df[:], most[:] = 0, 0
                    block = int(blocks[lo])
                    term, tf, sizes = _flat(terms[lo:hi], tfs[lo:hi])
                    at = term - block * VOCABULARY
                    df += np.bincount(at, minlength=VOCABULARY)
                    np.maximum.at(most, at, gain(tf, np.repeat(n[lo:hi], sizes)))
        yield found()

    return statistics


def _cells(shared, gain: Gain, block: int, blocks: int, doc_type: pa.DataType):
    """Postings of one shard for each owner, out of its documents, which lie side by side."""
    schema = pa.schema([("shard", pa.int64()), ("stage", pa.int64()), ("terms", pa.binary()),
                        ("ends", pa.binary()), ("docs", pa.binary()), ("gains", pa.binary()),
                        ("ids", pa.list_(doc_type))])
    stages = range(block, (len(OWNERS) + 1) * blocks, blocks)
    final = (len(OWNERS) + 1) * blocks - 1

    def made(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, owner_of = shared.value
        rows = pa.Table.from_batches(held)
        term, tf, sizes = _flat(rows.column("terms").to_pylist(), rows.column("tfs").to_pylist())
        doc = np.repeat(np.arange(len(sizes)), sizes)
        gains = gain(tf, np.repeat(rows.column("n").to_numpy(), sizes))
        known, at = packed.is_member(term, ids)
        term, doc, gains, owner = term[known], doc[known], gains[known], owner_of[at[known]]
        order = np.lexsort((doc, term, owner))
        term, doc, gains, owner = term[order], doc[order], gains[order], owner[order]
        columns: list[list] = [[] for _ in schema]
        for o, stage in enumerate(stages):
            lo, hi = np.searchsorted(owner, [o, o + 1])
            if lo == hi and stage != final:
                continue
            mine = term[lo:hi]
            ends = np.r_[np.flatnonzero(np.diff(mine)) + 1, hi - lo] if hi > lo else mine
            values = (shard, stage, mine[ends - 1].tobytes(), ends.astype(np.int32).tobytes(),
                      doc[lo:hi].astype(np.uint16).tobytes(), gains[lo:hi].astype(np.int32).tobytes(),
                      rows.column("doc").to_pylist() if stage == final else [])
            for column, value in zip(columns, values):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(shards)) + 1, len(shards)].tolist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and shards[lo] != key:
                    if held:
                        yield made(int(key), held)
                    key, held = shards[lo], []
                if hi > lo:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield made(int(key), held)

    return cells


def _pack(group: pa.Table) -> pa.Table:
    """The items of a group with their terms, owners in order."""
    order = pc.sort_indices(group, [("item_no", "ascending"), ("owner", "ascending"), ("id", "ascending")])
    group = group.take(order)
    columns = [group.column(c).to_numpy().astype(_KINDS[q]).tobytes() for c, q in zip(
        ["item_no", "id", "weight", "bound", "owner"], _QUERY)]
    return pa.table({"grp": group.column("grp")[:1], **{
        q: pa.array([c], pa.binary()) for q, c in zip(_QUERY, columns)}})


def _read(row: dict, names) -> list[np.ndarray]:
    return [np.frombuffer(row[name] or b"", _KINDS[name]) for name in names]


def _visit(stage: int, last: bool, k: int, out: pa.Schema):
    """One owner adds its terms' contributions to the accumulators of a bundle."""
    def visit(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        if not bundles.num_rows:
            return out.empty_table()
        (bundle,), cell = bundles.to_pylist(), postings.slice(0, 1).to_pylist()
        item, term, weight, bound, owner = _read(bundle, _QUERY)
        a_item, a_doc, a_score = _read(bundle, ["a_item", "a_doc", "a_score"])
        cell = cell[0] if cell else {"terms": b"", "ends": b"", "docs": b"", "gains": b"", "ids": []}
        terms, ends = np.frombuffer(cell["terms"], np.int64), np.frombuffer(cell["ends"], np.int32)
        docs, gains = np.frombuffer(cell["docs"], np.uint16), np.frombuffer(cell["gains"], np.int32)
        begins = np.r_[0, ends[:-1]]
        at = np.searchsorted(terms, term)
        here = (owner == stage) & (at < len(terms))
        here[here] = terms[at[here]] == term[here]
        size = 1 + max(docs.max(initial=0), a_doc.max(initial=0))
        kept = [(item[:0], a_doc[:0], a_score[:0])]
        for no in np.union1d(item, a_item):
            scores = np.zeros(size, np.int64)
            lo, hi = np.searchsorted(a_item, [no, no + 1])
            scores[a_doc[lo:hi]] = a_score[lo:hi]
            lo, hi = np.searchsorted(item, [no, no + 1])
            for i in (lo + np.flatnonzero(here[lo:hi])).tolist():
                run = slice(begins[at[i]], ends[at[i]])
                scores[docs[run]] += weight[i] * gains[run]
            to_come = bound[lo:hi][owner[lo:hi] > stage].sum()
            found = np.flatnonzero(scores)
            if len(found) > k:
                some = scores[found]
                found = found[some + to_come >= np.partition(some, len(some) - k)[len(some) - k]]
            kept.append((np.full(len(found), no, np.int32), found.astype(np.uint16), scores[found]))
        items, places, scores = (np.concatenate(c) for c in zip(*kept))
        if last:
            ids = pa.array(cell["ids"], out.field("docs").type.value_type)
            return _best(bundle["shard"] // MERGE, bundle["grp"], items, ids.take(pa.array(places.astype(np.int64))),
                         scores, k, out)
        later = owner > stage
        values = [*(c[later] for c in (item, term, weight, bound, owner)), items, places, scores]
        return pa.table([[bundle["shard"]], [bundle["grp"]], *[[v.tobytes()] for v in values]], schema=out)

    return visit


def _best(part: int, group: int, items: np.ndarray, ids: pa.Array, scores: np.ndarray, k: int,
          out: pa.Schema) -> pa.Table:
    """The k best of each item as one packed row."""
    rows = pa.table({"item": items, "score": scores, "doc": ids})
    order = pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("doc", "ascending")],
                            null_placement="at_start").to_numpy()
    items, scores = items[order], scores[order]
    top = np.arange(len(items)) - np.searchsorted(items, items) < k
    ids = ids.take(pa.array(order[top]))
    return pa.table([pa.array([part], pa.int64()), pa.array([group], pa.int64()),
                     pa.array([items[top].tolist()], pa.list_(pa.int32())),
                     pa.array([ids.to_pylist()], out.field("docs").type),
                     pa.array([scores[top].tolist()], pa.list_(pa.int64()))], schema=out)


def _merge(k: int, out: pa.Schema):
    def merge(rows: pa.Table) -> pa.Table:
        flat = [pc.list_flatten(rows.column(c)).combine_chunks() for c in ("items", "docs", "scores")]
        return _best(rows.column("part")[0].as_py() // MERGE, rows.column("grp")[0].as_py(),
                     flat[0].to_numpy(), flat[1], flat[2].to_numpy(), k, out)

    return merge


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, doc_col, score): the ``k`` best documents above 0 of each item.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII,
    with A-Z in lower case. Scores are whole numbers; equal ones go by ascending
    document id, NULL first. A NULL, empty or blank text has no terms and counts
    for nothing; texts of any length count whole. Rows of one item id (NULL
    too) are one item with the terms of all; an item without a term that some
    document holds has no rows. Repeated document rows are documents of their
    own. Empty tables give no rows; other columns do not matter.

    The items' terms are taken in blocks of ``VOCABULARY`` (each at most 64
    bytes, longer ones by digest), one pass over the documents for each block.
    """
    spark, owners = docs.sparkSession, len(OWNERS) + 1
    asked = materialize(item_terms(items, item_col, item_text), "item-terms")
    vocab = materialize(numbered(asked.select("term").distinct(), [F.col("term")], "id", 0), "vocabulary")
    blocks = max(1, -(-vocab.count() // VOCABULARY))
    texts = spread(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")))
    id_type = texts.schema["doc"].dataType.simpleString()
    forward = None
    for block in range(blocks):
        first = block * VOCABULARY
        mine = vocab.where(F.col("id").between(first, first + VOCABULARY - 1)).collect()
        shared = spark.sparkContext.broadcast({bytes(r["term"]): r["id"] - first for r in mine})
        part = materialize(texts.mapInArrow(_forward(shared, block, first), f"doc {id_type}, {_FORWARD}"),
                           "forward", compression="zstd")
        shared.destroy()
        forward = part if forward is None else forward.unionByName(part)
    total = forward.where("block = 0").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).first()
    n_docs, gain = total["docs"], Gain(total["docs"], total["words"] or 1)

    stats = forward.select("block", "n", "terms", "tfs").mapInArrow(
        _statistics(gain), "id bigint, df bigint, most bigint").groupBy("id").agg(
        F.sum("df").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    owner = F.lit(0)
    for share in OWNERS:
        owner = owner + (F.col("df") * share >= n_docs).cast("int")
    stats = materialize(stats.withColumn("weight", weight).where("weight > 0").withColumn("owner", owner),
                        "term-statistics")

    shards = max(1, -(-n_docs // SHARD_DOCS))
    sharded = forward.withColumn("shard", F.pmod(F.xxhash64("spot"), F.lit(shards)))
    cells = None
    for block in range(blocks):
        first = block * VOCABULARY
        mine = stats.where(F.col("id").between(first, first + VOCABULARY - 1)).select(
            "id", "owner").orderBy("id").toArrow()
        shared = spark.sparkContext.broadcast(tuple(c.to_numpy() for c in mine.columns))
        made = _cells(shared, gain, block, blocks, to_arrow_schema(texts.schema).field("doc").type)
        part = sharded.where(F.col("block") == block).select("shard", "spot", "doc", "n", "terms", "tfs").repartition(
            "shard").sortWithinPartitions("shard", "spot").mapInArrow(made, _CELL.format(id_type))
        part = materialize(part, "postings", compression="zstd")
        shared.destroy()
        cells = part if cells is None else cells.unionByName(part)

    numbers = materialize(numbered(asked.select("item").distinct(), [F.col("item")], "no", 0), "items")
    groups = materialize(
        asked.join(vocab, "term").join(stats, "id").withColumnRenamed("item", "_item")
        .join(numbers, F.col("_item").eqNullSafe(F.col("item"))).select(
            F.floor(F.col("no") / GROUP_ITEMS).cast("bigint").alias("grp"),
            (F.col("no") % GROUP_ITEMS).alias("item_no"), "id", "weight",
            (F.col("weight") * F.col("most")).alias("bound"),
            (F.col("owner") * blocks + F.floor(F.col("id") / VOCABULARY)).alias("owner"))
        .groupBy("grp").applyInArrow(_pack, "grp bigint, " + ", ".join(f"{q} binary" for q in _QUERY)),
        "item-groups")
    last_group = F.lit(max(0, -(-numbers.count() // GROUP_ITEMS) - 1)).cast("bigint")
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), last_group)).alias("grp")
    bundles = lookup_join(
        spark.range(shards).select(F.col("id").alias("shard"), every), groups, ["grp"], "inner",
        salt_by=["shard"]).select("shard", "grp", *[
            F.col(c) if c in _QUERY else F.lit(None).cast("binary").alias(c) for c in _KINDS])
    best = T.StructType.fromDDL(_BEST.format(id_type))
    for stage in range(owners * blocks):
        last = stage == owners * blocks - 1
        schema = best if last else bundles.schema
        owned = cells.where(F.col("stage") == stage).select("shard", every, "terms", "ends", "docs", "gains", "ids")
        visited = bundles.groupBy("shard", "grp").cogroup(owned.groupBy("shard", "grp")).applyInArrow(
            _visit(stage, last, k, to_arrow_schema(schema)), schema)
        bundles = materialize(visited, "bundles", compression="zstd")
    parts = shards
    while True:
        parts = -(-parts // MERGE)
        bundles = materialize(bundles.groupBy("part", "grp").applyInArrow(
            _merge(k, to_arrow_schema(best)), best), "best")
        if parts == 1:
            break
    rows = bundles.select("grp", F.explode(F.arrays_zip("items", "docs", "scores")).alias("r")).select(
        (F.col("grp") * GROUP_ITEMS + F.col("r.items")).alias("no"), F.col("r.docs").alias("doc"),
        F.col("r.scores").alias("score"))
    order = Window.partitionBy("no").orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).join(numbers, "no").select(
        F.col("item").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")
