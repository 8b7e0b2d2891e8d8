"""Near-duplicates by exact similarity of word shingles, for filtering a corpus.

Two texts are alike if the Jaccard similarity of their sets of five-word
shingles is 0.8 or more. SimHash and MinHash name the candidates. The SimHash of
a set is cut into five blocks, and sets that agree in two of them meet, so all
within 3 bits do. Texts of that similarity also share at least one of the MinHash
bands but for one pair in 20,000 (fewer above 0.8). Candidates are compared by
their whole shingle sets before they
link. Equal sets are one node before any key is built. A bucket beyond a bound
is cut into chunks by a hash, which are compared by themselves first. Where the
bucket is not one component by then, the rows outside its largest component are
compared with the others in blocks, and no rows of one component ever are.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliplens.llm import packed
from cliplens.operators.components import connected_components
from cliplens.operators.joins import weighted_join
from cliplens.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 25, 5
PRINT_BLOCKS = 5  # two of them agree in prints that differ in 3 bits or fewer
CHUNK_ROWS, CHUNK_SHINGLES = 256, 1 << 20
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
BATCH_ROWS = 256
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * BAND_ROWS), dtype=np.uint64)
_SKETCH = "struct<node:binary,size:int,bands:array<bigint>>"
_SKETCH_ARROW = pa.struct([("node", pa.binary()), ("size", pa.int32()), ("bands", pa.list_(pa.int64()))])


def text_digest(text_col: str):
    return F.xxhash64(F.col(text_col).isNull(), F.col(text_col))


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles; a text of fewer words is one shingle.

    Words are split at ASCII white space, with A-Z in lower case.
    """
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1:]
    return np.unique(np.fromiter(
        (xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())),
        np.uint64, n))


def _fingerprint(hashes: np.ndarray) -> int:
    """The SimHash of a set of 64-bit hashes: the bits set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 13):
        bits = np.unpackbits(hashes[at:at + (1 << 13)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _tables(fingerprint: int) -> np.ndarray:
    """One key for each two blocks of a fingerprint."""
    edges = [64 * i // PRINT_BLOCKS for i in range(PRINT_BLOCKS + 1)]
    blocks = [(fingerprint >> a) & ((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
    keys = [(t + 1) << 32 | blocks[i] << 16 | blocks[j]
            for t, (i, j) in enumerate(combinations(range(PRINT_BLOCKS), 2))]
    return packed.mix(np.array(keys, np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _keys(hashes: np.ndarray) -> np.ndarray:
    """The keys under which a set looks for others: MinHash bands, then SimHash tables."""
    return np.concatenate([_bands(hashes), _tables(_fingerprint(hashes))])


def _bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of the MinHash signature."""
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    mask, factor = _SEEDS[0][:, None], _SEEDS[1][:, None] | np.uint64(1)
    for at in range(0, len(hashes), 1 << 13):  # bounded scratch on a text of any length
        np.minimum(least, ((hashes[None, at:at + (1 << 13)] ^ mask) * factor).min(1), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in packed.mix(least).reshape(BANDS, BAND_ROWS).T:
        keys = packed.mix(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def _texts(parts: pa.Array) -> Iterator[bytes]:
    data, offsets = packed.text_bytes(parts)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield data[a:b].tobytes()


def _sketch_udf(shingle: int):
    def sketch(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from xxhash import xxh3_128_digest

        for texts in parts:
            rows = []
            for text in _texts(texts):
                found = shingle_set(text, shingle)
                rows.append((xxh3_128_digest(found.tobytes()), len(found),
                             _keys(found) if len(found) else []))
            yield pa.StructArray.from_arrays(
                [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SKETCH_ARROW)],
                fields=list(_SKETCH_ARROW))

    return F.arrow_udf(sketch, _SKETCH).asNondeterministic()


def _set_udf(shingle: int):
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([shingle_set(t, shingle).tobytes() for t in _texts(texts)], pa.binary())

    return F.arrow_udf(sets, "binary").asNondeterministic()


def similar_links(sets: list[np.ndarray], groups: np.ndarray, lefts: np.ndarray,
                  similarity: float, among: bool = True) -> list[tuple[int, int]]:
    """Links that join the groups of every left set and any set of at least ``similarity``.

    Left sets are compared with each other only if ``among``. Sets of one group are never compared, and groups that a link has joined are
    one from then on.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    groups, links = np.unique(groups, return_inverse=True)[1], []
    inside = np.zeros(len(values), np.int32)
    for i in np.flatnonzero(lefts).tolist():
        others = np.flatnonzero((groups != groups[i]) & (among | ~lefts))
        if not len(others):
            continue
        size, first = sizes[others], starts[others]
        at = np.cumsum(size) - size
        theirs = codes if len(others) == len(sets) else codes[
            np.arange(int(size.sum())) + np.repeat(first - at, size)]
        mine = codes[starts[i]:starts[i] + sizes[i]]
        inside[mine] = 1
        both = np.add.reduceat(inside[theirs], at)
        inside[mine] = 0
        near = others[both >= similarity * (size + sizes[i] - both)]
        for group in np.unique(groups[near]).tolist():
            links.append((i, int(near[np.argmax(groups[near] == group)])))
        groups[np.isin(groups, groups[near])] = groups[i]
    return links


def _link_cells(similarity: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, a, b, left, node, root, hashes), the rows of a cell one after another."""
        cell, rows, links = None, [], []

        def close():
            if len(rows) > 1:
                lefts, nodes, roots, sets = zip(*rows)
                links.extend((nodes[i], nodes[j]) for i, j in similar_links(
                    [np.frombuffer(h, np.uint64) for h in sets], np.array(roots, object),
                    np.array(lefts, bool), similarity, cell[1] == cell[2]))

        for batch in batches:
            for *where, left, node, root, hashes in zip(*[c.to_pylist() for c in batch.columns]):
                if where != cell:
                    close()
                    cell, rows = where, []
                rows.append((left, node, root, hashes))
        close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([e[i] for e in links], pa.binary()) for i in (0, 1)], names=["u", "v"])

    return link


def _rooted(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """``nodes`` with the ``root`` of the component that the links give each."""
    if links is None:
        return nodes.withColumn("root", F.col("node"))
    roots = connected_components(links).select(F.col("id").alias("node"), "root")
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _blocks(rows: str, shingles: str, limit: int, most: int):
    return F.greatest(F.ceil(F.col(rows) / limit), F.ceil(F.col(shingles) / most))


def _inside(rows: DataFrame, opened: DataFrame) -> DataFrame:
    """Each row in one chunk of its bucket."""
    mine = F.pmod(F.xxhash64("node", "key"), F.col("chunks"))
    return weighted_join(rows, opened.select("key", "n", "chunks"), "key", "n", "inner", ["node"]).select(
        "key", mine.alias("a"), mine.alias("b"), F.lit(True).alias("left"), "node", "root")


def _across(rows: DataFrame, opened: DataFrame) -> DataFrame:
    """Rows outside the bucket's largest group beside all others, block by block.

    Blocks 0 to S - 1 hold the rows outside, the others those of the largest
    group. Cell (a, b) has block a on its left. With one block outside, the rows
    of the largest group go to one cell each.
    """
    cells = weighted_join(rows, opened.where("chunks > 1").select("key", "n", "main", "s", "m"),
                          "key", "n", "inner", ["node"])
    block = F.pmod(F.xxhash64("node", "key"), F.when(F.col("root") == F.col("main"), F.col("m")).otherwise(F.col("s")))
    cells = cells.withColumn("block", block)

    def cell(a, b, left):
        return F.struct(a.alias("a"), b.alias("b"), F.lit(left).alias("left"))

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    main = F.transform(F.sequence(zero, F.col("s") - one), lambda a: cell(a, F.col("s") + F.col("block"), False))
    outside = F.transform(F.sequence(F.col("block"), F.col("s") + F.col("m") - one),
                          lambda b: cell(F.col("block"), b, True))
    before = F.when(F.col("block") > 0, F.transform(
        F.sequence(zero, F.col("block") - one), lambda a: cell(a, F.col("block"), False))).otherwise(F.array())
    return cells.withColumn("c", F.explode(F.when(F.col("root") == F.col("main"), main).otherwise(
        F.concat(outside, before)))).select("key", "c.a", "c.b", "c.left", "node", "root")


def link_similar(keyed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, v): links that keep the components of all pairs that meet in a bucket and are alike.

    ``keyed`` has (node, size, band, key) for every bucket of several nodes,
    ``sets`` the hashes of each of these nodes once.
    """
    # A first band alone joins most of a group, so the others need not look at it again.
    passes = [(F.col("band") == 0, _inside), (F.lit(True), _inside), (F.lit(True), _across)]
    links = None
    for which, dealt in passes:
        nodes = materialize(_rooted(sets.select("node"), links), "similar-roots")
        rows = materialize(keyed.where(which).join(nodes, "node"), "bucket-rows")
        groups = rows.groupBy("key", "root").agg(
            F.count("*").alias("n"), F.sum(F.col("size").cast("bigint")).alias("shingles"))
        largest = F.max(F.struct("n", "shingles", "root"))
        opened = groups.groupBy("key").agg(
            F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"),
            largest.alias("l")).where("groups > 1").select(
            "key", "n", "shingles", F.col("l.root").alias("main"), F.col("l.n").alias("n_main"),
            F.col("l.shingles").alias("sh_main")).withColumns(
            {"n_out": F.col("n") - F.col("n_main"), "sh_out": F.col("shingles") - F.col("sh_main")})
        opened = materialize(opened.select(
            "key", "n", "main", _blocks("n", "shingles", CHUNK_ROWS, CHUNK_SHINGLES).alias("chunks"),
            _blocks("n_out", "sh_out", BLOCK_ROWS, BLOCK_SHINGLES).alias("s"),
            _blocks("n_main", "sh_main", BLOCK_ROWS, BLOCK_SHINGLES).alias("m")), "open-buckets")
        cells = dealt(rows.select("key", "node", "root"), opened)
        found = cells.join(sets, "node").select(
            "key", "a", "b", "left", "node", "root", "hashes").repartition(
            "key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(
            _link_cells(similarity), "u binary, v binary")
        with small_batches(sets.sparkSession):
            found = materialize(found, "similar-links")
        links = found if links is None else links.unionByName(found)
    return links


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Fewer rows in an Arrow batch for what runs inside: rows with a text's shingles are wide."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``.

    Texts whose sets of ``shingle`` words have a Jaccard similarity of at least
    ``similarity`` link, and groups are whole however they are chained. NULL,
    empty and blank texts are alike.

    The document kept is the one of the smallest id; of several rows with that
    id, one of the text with the smallest hash. A group without any id keeps one
    row alike. An empty table stays empty.
    """
    digest, tag = text_digest(text_col), "__near"
    while any(c.startswith(tag) for c in docs.columns):
        tag += "_"
    keys = [f"{tag}_none", f"{tag}_id", f"{tag}_digest"]
    prints = materialize(
        docs.select(F.col(id_col).alias("id"), digest.alias("digest"), _sketch_udf(shingle)(F.col(text_col)).alias("s"))
        .select("id", "digest", "s.*"), "sketches")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest"))
    unique = materialize(prints.groupBy("node").agg(
        least.alias("least"), F.first("size").alias("size"), F.first("bands").alias("bands")), "distinct-sets")
    keyed = unique.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    keyed = materialize(weighted_join(keyed, shared, "key", "n", "inner", ["node"]), "candidates")

    def of_least(groups, *more):
        values = ["least.none", F.coalesce(F.col("least.id").cast("string"), F.lit("")), "least.digest"]
        return groups.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in zip(keys, values)], *more)

    keyed_docs = docs.withColumns(dict(zip(keys, [
        F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("string"), F.lit("")), digest])))
    wanted = of_least(unique.join(keyed.select("node").distinct(), "node"), "node")
    sets = materialize(
        keyed_docs.select(*keys, F.col(text_col).alias("text")).join(wanted, keys)
        .select("node", "text").dropDuplicates(["node"])
        .select("node", _set_udf(shingle)(F.col("text")).alias("hashes")), "shingle-sets")
    rooted = _rooted(unique.select("node", "least"), link_similar(keyed, sets, similarity))
    chosen = of_least(rooted.groupBy("root").agg(F.min("least").alias("least")))
    # Both the join and the window are by the same keys: one shuffle.
    alike = Window.partitionBy(*keys).orderBy(F.lit(0))
    return keyed_docs.join(chosen, keys, "left_semi").withColumn(
        f"{tag}_copy", F.row_number().over(alike)).where(F.col(f"{tag}_copy") == 1).select(*docs.columns)
