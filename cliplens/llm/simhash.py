"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is cut into d + 2 blocks. Two that differ in at most d
bits agree in at least two blocks, so they meet in one of the (d + 2 over 2)
tables keyed by a pair of blocks, and only those that meet are compared.
Exact copies are one fingerprint before any table is built. A bucket beyond a
bound is cut into chunks by a hash and every two chunks meet in a cell of their
own; a cell gives a spanning forest of its links, never its pairs, which leaves
the components as they are. Components are found by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.llm import packed
from cliplens.llm.similar import keep_one, text_digest  # noqa: F401 (keep_one is part of this module)
from cliplens.operators.components import connected_components
from cliplens.operators.joins import weighted_join
from cliplens.session import materialize

BITS = 64
CHUNK_ROWS = 1024
SHINGLE = 3
MAX_DISTANCE = 3


def _fingerprint(words: list[bytes], size: int) -> int:
    from xxhash import xxh64_intdigest

    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.zeros(len(words), np.int64)
    np.cumsum(lengths[:-1], out=starts[1:])
    ends = starts + lengths - 1
    ones, n = np.zeros(BITS, np.int64), len(words) - size + 1
    for at in range(0, n, 1 << 16):  # bounded scratch on a text of any length
        to = min(n, at + (1 << 16))
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(
            starts[at:to].tolist(), ends[at + size - 1:to + size - 1].tolist())], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprint_udf(size: int):
    def fingerprint(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            data, offsets = packed.text_bytes(texts)
            out = np.zeros(len(texts), np.uint64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                # bytes.split cuts at exactly space and 0x09 to 0x0D
                out[i] = _fingerprint(data[a:b].tobytes().lower().split(), size)
            yield pa.array(out.view(np.int64), pa.int64())

    return F.arrow_udf(fingerprint, "bigint").asNondeterministic()


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint",
                 shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the 64-bit SimHash of each whole text, as a signed long.

    Words are split at ASCII white space, with A-Z in lower case; shingles are
    ``shingle`` words, repeats included, hashed by XXH64 with seed 42. A text of
    fewer words is one shingle. NULL, empty and blank texts have fingerprint 0.
    An existing column named ``out`` is replaced.
    """
    return docs.withColumn(out, _fingerprint_udf(shingle)(F.col(text_col)))


def _tables(distance: int):
    """Key columns: one for each pair of blocks that may agree."""
    n = distance + 2
    edges = [BITS * i // n for i in range(n + 1)]
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    block = [F.shiftrightunsigned("fingerprint", a).bitwiseAND(F.lit((1 << (b - a)) - 1))
             for a, b in zip(edges, edges[1:])]
    return [F.lit(t).cast("bigint") * (1 << 2 * widest) + block[i] * (1 << widest) + block[j]
            for t, (i, j) in enumerate(combinations(range(n), 2))]


def _forest(prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every group of prints within ``distance`` of a neighbour."""
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= distance
    free = np.ones(len(prints), bool)
    u, v = [], []
    while free.any():
        frontier = np.array([int(free.argmax())])
        free[frontier] = False
        while len(frontier):
            found = near[frontier] & free
            reached = np.flatnonzero(found.any(0))
            u.append(prints[frontier[found[:, reached].argmax(0)]])
            v.append(prints[reached])
            free[reached] = False
            frontier = reached
    return np.concatenate(u), np.concatenate(v)


def _link_cells(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(0)
            offsets = cells.offsets.to_numpy()
            values = cells.values.to_numpy().view(np.uint64)
            us, vs = [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if b - a == 2:  # most cells
                    if (int(values[a]) ^ int(values[a + 1])).bit_count() <= distance:
                        us.append(values[a:a + 1])
                        vs.append(values[a + 1:b])
                elif b - a > 2:
                    u, v = _forest(values[a:b], distance)
                    us.append(u)
                    vs.append(v)
            u = np.concatenate(us) if us else np.empty(0, np.uint64)
            v = np.concatenate(vs) if vs else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return link


def link_fingerprints(unique: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """(u, v): links between distinct fingerprints that keep every component whole.

    ``unique`` has distinct values of ``fingerprint``.
    """
    keyed = unique.select("fingerprint", F.explode(F.array(*_tables(distance))).alias("key"))
    sizes = materialize(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        .withColumn("chunks", F.ceil(F.col("n") / CHUNK_ROWS)), "bucket-sizes")
    met = weighted_join(keyed, sizes.select("key", "chunks", "n"), "key", "n", "inner",
                        ["fingerprint"])
    mine = F.pmod(F.xxhash64("fingerprint"), F.col("chunks"))
    cells = met.withColumn("_mine", mine).withColumn(
        "_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).groupBy(
        "key", F.least("_mine", "_other").alias("a"), F.greatest("_mine", "_other").alias("b")
    ).agg(F.collect_list("fingerprint").alias("prints"))  # two chunks at most
    return cells.select("prints").mapInArrow(_link_cells(distance), "u bigint, v bigint")


def _groups(prints: DataFrame, distance: int) -> DataFrame:
    """(fingerprint, n, least) of each fingerprint: its rows and the first row of its component.

    ``prints`` is a written table of (__id, __digest, fingerprint). Rows are in
    order of id, NULL last, then of digest.
    """
    first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"),
                           F.col("__digest").alias("digest")))
    unique = materialize(
        prints.groupBy("fingerprint").agg(first.alias("least"), F.count("*").alias("n")),
        "distinct-fingerprints")
    links = materialize(link_fingerprints(unique.select("fingerprint"), distance), "links")
    roots = connected_components(links).select(F.col("id").alias("fingerprint"), "root")
    grouped = materialize(unique.join(roots, "fingerprint", "left").select(
        "fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root")), "groups")
    smallest = materialize(grouped.groupBy("root").agg(
        F.min("least").alias("least"), F.count("*").alias("size")), "components")
    return materialize(
        weighted_join(grouped.select("fingerprint", "n", "root"), smallest, "root", "size", "inner",
                      ["fingerprint"]).select("fingerprint", "n", "least"), "named-groups")


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("_text"))
    return materialize(
        fingerprints(rows, "_text").select("__id", text_digest("_text").alias("__digest"), "fingerprint"),
        "fingerprints")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    distance: int = MAX_DISTANCE) -> DataFrame:
    """(id, fingerprint, component_id) of each row: the smallest id that links reach.

    Fingerprints that differ in at most ``distance`` bits link, equal ones
    always; components are whole however they are chained.

    NULL, empty and blank texts share fingerprint 0 and link like any other. Rows
    of NULL id take part and get the smallest id of the others, NULL if there is
    none. Repeated rows are returned as often as given. An empty table gives no
    rows. The columns are named ``id_col``, ``fingerprint`` and ``component_id``;
    other columns of ``docs`` are not looked at.
    """
    prints = _printed(docs, id_col, text_col)
    named = _groups(prints, distance).select(
        "fingerprint", "n", F.col("least.id").alias("component_id"))
    return weighted_join(prints.drop("__digest"), named, "fingerprint", "n", "inner",
                         ["__id"]).select(F.col("__id").alias(id_col), "fingerprint", "component_id")
