"""Merkle manifest of a table by time-forward processing.

Every row is a leaf, every value of a column (NULL too) a tree of its own, and
the trees' roots are the leaves of one last tree. Nodes are labelled (level,
index) and worked off in the order of their labels: a priority queue holds the
digests sent from children to parents, and a node is due when its label is the
least. The queue is external: Spark sorts what crosses blocks of ``8**HEIGHT``
nodes by label and spills it, and a heap holds the messages inside one block.
Each round does ``HEIGHT`` levels, so a table of n rows takes log(n) to the base
512 rounds, and a tree of any size is dealt over all tasks.

The reversed sweep works the same rounds off backwards. What travels then are
proof suffixes: a parent's proof is the tail of its children's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cliplens.llm import packed
from cliplens.operators.joins import lookup_join
from cliplens.operators.ranking import numbered
from cliplens.session import materialize, spread

FANOUT, HEIGHT = 8, 3
DIGEST = 32
_LEAVES = "struct<leaf:binary,altered:binary>"
_PROOF = "places array<int>, siblings array<binary>, tops array<binary>"
_UP = "tree string, n bigint, idx bigint, digest binary"


def digest_of(children: list[bytes]) -> bytes:
    """SHA-256 of the children's digests as lower-case hex text."""
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def fold(leaf: bytes, places: list[int], siblings: list[bytes]) -> bytes:
    """The root that a leaf and the siblings on its way up give."""
    for place, others in zip(places, siblings):
        at = place * DIGEST
        leaf = digest_of([others[:at], leaf, others[at:]])
    return leaf


def _leaf_udf(n_fields: int, lowered: int):
    def leaves(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for flags, *columns in batches:
            fields = [(packed.text_bytes(c), c.is_null().to_numpy(zero_copy_only=False)) for c in columns]
            out: tuple[list, list] = ([], [])
            for i, flag in enumerate(flags.to_pylist()):
                values = [None if none[i] else data[offsets[i]:offsets[i + 1]].tobytes()
                          for (data, offsets), none in fields]
                out[0].append(_leaf(values))
                if flag and values[lowered] is not None:
                    values[lowered] = values[lowered].lower()
                out[1].append(_leaf(values) if flag else None)
            yield pa.StructArray.from_arrays([pa.array(o, pa.binary()) for o in out],
                                             names=["leaf", "altered"])

    return F.arrow_udf(leaves, _LEAVES).asNondeterministic()


def _leaf(values: list[bytes | None]) -> bytes:
    return hashlib.sha256(b"".join(
        b"-" if v is None else b"%d:%b" % (len(v), v) for v in values)).digest()


def leaf_digests(fields: list[str], altered: Column | None = None, lowered: str | None = None) -> Column:
    """A struct of ``leaf``, the digest of the named columns of a row, and ``altered``.

    Each value counts as its UTF-8 byte count, a colon and itself, NULL as a
    dash. Where ``altered`` holds, the second digest is that of the row with
    A-Z of the column ``lowered`` in lower case; elsewhere it is NULL.
    """
    flag = F.lit(False) if altered is None else F.coalesce(altered, F.lit(False))
    udf = _leaf_udf(len(fields), fields.index(lowered) if lowered else 0)
    return udf(flag, *[F.col(f"`{f}`").cast("string") for f in fields])


def _height(n: int, height: int) -> int:
    """Levels from a block's nodes to its one node; a tree that fits in a block ends there."""
    levels = 0
    while levels < height and n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def _forward(digests: list[bytes], height: int) -> tuple[bytes, dict]:
    """Digest of the block's top node, and the inputs of every node by label."""
    queue = [((1, i // FANOUT), i % FANOUT, d) for i, d in enumerate(digests)]  # sorted, so a heap
    inputs: dict[tuple[int, int], list[bytes]] = {}
    digest = digests[0]
    while height and queue:
        label = queue[0][0]
        mine = inputs[label] = []
        while queue and queue[0][0] == label:
            mine.append(heapq.heappop(queue)[2])
        digest = digest_of(mine)
        level, index = label
        if level < height:
            heapq.heappush(queue, ((level + 1, index // FANOUT), index % FANOUT, digest))
    return digest, inputs


def _backward(digests: list[bytes], height: int, places: list[int], siblings: list[bytes]):
    """(places, siblings) of each of the block's nodes, in order."""
    _, inputs = _forward(digests, height)
    queue = [(-height, 0, places, siblings)]
    while queue:
        level, index, places, siblings = heapq.heappop(queue)
        if not level:
            yield places, siblings
            continue
        children = inputs[-level, index]
        for place in range(len(children)):
            others = b"".join(children[:place] + children[place + 1:])
            heapq.heappush(queue, (level + 1, index * FANOUT + place,
                                   [place, *places], [others, *siblings]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of equal first two columns, which lie side by side."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:2] != key:
                if rows:
                    yield rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield rows


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def made():
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield made()
            held.clear()
    yield made()


def _up(height: int):
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("idx", pa.int64()), ("digest", pa.binary())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for run in _runs(batches):
                tree, block, n = run[0][:3]
                levels = _height(n, height)
                digest, _ = _forward([r[4] for r in run], levels)
                yield tree, -(-n // FANOUT ** levels), block, digest

        yield from _batches(rows(), schema)

    return sweep


def _down(height: int, kept: pa.Schema):
    schema = pa.schema([*kept, ("places", pa.list_(pa.int32())), ("siblings", pa.list_(pa.binary())),
                        ("tops", pa.list_(pa.binary()))])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (message, *run) in _runs(batches):
                places, siblings, tops = message[-3:]
                levels = _height(run[0][2], height)
                proofs = _backward([r[4] for r in run], levels, places, siblings)
                for row, proof in zip(run, proofs):
                    yield (*row[5:-3], *proof, tops)

        yield from _batches(rows(), schema)

    return sweep


def climb(nodes: DataFrame, most: int, height: int = HEIGHT) -> list[DataFrame]:
    """The tables (tree, n, idx, digest) of all rounds; the last one has the top of each tree.

    ``nodes`` has the leaves: their tree, its number of leaves ``n`` and their
    place ``idx`` in it. ``most`` is the largest n.
    """
    rounds, width = [nodes], FANOUT ** height
    while most > 1:
        block = F.floor(F.col("idx") / width).cast("bigint").alias("block")
        up = rounds[-1].select("tree", block, "n", "idx", "digest").repartition(
            "tree", "block").sortWithinPartitions("tree", "block", "idx").mapInArrow(_up(height), _UP)
        rounds.append(materialize(up, "merkle-up"))
        most = -(-most // width)
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, carry: list[str], height: int = HEIGHT) -> DataFrame:
    """Each leaf's ``carry`` columns with its proof: places, siblings and the tops above it.

    ``tops`` has (tree, places, siblings, tops): what lies above each tree.
    """
    width = FANOUT ** height
    messages = tops.withColumn("block", F.lit(0).cast("bigint"))
    for at, nodes in enumerate(reversed(rounds[:-1] if len(rounds) > 1 else rounds)):
        last = at == max(1, len(rounds) - 1) - 1
        names = carry if last else ["tree", "idx"]
        kept = nodes.select(names)
        empty = [F.lit(None).cast(f.dataType).alias(f"_c{i}") for i, f in enumerate(kept.schema)]
        block = F.floor(F.col("idx") / width).cast("bigint").alias("block")
        rows = nodes.select("tree", block, "n", "idx", "digest",
                            *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)],
                            *[F.lit(None).cast(t).alias(c) for c, t in (
                                ("places", "array<int>"), ("siblings", "array<binary>"), ("tops", "array<binary>"))])
        sent = messages.select("tree", "block", F.lit(0).cast("bigint").alias("n"),
                               F.lit(-1).cast("bigint").alias("idx"), F.lit(None).cast("binary").alias("digest"),
                               *empty, "places", "siblings", "tops")
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
        out = sent.unionByName(rows).repartition("tree", "block").sortWithinPartitions(
            "tree", "block", "idx").mapInArrow(_down(height, to_arrow_schema(kept.schema)), f"{ddl}, {_PROOF}")
        if last:
            return out
        messages = materialize(out, "merkle-down").withColumnRenamed("idx", "block")


def merkle_proofs(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "lang",
                  altered: Column | None = None, lowered: str | None = None,
                  height: int = HEIGHT) -> DataFrame:
    """One row for each row of ``docs``: its id and its proof of membership.

    Columns: ``id_col``, ``leaf``, ``altered`` (see ``leaf_digests``),
    ``subroot`` and ``root`` as binary digests, and the proof from the leaf to
    the root: ``places`` (which child the node is) and ``siblings`` (the other
    children's digests end to end) of each level.

    Leaves of a tree stand in the order of their ids, NULL first, and rows of
    one id in that of their digests; equal rows are leaves of their own, each
    with a proof. NULL in ``tree_col`` is a tree, the first; the others follow
    bytewise. Texts of any length are digested whole, an empty table has no
    rows, and other columns of ``docs`` do not matter, whatever their names.
    """
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{tree_col}`").cast("string")), F.lit("0"))
    leaves = materialize(spread(docs).select(
        F.col(f"`{id_col}`").alias("id"), tree.alias("tree"),
        leaf_digests(fields, altered, lowered).alias("d")).select("id", "tree", "d.*"), "leaves")
    order = [F.col("tree"), F.col("id").asc_nulls_first(), F.col("leaf")]
    ranked = materialize(numbered(leaves, order, "idx", 0), "ranked-leaves")
    trees = materialize(ranked.groupBy("tree").agg(F.min("idx").alias("first"), F.count("*").alias("n")), "trees")
    nodes = materialize(
        lookup_join(ranked, trees, ["tree"], "inner", salt_by=["idx"])
        .withColumn("idx", F.col("idx") - F.col("first")).withColumn("digest", F.col("leaf"))
        .select("tree", "n", "idx", "digest", "id", "leaf", "altered"), "leaf-nodes")
    size = trees.agg(F.max("n").alias("most"), F.count("*").alias("trees")).first()
    rounds = climb(nodes, size["most"] or 0, height)
    subroots = materialize(numbered(
        rounds[-1].select(F.col("tree").alias("of"), "digest"), [F.col("of")], "idx", 0)
        .select(F.lit("").alias("tree"), F.lit(size["trees"]).cast("bigint").alias("n"), "idx", "digest", "of"), "subroots")
    above = climb(subroots, size["trees"], height)
    none = [F.array().cast("array<int>").alias("places"), F.array().cast("array<binary>").alias("siblings")]
    top = above[-1].select("tree", *none, F.array("digest").alias("tops"))
    tops = descend(above, top, ["of", "digest"], height).select(
        F.col("of").alias("tree"), "places", "siblings",
        F.concat(F.array("digest"), "tops").alias("tops"))
    return descend(rounds, materialize(tops, "tops"), ["id", "leaf", "altered"], height).select(
        F.col("id").alias(id_col), "leaf", "altered", F.col("tops")[0].alias("subroot"),
        F.col("tops")[1].alias("root"), "places", "siblings")


def _fold_udf():
    def folded(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for leaf, places, siblings in batches:
            rows = list(zip(leaf.to_pylist(), places.to_pylist(), siblings.to_pylist()))
            yield pa.StructArray.from_arrays(
                [pa.array([fold(*r) for r in rows], pa.binary()),
                 pa.array([digest_of(r[2]) for r in rows], pa.binary())], names=["root", "proof"])

    return F.arrow_udf(folded, "struct<root:binary,proof:binary>").asNondeterministic()


def folded(leaf: Column, places: Column, siblings: Column) -> Column:
    """A struct of the ``root`` that a leaf and a proof give and the digest of the ``proof``."""
    return _fold_udf()(leaf, places, siblings)
