"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.session import materialize


def _settle(parents: DataFrame) -> DataFrame:
    """(id, parent) of a forest -> (id, root); each pass halves every depth."""
    while True:
        far = parents.select(F.col("id").alias("parent"), F.col("parent").alias("_far"))
        parents = materialize(
            parents.join(far, "parent", "left").select(
                "id", F.coalesce("_far", "parent").alias("parent"),
                F.col("_far").isNotNull().alias("_moved")), "parents")
        if not parents.where("_moved").limit(1).count():
            return parents.select("id", F.col("parent").alias("root"))
        parents = parents.select("id", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for every endpoint of ``edges`` (u, v): the smallest id it reaches.

    Every node hooks onto its smallest smaller neighbour, the hooks are
    followed to their roots, and the edges are contracted to pairs of roots.
    After two rounds each root left has absorbed at least one other, so the
    number of rounds grows with the logarithm of the number of nodes, whatever
    the order of the ids. There is no limit on the rounds. A self-loop gives its
    node; edges with a NULL end are no edges; no edges give no rows.
    """
    ends = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL")
    pairs = materialize(
        ends.where("u <> v").select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"))
        .distinct(), "pairs")
    roots = None
    while True:
        step = _settle(pairs.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("parent")))
        if roots is None:
            roots = step
        else:
            moved = step.select(F.col("id").alias("root"), F.col("root").alias("_new"))
            kept = roots.join(moved, "root", "left").select(
                "id", F.coalesce("_new", "root").alias("root"))
            # A former root that hooked on has no row of its own yet.
            roots = materialize(
                kept.unionByName(step.join(roots.select("id"), "id", "left_anti")), "roots")
        lo = step.select(F.col("id").alias("lo"), F.col("root").alias("_lo"))
        hi = step.select(F.col("id").alias("hi"), F.col("root").alias("_hi"))
        mapped = pairs.join(lo, "lo", "left").join(hi, "hi", "left").select(
            F.coalesce("_lo", "lo").alias("a"), F.coalesce("_hi", "hi").alias("b"))
        pairs = materialize(
            mapped.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            .distinct(), "pairs")
        if not pairs.limit(1).count():
            break
    # The ends that never hooked are the roots themselves.
    alone = ends.select(F.col("u").alias("id")).unionByName(ends.select(F.col("v").alias("id")))
    return roots.unionByName(
        alone.distinct().join(roots.select("id"), "id", "left_anti")
        .select("id", F.col("id").alias("root")))
