"""The near-dedup stage: planted pairs of known similarity against all pairs of shingle sets."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cliplens.llm import similar
from tests.conftest import SF


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} or {" ".join(words)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def survivors(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if find(a) != find(b) and jaccard(sets[a], sets[b]) >= 0.8:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return sorted(i for n, (i, _) in enumerate(rows) if find(n) == n)


def planted(pairs=150):
    rng, rows, found = random.Random(3), [], []
    for p in range(pairs):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        other = list(words)
        for _ in range(rng.randrange(0, 2 + len(words) // 30)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10 ** 9)}"
        rows += [(2 * p, " ".join(words)), (2 * p + 1, "  ".join(other).upper())]
        found.append(jaccard(shingles(rows[-1][1]), shingles(rows[-2][1])))
    return rows, found


def test_planted_pairs_of_all_similarities(spark):
    rows, found = planted()
    assert sum(0.8 <= s < 0.9 for s in found) > 20 and sum(s < 0.8 for s in found) > 20
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows],
                                 "doc_id bigint, text string, lang string, source string, n_chars int")
    kept = corpus_pipeline.near_dedup(spark, docs.repartition(4), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == survivors(rows)


def test_chains_and_wide_buckets_keep_their_components(spark, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK_ROWS", 4)
    rng = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(200)]
    for i in range(60):  # neighbours are alike, the ends are not
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = f"y{i}"
    words = [f"v{i}" for i in range(300)]
    for i in range(100, 160):  # a group around one text
        mine = list(words)
        mine[rng.randrange(300)] = f"z{i}"
        rows.append((i, " ".join(mine)))
    rows += [(200, "one two"), (201, "One  two"), (202, ""), (203, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = survivors([(i, t or "") for i, t in rows])
    assert len(want) < 20
    assert sorted(r["doc_id"] for r in similar.keep_one(docs).collect()) == want


def test_links_equal_all_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 40, 100)
    sets = [np.unique(np.append(base[rng.random(100) < 0.87], i)) for i in range(40)]
    near = [(i, j) for j in range(40) for i in range(j)
            if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
    links = similar.similar_links(sets, np.arange(40), np.ones(40, bool), 0.8)
    assert {tuple(sorted(e)) for e in links} <= set(near)

    def parts(edges):
        group = list(range(40))
        for i, j in edges:
            group = [group[i] if g == group[j] else g for g in group]
        return len(set(group))

    assert 1 < parts(near) == parts(links) == 40 - len(links)


def test_rows_of_one_group_are_not_compared():
    sets = [np.arange(10, dtype=np.uint64)] * 4
    assert similar.similar_links(sets, np.array([0, 0, 0, 0]), np.ones(4, bool), 0.8) == []
    assert similar.similar_links(sets, np.array([0, 0, 1, 1]), np.array([0, 0, 0, 1], bool), 0.8) == [(3, 0)]
    assert similar.similar_links(sets, np.array([0, 1, 2, 3]), np.zeros(4, bool), 0.8) == []


@pytest.mark.parametrize("strays, limit", [(40, 2), (3000, None)])
def test_strays_meet_all_others_once(spark, strays, limit):
    """A hot bucket with strays: no more copies than twice the rows while one block holds the strays."""
    rows = [(7, b"m%d" % i, b"main") for i in range(5000)] + [(7, b"s%d" % i, b"s%d" % i) for i in range(strays)]
    n = len(rows)
    opened = spark.createDataFrame(
        [(7, n, b"main", 20, -(-strays // similar.BLOCK_ROWS), -(-5000 // similar.BLOCK_ROWS))],
        "key long, n long, main binary, chunks long, s long, m long")
    cells = similar._across(spark.createDataFrame(rows, "key long, node binary, root binary"), opened).collect()
    assert limit is None or len(cells) <= limit * n
    met, by_cell = set(), {}
    for r in cells:
        by_cell.setdefault((r["a"], r["b"]), []).append((bytes(r["node"]), r["left"]))
    pairs = 0
    for (a, b), members in by_cell.items():
        lefts = [m for m, left in members if left]
        rest = [m for m, left in members if not left]
        pairs += len(lefts) * (len(lefts) - 1) // 2 if a == b else len(lefts) * len(rest)
        if limit:
            met |= {frozenset(p) for p in (
                itertools.combinations(lefts, 2) if a == b else itertools.product(lefts, rest))}
    assert pairs == strays * 5000 + strays * (strays - 1) // 2
    assert not limit or len(met) == pairs


def test_text_ids_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [("b", long, 1), ("a", long + " x", 2), (None, long, 3), ("c", "other text", 4), ("", "other  text", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __id int").withColumns(
        {"__digest": F.col("__id"), "__none": F.col("__id"), "__near_id": F.col("__id")})
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["__id"], r["__none"], r["__near_id"]) for r in kept.collect()) == [
        ("", 5, 5, 5), ("a", 2, 2, 2)]
