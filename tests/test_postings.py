"""Block-max search against scoring every document."""

import random

import pytest

from cliplens.operators import postings
from cliplens.operators.postings import PostingIndex

SCHEMA = "array<struct<term:string,weight:double>>"


def weighted(rng, n, words):
    out = []
    for i in range(n):
        terms = set(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randrange(0, 9)))
        out.append((i * 7, [(t, rng.random() ** 4 + 0.01) for t in sorted(terms)]))
    return out


def brute(docs, asked, k, least):
    out = set()
    for v, q in asked:
        q = dict(q)
        scores = [(-round(s, 8), i) for i, d in docs if (s := sum(q.get(t, 0.0) * w for t, w in d)) >= least]
        out |= {(v, i) for _, i in sorted(scores)[:k]}
    return out


@pytest.mark.parametrize("sizes", [None, (50, 8, 3)])
def test_equals_scoring_every_document(spark, monkeypatch, sizes):
    if sizes:
        for name, value in zip(("SHARD_DOCS", "RANGE_DOCS", "QUERY_GROUP"), sizes):
            monkeypatch.setattr(postings, name, value)
    rng = random.Random(4)
    words = [f"t{i}" for i in range(80)]
    docs = weighted(rng, 700, words)
    docs += [(10_000 + i, docs[3][1]) for i in range(200)]  # equal scores go by id
    asked = weighted(rng, 20, words) + [(1000, [("unknown", 0.5)]), (1001, [])]
    table = spark.createDataFrame(docs, f"video_id long, weights {SCHEMA}").repartition(5)
    queries = spark.createDataFrame(asked, f"variant_id long, weights {SCHEMA}")
    index = PostingIndex.write(table)
    opened = PostingIndex.open(spark, index.path)
    assert opened.shards == index.shards
    for k, least in ((1, 0.0001), (10, 0.05)):
        got = {(r["variant_id"], r["video_id"]) for r in opened.search(queries, k, least).collect()}
        assert got == brute(docs, asked, k, least)
    df = {r["term"]: r["n_docs"] for r in opened.lists().collect()}
    assert df == {t: sum(t in dict(d) for _, d in docs) for t in df} and len(df) > 60


def test_blocks_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 8)
    rng = random.Random(5)
    docs = [(i, [("common", 0.1 + rng.random() * 0.1), *([("rare", 0.9)] if i % 500 == 0 else [])])
            for i in range(6000)]
    index = PostingIndex.write(spark.createDataFrame(docs, f"video_id long, weights {SCHEMA}"))
    asked = spark.createDataFrame([(1, [("common", 0.2), ("rare", 0.98)])], f"variant_id long, weights {SCHEMA}")
    counts = index.visits(asked, 5, 0.01).where("video_id IS NULL").groupBy().sum("opened", "blocks").first()
    assert 0 < counts[0] < counts[1] / 5
    got = {(1, r["video_id"]) for r in index.search(asked, 5, 0.01).collect()}
    assert got == brute(docs, [(1, [("common", 0.2), ("rare", 0.98)])], 5, 0.01)


def test_empty_index(spark):
    none = spark.createDataFrame([], f"video_id long, weights {SCHEMA}")
    asked = spark.createDataFrame([(1, [("a", 0.2)])], f"variant_id long, weights {SCHEMA}")
    index = PostingIndex.write(none)
    assert index.search(asked, 5, 0.01).count() == 0
    assert PostingIndex.open(spark, index.path).shards == 1
