"""Latent vectors against a singular value decomposition by numpy."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliplens.operators import latent, tfidf
from cliplens.plans import retrieval
from tests.conftest import SF


def tokens():
    return F.regexp_extract_all(F.coalesce("title", F.lit("")), F.lit("[a-z]+"), F.lit(0))


def plain(texts, rank):
    """Right and left singular vectors, values; terms in order, all terms known."""
    counts = [Counter(re.findall("[a-z]+", t or "")) for t in texts]
    terms = sorted(set().union(*counts))
    df = Counter(t for c in counts for t in c)
    a = np.array([[c[t] * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t in terms] for c in counts])
    length = np.sqrt((a * a).sum(1, keepdims=True))
    a = np.divide(a, length, out=np.zeros_like(a), where=length > 0)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    return a, s[:rank], vt[:rank].T


def texts(n=160, seed=4):
    rng = np.random.default_rng(seed)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(120)]
    made = []
    for i in range(n):
        topic = i % 6
        made.append(" ".join(words[(topic * 20 + int(k)) % 120] for k in rng.geometric(0.08, 25)))
    return made + [None, "", "123"] + made[:10]


def fit(spark, rows, rank, **how):
    docs = spark.createDataFrame(list(enumerate(rows)), "id long, title string").repartition(5)
    counts = tfidf.counted(docs, ["id"], tokens())
    return latent.LatentModel.fit(counts, "id", rank, **how), counts


@pytest.mark.parametrize("entries, cut", [(latent.ENTRIES, latent.SLICE), (40, 7)])
def test_equals_plain_svd(spark, monkeypatch, entries, cut):
    monkeypatch.setattr(latent, "ENTRIES", entries)
    monkeypatch.setattr(latent, "SLICE", cut)
    rows, rank = texts(), 8
    a, s, v = plain(rows, rank)
    model, counts = fit(spark, rows, rank, tol=1e-10)
    assert model.residuals.max() <= 1e-10 and np.allclose(model.values, s, atol=1e-8)
    assert np.allclose(np.abs((model.places * v).sum(0)), 1, atol=1e-6)
    got = {r["id"]: np.array(r["embedding"]) for r in model.vectors(counts, "id").collect()}
    want = a @ (v * np.sign((model.places * v).sum(0)))
    for i, row in enumerate(want):
        length = np.linalg.norm(row)
        assert np.allclose(got[i], row / length if length else 0, atol=1e-5)
    assert not got[160].any() and np.allclose(got[0], got[163], atol=1e-12)


def test_opened_model_is_the_same_and_knows_unseen_texts(spark):
    model, counts = fit(spark, texts(), 5)
    again = latent.LatentModel.open(spark, model.path)
    assert np.array_equal(again.places, model.places) and again.idf == model.idf
    other = tfidf.counted(spark.createDataFrame([(1, model.terms[0]), (2, "neverseen")], "id long, title string"),
                          ["id"], tokens())
    got = {r["id"]: np.array(r["embedding"]) for r in again.vectors(other, "id").collect()}
    place = model.places[0]
    assert np.allclose(got[1], place / np.linalg.norm(place)) and not got[2].any()


def test_fewer_dimensions_than_asked(spark):
    model, counts = fit(spark, ["a b", "a b", "b c", "a a c"], 64)
    _, s, _ = plain(["a b", "a b", "b c", "a a c"], 3)
    assert np.allclose(model.values, s[s > 1e-9])
    assert all(len(r["embedding"]) == len(model.values) for r in model.vectors(counts, "id").collect())


@pytest.mark.parametrize("rows", [[], [None, ""]])
def test_no_terms(spark, rows):
    model, counts = fit(spark, rows, 4)
    assert [r["embedding"] for r in model.vectors(counts, "id").collect()] == [[]] * len(rows)


def test_too_few_passes_show_in_the_residuals(spark):
    rough, _ = fit(spark, texts(), 8, max_passes=1)
    assert rough.residuals.max() > 1e-6


def test_latent_search_by_plain_distances(spark):
    """The registered query against squared distances of all pairs."""
    rows = retrieval.latent_search(spark, SF).collect()
    corpus, asked = retrieval._latent_sides(spark, SF)
    vectors = {r["video_id"]: np.array(r["embedding"]) for r in corpus.collect()}
    titles = {r["video_id"]: r["title"] for r in retrieval.videos(spark, SF, "video_id", "title").collect()}
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    want: dict = {}
    for r in asked.collect():
        d = np.round(((x - np.array(r["embedding"])) ** 2).sum(1), 9)
        for at in np.lexsort((ids, d))[:10]:
            key = (r["query_id"], titles[ids[at]])
            want[key] = max(want.get(key, 0.0), 1 / (1 + d[at]))
    got = {}
    for r in rows:
        got[r["query_id"], titles[r["video_id"]]] = r["score"]
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-5


@pytest.mark.parametrize("entries, most", [(40, 3), (40, 1000), (16_384, 128)])
def test_blocks_hold_every_weight_once(monkeypatch, entries, most):
    """Small blocks together are the matrix, whatever the lengths, and none is larger than its bounds."""
    monkeypatch.setattr(latent, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(latent, "BLOCK_DOCS", most)
    places, dense = placed()
    gram, docs = np.zeros((90, 90)), 0
    for n, used, cells, weights in latent._blocks(pa.RecordBatch.from_arrays([places], names=["places"])):
        some = np.zeros((n, len(used)))
        some.ravel()[cells] = weights
        gram[np.ix_(used, used)] += some.T @ some
        docs += n
        assert n <= most and len(weights) <= entries + 90
    assert np.array_equal(gram, dense.T @ dense) and docs == 61


@pytest.mark.parametrize("pool", [60, 1 << 20])
def test_a_pass_over_blocks_is_the_plain_product(spark, monkeypatch, pool):
    monkeypatch.setattr(latent, "POOL_ENTRIES", pool)
    places, dense = placed()
    rows = spark.createDataFrame([(p and [(v["slot"], v["weight"]) for v in p],) for p in places.to_pylist()],
                                 f"places {latent.PLACES}").repartition(3)
    x = np.random.default_rng(1).normal(size=(90, 4))
    assert np.allclose(latent._gram_times(latent.blocked(rows), x), dense.T @ (dense @ x))


def placed():
    """Placed weights of documents with none to all of 90 terms, and the same as a plain matrix."""
    rng = np.random.default_rng(6)
    rows = [[], None, *[rng.choice(90, n, replace=False).tolist() for n in [90, *rng.integers(1, 30, 60)]], []]
    dense = np.zeros((len(rows), 90))
    for i, slots in enumerate(rows):
        dense[i, slots or []] = 1 + i + np.arange(len(slots or []))
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("weight", pa.float64())]))
    return pa.array([None if s is None else [{"slot": j, "weight": dense[i, j]} for j in s]
                     for i, s in enumerate(rows)], kind), dense
