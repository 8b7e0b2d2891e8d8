"""op5: held-out accuracy, and what an unreadable text gets."""

import zlib

import numpy as np

from cliplens.llm.language import fit_temperature, identify, softmax, train_ftrl
from cliplens.llm.q_language import op5_language
from tests.conftest import SF


def test_held_out_accuracy(spark):
    rows = op5_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(
        "/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    unseen = [r for r in rows if r["held_out"]]
    right = [r["lang_pred"] == lang[r["doc_id"]] for r in unseen]
    assert np.mean(right) > 0.98
    # Calibrated: the mean score is close to the share that is right.
    assert abs(np.mean([r["score"] for r in unseen]) - np.mean(right)) < 0.03


def test_prediction_ignores_labels_and_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs.selectExpr("NULL AS doc_id", "text", "'xx' AS lang", "source", "n_chars"))
    by_text = {}
    for r in identify(twice).select("text", "language.*").collect():
        by_text.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(found) == 1 for found in by_text.values())


def test_edges(spark, edge_docs, no_docs):
    out = {r["text"]: r["shard"] for r in identify(edge_docs, out="shard").collect()}
    for text in (None, "", " \n\t ", "..."):
        assert out[text]["lang_pred"] == "und" and out[text]["score"] == 0
    assert out["x"]["lang_pred"] == "en" and out["x"]["score"] == 1
    assert identify(no_docs).count() == 0
    unlabelled = edge_docs.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r["language"]["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}


def test_penalty_leaves_rare_features_out_and_temperature_fits():
    rng = np.random.default_rng(1)
    rows = [(np.array([y, 50 + i]), np.array([1.0, 0.05])) for i, y in enumerate(rng.integers(0, 2, 300))]
    labels = np.array([int(r[0][0]) for r in rows])
    weights = train_ftrl(rows, labels, 2, l1=0.1)
    assert (weights[50:350] == 0).mean() > 0.9 and weights[0, 0] > 0 > weights[0, 1]
    logits = rng.normal(size=(4000, 3)) * 2
    drawn = np.array([rng.choice(3, p=p) for p in softmax(logits / 3.0)])
    assert abs(fit_temperature(logits, drawn) - 3.0) < 0.4
