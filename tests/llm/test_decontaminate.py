"""op1: winnowing against a plain search for windows."""

import random
import re

import pytest

from cliplens.llm.decontaminate import decontaminate


def brute(text, items, n=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
                          re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    mine, hit, ids = words(text), set(), set()
    for item_id, item in items:
        own = words(item)
        size = min(n, len(own))
        windows = {tuple(own[i:i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(mine) - size + 1):
            if tuple(mine[i:i + size]) in windows:
                hit |= set(range(i, i + size))
                ids.add(item_id or "")
    return len(mine), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [8 << 20, 300])
def test_equals_brute_force_in_one_block_and_in_many(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(6)] + ["É1", "ß"]
    items = [("a", "W0 w1 w2"), ("b", " ".join(rng.choices(vocabulary, k=40))), ("c", ""), ("d", None),
             ("e", "w1"), (None, "w5 w5 w5 w4"), ("b", " ".join(rng.choices(vocabulary, k=14))),
             ("f", " ".join(["w0"] * 12))]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(150)]
    docs += [(200, items[1][1] + ", tail"), (201, "x-" + items[6][1].replace(" ", ", ")),
             (202, " ".join(["w0"] * 500)), (203, None), (204, ""), (204, "")]
    out = decontaminate(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
        spark.createDataFrame(items, "item_id string, text string"), block_bytes=block_bytes).collect()
    assert len(out) == len(docs)
    for r in out:
        c = r["contamination"]
        assert (c["n_words"], c["n_hit"], c["item_ids"]) == brute(r["text"], items), r["text"]
        assert sum(s["end"] - s["start"] for s in c["spans"]) == c["n_hit"]


def test_edges_empty_tables_and_clashing_names(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog it")],
                                  "item_id int, text string")
    out = {r["doc_id"]: r for r in decontaminate(edge_docs, items, out="shard").collect()}
    assert out[1]["shard"]["n_hit"] == 10 and out[1]["shard"]["item_ids"] == ["1"]
    assert out[2]["shard"]["n_words"] == 0 and out[2]["source"] is not None
    assert decontaminate(no_docs, items).count() == 0
    assert {r["contamination"]["n_hit"] for r in decontaminate(edge_docs, items.where("false")).collect()} == {0}
