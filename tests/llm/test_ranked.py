"""op12: against plain scoring of every document for every item."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cliplens.llm import packed, ranked
from cliplens.llm.ranked import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    count, words = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: math.floor(1000 * math.log((2 * count + 2) / (2 * n + 1))) for t, n in df.items()}
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, bag in bags:
            m = 100 - 50 + 50 * sum(bag.values()) * count // words
            score = sum(weight[t] * (10 ** 9 * bag[t] // (1000 * bag[t] + 20 * m)) for t in wanted if t in bag)
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **options):
    return sorted([(r["item_id"], r["rank"], r["doc_id"], r["score"])
                   for r in search(docs, items, **options).collect()], key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_equals_plain_scoring(spark, monkeypatch, small):
    if small:  # many shards, groups, blocks of the vocabulary and rounds of merging
        for name, value in dict(SHARD_DOCS=16, GROUP_ITEMS=3, VOCABULARY=25, MERGE=2).items():
            monkeypatch.setattr(ranked, name, value)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Éa", "中文", "x" * 70, "X" * 200]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return " ".join(rng.choices(words, weights, k=n)) + rng.choice(["", ".", "!?", "\n"])

    docs = [(i, text(rng.randrange(0, 60))) for i in range(300)] + [(7, "W1 w2"), (None, "w59 w58"), (301, None)]
    docs += [(400 + i, docs[5][1]) for i in range(120)] + docs[:2]
    items = [(i, text(8)) for i in range(11)] + [(3, "w40"), (None, "w50 w51"), (20, ""), (21, None), (22, "unknown")]
    got = found(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                spark.createDataFrame(items, "item_id bigint, text string"), k=10)
    assert got == brute(docs, items, 10)


def test_edge_rows(spark, edge_docs, edge_rows, no_docs):
    items = spark.createDataFrame([(1, "the quick fox word5", "a"), (2, "CAFé and13 no id", "b")],
                                  "item_id bigint, text string, score string")
    want = [(1, "the quick fox word5"), (2, "CAFé and13 no id")]
    assert found(edge_docs, items) == brute(edge_rows, want, 50)
    assert found(no_docs, items) == []
    assert found(edge_docs, items.where("false")) == []


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", "two"), (None, "one")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r["item_id"], r["doc_id"]) for r in search(docs, items).orderBy("rank").collect()] == [
        ("q", None), ("q", "a")]


def test_runs_of_equal_hashes_are_told_apart():
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    parts = [word, "x", other, word, "x", other]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    starts = ends - [len(p) for p in parts]
    assert packed.run_hashes(data, starts, ends)[0] == packed.run_hashes(data, starts, ends)[2]
    first, back = packed.distinct_runs(data, starts, ends)
    assert len(first) == 3 and back[0] == back[3] and back[2] == back[5] and len({*back[:3].tolist()}) == 3
