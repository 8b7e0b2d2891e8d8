"""op7: fingerprints and components against all pairs on small tables."""

import random
import re

import numpy as np
import xxhash

from cliplens.llm import simhash
from cliplens.llm.simhash import fingerprints, keep_one, link_fingerprints, near_duplicates
from cliplens.operators.components import connected_components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, distance=3):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in values:
        for b in values:
            if a < b and (a ^ b).bit_count() <= distance and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_the_definition(edge_docs, no_docs):
    out = fingerprints(edge_docs, out="shard").collect()
    for r in out:
        assert r["shard"] == signed(plain_fingerprint(r["text"]))
    assert fingerprints(no_docs).count() == 0


def test_links_keep_components_with_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 8)
    rng = random.Random(4)
    values = {rng.getrandbits(64) for _ in range(60)}
    for seed in list(values)[:8]:
        chain = seed
        for _ in range(25):  # each step flips one to four bits, so some chains break
            for _ in range(rng.randrange(1, 5)):
                chain ^= 1 << rng.randrange(64)
            values.add(chain)
    values |= {0, 1, 3, 7, (1 << 64) - 1, (1 << 64) - 2}
    unique = spark.createDataFrame([(signed(v),) for v in values], "fingerprint bigint")
    roots = {r["id"]: r["root"] for r in connected_components(link_fingerprints(unique)).collect()}
    want = components(values)
    groups, mine = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        mine.setdefault(roots.get(signed(v), signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_and_survivors(spark, edge_docs, edge_rows, no_docs):
    base = " ".join(f"t{i}" for i in range(400))
    rows = edge_rows + [(20, base), (21, base.replace("t7 ", "t8 ")), (22, base.upper()), (19, base)]
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = components(set(prints))
    least = {}
    for (i, _), p in zip(rows, prints):
        least.setdefault(roots[p], set()).add(i)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = near_duplicates(docs).collect()
    assert len(out) == len(rows)
    want = sorted((str(i), signed(p), str(min((x for x in least[roots[p]] if x is not None), default=None)))
                  for (i, _), p in zip(rows, prints))
    assert sorted((str(r[0]), r[1], str(r[2])) for r in out) == want
    kept = keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    own = {}
    for i, t in edge_rows:
        own.setdefault(components(set(map(plain_fingerprint, (t for _, t in edge_rows))))[
            plain_fingerprint(t)], []).append(i)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(min((x for x in ids if x is not None), default=None)) for ids in own.values())
    assert keep_one(no_docs).count() == 0 and near_duplicates(no_docs).count() == 0


def test_forest_spans_what_all_pairs_link():
    rng = np.random.default_rng(0)
    prints = np.unique(rng.integers(0, 1 << 12, 60, dtype=np.uint64))
    u, v = simhash._forest(prints, 2)
    assert len(u) < len(prints)
    assert all((int(a) ^ int(b)).bit_count() <= 2 for a, b in zip(u, v))
    want = components({int(p) for p in prints}, 2)
    assert len(prints) - len(u) == len(set(want.values()))
