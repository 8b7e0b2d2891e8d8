"""SimHash names candidates of the near-dedup stage by itself, before the exact comparison."""

import numpy as np
from pyspark.sql import functions as F

from cliplens.llm import similar
from tests.llm.test_similar import jaccard, planted, shingles


def test_fingerprint_of_a_set():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 20_001, dtype=np.uint64) * np.uint64(2)
    ones = [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
    assert similar._fingerprint(hashes) == sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def test_fingerprints_within_three_bits_share_a_table():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = near = int(rng.integers(0, 1 << 63)) * 2
        for bit in rng.choice(64, 3, replace=False):
            near ^= 1 << int(bit)
        assert np.isin(similar._tables(a), similar._tables(near)).any()
        assert not np.isin(similar._tables(a), similar._tables(a ^ (2 ** 64 - 1))).any()
    assert len(np.unique(similar._tables(0))) == 10


def test_pairs_that_only_fingerprints_bring_together(spark):
    rows, _ = planted()
    docs = spark.createDataFrame(rows, "id long, text string")
    unique = docs.select("id", similar._sketch_udf(5)(F.col("text")).alias("s"),
                         similar._set_udf(5)(F.col("text")).alias("hashes")).select("id", "s.*", "hashes").localCheckpoint()
    held = {r["id"]: r for r in unique.collect()}
    name = {bytes(r["node"]): i for i, r in held.items()}
    keyed = unique.select("node", "size", F.posexplode("bands").alias("band", "key")).where(f"band >= {similar.BANDS}")
    shared = keyed.groupBy("key").agg(F.count_distinct("node").alias("n")).where("n > 1")
    links = {tuple(sorted((name[bytes(r["u"])] // 2, name[bytes(r["v"])] // 2))) for r in similar.link_similar(
        keyed.join(shared.select("key"), "key"), unique.select("node", "hashes").dropDuplicates(["node"]), 0.8).collect()}
    text, want = dict(rows), set()
    for i in range(0, len(rows), 2):
        a, b = (similar._fingerprint(np.frombuffer(held[j]["hashes"], np.uint64)) for j in (i, i + 1))
        alike = jaccard(shingles(text[i]), shingles(text[i + 1]))
        if held[i]["node"] != held[i + 1]["node"] and (a ^ b).bit_count() <= 3 and alike >= 0.8:
            want.add((i // 2, i // 2))
    assert len(want) > 5 and want <= links
    assert all(a == b and jaccard(shingles(text[2 * a]), shingles(text[2 * a + 1])) >= 0.8 for a, b in links)
