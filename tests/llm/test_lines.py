"""op6: chunks of lines against a plain count of their bytes."""

import collections
import random

import pyarrow as pa

from cliplens.llm import lines
from cliplens.llm.lines import dedup_lines, drop_repeated, text_chunks


def brute(rows):
    """Expected (text, lines, removed) of rows with distinct ids in order."""
    chunks = [list(text_chunks(pa.array([t], pa.string())))[0] for _, t in rows]
    seen, out = set(), {}
    for (i, t), mine in zip(rows, chunks):
        if t is None:
            out[i] = (None, 0, 0)
            continue
        data = t.encode()
        all_lines, drop, starts = data.split(b"\n"), set(), [0]
        for line in all_lines:
            starts.append(starts[-1] + len(line) + 1)
        for c in mine:
            body = data[c["start"]:c["end"]]
            if body in seen:
                first = starts.index(c["start"])
                drop |= set(range(first, first + body.count(b"\n") + 1))
            seen.add(body)
        out[i] = (b"\n".join(x for n, x in enumerate(all_lines) if n not in drop).decode(),
                  len(all_lines), len(drop))
    return out


def corpus(n=60):
    rng = random.Random(7)
    passage = [f"This line number {i} is shared by many documents, Ünïcode too" for i in range(12)]
    rows = []
    for i in range(n):
        own = [f"own line {rng.randrange(10 ** 9)} of document {i}" for _ in range(rng.randrange(8))]
        at = rng.randrange(len(own) + 1)
        rows.append((i, "\n".join(own[:at] + (passage if i % 2 else []) + own[at:])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n\n"), (n + 3, "\n\n\n"), (n + 4, rows[5][1])]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["line_dedup"]["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"])
           for r in dedup_lines(docs).collect()}
    assert got == brute(rows)
    assert sum(v[2] for v in got.values()) > 200  # the passage goes from all but one


def test_boundaries_survive_a_shift():
    passage = "\n".join(f"shared line {i}" for i in range(40))
    a = list(text_chunks(pa.array([passage, "new first line\nanother\n" + passage])))
    keys = [{c["key"] for c in mine} for mine in a]
    assert len(keys[0] & keys[1]) >= len(keys[0]) - 2


def test_long_lines_and_bounds():
    text = "a" * (lines.MAX_BYTES + 5) + "\n" + "\n".join(["b" * 9000] * 20)
    data = text.encode()
    for c in list(text_chunks(pa.array([text])))[0]:
        assert c["end"] - c["start"] <= lines.MAX_BYTES and b"a" not in data[c["start"]:c["end"]]


def test_equal_hashes_with_other_bytes_stay(spark, monkeypatch):
    """With one hash for everything only true copies go."""
    import xxhash

    rows = [(1, "p q\nr s"), (2, "p q\nr s"), (3, "other text\nof two lines")]
    monkeypatch.setattr(xxhash, "xxh3_128_digest", lambda data: b"0" * 16)
    monkeypatch.setattr(lines, "_chunk_udf", lambda: _same_key())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in dedup_lines(docs).collect()}
    assert got == {1: "p q\nr s", 2: "", 3: "other text\nof two lines"}


def _same_key():
    from pyspark.sql import functions as F

    return lambda text: F.when(F.lit(True), F.array(F.struct(
        F.lit(0).alias("start"), F.octet_length(text).alias("end"), F.lit(b"0" * 16).alias("key"))))


def test_edges_and_stage(spark, edge_docs, edge_rows, no_docs):
    out = dedup_lines(edge_docs, out="shard").collect()
    assert collections.Counter((r["doc_id"], r["shard"]["text"]) for r in out) == collections.Counter(edge_rows)
    assert dedup_lines(no_docs).count() == 0
    docs = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\nc d"), (3, ""), (4, "z")],
                                 "doc_id bigint, text string")
    assert sorted(map(tuple, drop_repeated(docs).collect())) == [(1, "a b\nc d"), (3, ""), (4, "z")]
