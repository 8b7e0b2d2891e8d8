"""op11: against a tree built level by level in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from cliplens.llm.merkle import DIGEST, folded, merkle_proofs

FIELDS = ["doc_id", "source", "lang", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """Root, and the siblings of each leaf from the bottom up."""
    proofs, of = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(of):
            run = range(at // 8 * 8, min(len(nodes), at // 8 * 8 + 8))
            proofs[i].append([nodes[j] for j in run if j != at])
        nodes = [h(*nodes[i:i + 8]) for i in range(0, len(nodes), 8)]
        of = [at // 8 for at in of]
    return nodes[0], proofs


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof text) of rows (id, source, lang, text)."""
    groups = {}
    for row in rows:
        groups.setdefault(("1" + row[2]).encode() if row[2] is not None else b"0", []).append((row[0], leaf(row)))
    for key in groups:
        groups[key].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    done = {key: tree([d for _, d in g]) for key, g in groups.items()}
    root, above = tree([done[key][0] for key in sorted(done)])
    out = []
    for at, key in enumerate(sorted(done)):
        subroot, proofs = done[key]
        for (i, d), proof in zip(groups[key], proofs):
            out.append((i, d, subroot, root, "".join(sum(proof + above[at], []))))
    return sorted(out, key=repr)


def found(docs, **options):
    rows = merkle_proofs(docs, FIELDS, **options).withColumn(
        "f", folded(F.col("leaf"), F.col("places"), F.col("siblings"))).collect()
    assert all(r["f"]["root"] == r["root"] for r in rows)
    assert all(len(s) % DIGEST == 0 and p <= len(s) // DIGEST for r in rows
               for p, s in zip(r["places"], r["siblings"]))
    return sorted([(r["doc_id"], r["leaf"].hex(), r["subroot"].hex(), r["root"].hex(),
                    b"".join(r["siblings"]).hex()) for r in rows], key=repr)


def test_edge_rows_and_clashing_columns(spark, edge_docs, no_docs):
    docs = edge_docs.withColumns({"tree": F.lit("x"), "idx": F.lit(3), "n": F.lit(1), "leaf": F.lit("l"),
                                  "lang": F.when(F.col("doc_id") > 4, F.col("lang"))})
    rows = [tuple(r) for r in docs.select(*FIELDS).collect()]
    assert found(docs) == brute(rows)
    assert merkle_proofs(no_docs, FIELDS).count() == 0
    one = docs.where("doc_id = 1")
    (alone,) = found(one)
    assert alone[1] == alone[2] == alone[3] and alone[4] == ""


@pytest.mark.parametrize("height", [1, 3])
def test_many_rounds(spark, height):
    langs = [None, "", "de", "en", "éé", "zz"] + [f"l{i:02}" for i in range(70)]
    rows = [(i, f"s{i % 3}", langs[min(i % 90, 75) if i % 2 else 3], f"text {i}" if i % 7 else None)
            for i in range(1400)]
    rows += rows[:20]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string").repartition(7)
    assert found(docs, height=height) == brute(rows)


def test_tampering_shows(spark):
    rows = [(i, "s", "en", "Text" if i % 2 else "text") for i in range(100)] + [(100, "s", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    got = merkle_proofs(docs, FIELDS, altered=F.col("doc_id") % 5 == 0, lowered="text").withColumn(
        "f", folded(F.coalesce("altered", "leaf"), F.col("places"), F.col("siblings")))
    for r in got.collect():
        changed = r["doc_id"] % 5 == 0 and r["doc_id"] % 2 == 1
        assert (r["f"]["root"] == r["root"]) != changed
        assert (r["altered"] is not None) == (r["doc_id"] % 5 == 0)
