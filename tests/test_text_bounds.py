"""Batches of texts and of term lists are worked on in bounded slices."""

import pyarrow as pa

from cliplens.functions import text as X
from cliplens.operators import tfidf


def test_slices_hold_every_row_once():
    rows = pa.array(range(50))
    parts = list(X.sliced(rows, [3] * 25 + [40] + [0] * 24, 10))
    assert [v for p in parts for v in p.to_pylist()] == list(range(50))
    assert len(parts) > 5 and max(map(len, parts[:5])) <= 4
    assert list(X.sliced(rows[:0], [], 10)) == []


def test_terms_are_counted_slice_by_slice(monkeypatch):
    lists = [["a", "b", "a"], None, [], ["c"] * 9, ["b", "a"]] * 4
    batch = pa.record_batch([pa.array(lists, pa.list_(pa.string()))], names=["tokens"])
    whole = tfidf._count_terms(batch.column(0)).to_pylist()
    monkeypatch.setattr(tfidf, "PART_ITEMS", 5)
    parts = list(tfidf._item_parts(batch, "tokens"))
    assert len(parts) > 4 and sum(p.num_rows for p in parts) == len(lists)
    made = [r for p in parts for r in tfidf._count_terms(p.column(0)).to_pylist()]
    assert [{t["term"]: t["tf"] for t in r} for r in made] == [{t["term"]: t["tf"] for t in r} for r in whole]
