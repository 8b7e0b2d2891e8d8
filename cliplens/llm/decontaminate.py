"""Benchmark decontamination by winnowing.

Test items and documents are cut into words. Of every window of ``w``
consecutive k-grams the one with the smallest hash is its fingerprint, on both
sides alike, so any span of ``k + w - 1`` words that a document shares with an
item has a fingerprint in common. Document fingerprints are joined to those of
the items, each joined hit is extended to the windows around it, and a window
counts only after its words have been compared byte by byte.

Nothing about a document is shuffled: a block of items of bounded size is sent
to the tasks that read the documents. A test set larger than one block takes
one pass for each block, whose spans are merged in the row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.llm import packed

BLOCK_BYTES = 8 << 20
CONTAMINATION = ("struct<n_words:bigint,n_hit:bigint,"
                 "spans:array<struct<start:bigint,end:bigint>>,item_ids:array<string>>")
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
# Words are runs of digits, letters a-z and everything beyond ASCII.
_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


class Words:
    """The words of some texts: byte bounds, hashes and owners."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = packed.ascii_lower(data)
        self.starts, self.ends = packed.cut_runs(_WORD[self.data], offsets)
        self.hashes = packed.run_hashes(self.data, self.starts, self.ends)
        self.text = packed.owners(self.starts, offsets)
        self.first = np.searchsorted(self.starts, offsets)  # of each text, in words

    def span(self, first: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(
            self.starts[first:first + n], self.ends[first:first + n]))

    def windows(self, n: int) -> np.ndarray:
        """Where n consecutive words of one text begin."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        return at[self.text[at] == self.text[at + n - 1]] if len(at) else at


def split(n: int) -> tuple[int, int]:
    """k and w with k + w - 1 = n: every shared span of n words shares a fingerprint."""
    k = (n + 1) // 2
    return k, n - k + 1


def winnow(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of all windows of n words.

    Of equal smallest hashes the rightmost is taken.
    """
    k, w = split(n)
    windows = words.windows(n)
    if not len(windows):
        return windows, np.empty(0, np.uint64)
    grams = packed.sequence_hashes(words.hashes, np.arange(len(words.hashes) - k + 1), k)
    best, at = grams[windows], windows.copy()
    for i in range(1, w):
        other = grams[windows + i]
        take = other <= best
        best[take] = other[take]
        at[take] = windows[take] + i
    at = np.unique(at)
    return at, grams[at]


class Items:
    """Fingerprints and windows of one block of test items."""

    def __init__(self, rows: list[tuple[str | None, str | None]], n: int):
        texts = pa.array([text for _, text in rows], pa.string())
        words = Words(*packed.text_bytes(texts))
        counts = np.diff(words.first)
        self.levels: dict[int, tuple] = {}
        for level in sorted({int(min(c, n)) for c in counts if c}):
            mine = counts >= n if level == n else counts == level
            at, prints = winnow(words, level)
            prints = np.unique(prints[mine[words.text[at]]])
            windows = words.windows(level)
            windows = windows[mine[words.text[windows]]]
            found: dict[bytes, set] = {}
            hashes: dict[bytes, int] = {}
            for first, h in zip(windows.tolist(), packed.sequence_hashes(
                    words.hashes, windows, level).tolist()):
                key = words.span(first, level)
                found.setdefault(key, set()).add(rows[words.text[first]][0] or "")
                hashes[key] = h
            keys = sorted(found, key=lambda key: hashes[key])
            self.levels[level] = (
                prints, np.array([hashes[key] for key in keys], np.uint64), keys,
                [sorted(found[key]) for key in keys])


def _hits(words: Words, items: Items) -> Iterator[tuple[int, int, list[str]]]:
    """(first word, words, items) of every window of an item that a text holds."""
    for level, (prints, hashes, keys, ids) in items.levels.items():
        at, found = winnow(words, level)
        at = at[packed.is_member(found, prints)[0]]
        if not len(at):
            continue
        _, w = split(level)
        around = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
        around = around[(around >= 0) & (around + level <= len(words.starts))]
        around = around[words.text[around] == words.text[around + level - 1]]
        window = packed.sequence_hashes(words.hashes, around, level)
        same, _ = packed.is_member(window, hashes)
        for first, h in zip(around[same].tolist(), window[same]):
            text = words.span(first, level)
            # Different windows of equal hash lie side by side.
            i = int(np.searchsorted(hashes, h))
            while i < len(keys) and hashes[i] == h:
                if keys[i] == text:
                    yield first, level, ids[i]
                i += 1


def _judge(texts: pa.Array, before: pa.Array, items: Items) -> pa.Array:
    data, offsets = packed.text_bytes(texts)
    earlier = before.to_pylist()
    n_words, n_hit, spans, ids = [], [], [], []
    for lo, hi in packed.chunks(offsets):
        words = Words(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        total = len(words.starts)
        change = np.zeros(total + 1, np.int64)
        named: dict[int, set] = {}
        for first, n, found in _hits(words, items):
            change[first] += 1
            change[first + n] -= 1
            named.setdefault(int(words.text[first]), set()).update(found)
        for i in range(lo, hi):
            for span in (earlier[i] or {}).get("spans", ()):
                base = words.first[i - lo]
                change[base + span["start"]] += 1
                change[base + span["end"]] -= 1
        covered = np.cumsum(change[:-1]) > 0
        a, b = packed.cut_runs(covered, words.first)
        text = packed.owners(a, words.first)
        counts = np.diff(words.first)
        where = np.searchsorted(text, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            old = set((earlier[lo + i] or {}).get("item_ids", ()))
            mine = slice(where[i], where[i + 1])
            base = words.first[i]
            n_words.append(int(counts[i]))
            n_hit.append(int((b[mine] - a[mine]).sum()))
            spans.append([{"start": s, "end": e} for s, e in zip(
                (a[mine] - base).tolist(), (b[mine] - base).tolist())])
            ids.append(sorted(old | named.get(i, set())))
    return pa.StructArray.from_arrays(
        [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
         pa.array(spans, pa.list_(_SPAN)), pa.array(ids, pa.list_(pa.string()))],
        names=["n_words", "n_hit", "spans", "item_ids"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  out: str = "contamination", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: words, hit words, hit spans (in words) and item ids.

    Words are compared with A-Z in lower case. A hit is any occurrence of
    ``window`` consecutive words of an item, or of a whole item that has fewer.

    NULL and empty texts have no words and no hits; items without words hit
    nothing. Items of equal id count as one, with the windows of all their
    rows; an item without id counts as the id "". Repeated documents are each
    judged alike. An empty benchmark leaves every document clean; an empty
    table stays empty. An existing column named ``out`` is replaced, all others
    are kept.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("id"), F.col(item_text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    result = docs.withColumn(out, F.lit(None).cast(CONTAMINATION))
    for b in range(blocks):
        rows = [(r["id"], r["text"]) for r in items.where(block == b).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(Items(rows, window))
        result = result.withColumn(out, _judge_udf(shared)(F.col(text_col), F.col(out)))
    return result


def _judge_udf(shared):
    def judge(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, before in parts:
            yield _judge(texts, before, shared.value)

    # Nondeterministic only in name: a filter on its result must not run it twice.
    return F.arrow_udf(judge, CONTAMINATION).asNondeterministic()
