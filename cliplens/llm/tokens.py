"""Token counts by a map-side lookup of two tiers.

Tier one is a compact open-addressing table of the frequent pre-tokens and
their lengths in tokens, broadcast once. Tier two are the misses: each worker
encodes a pre-token it has not met and keeps the answer. No pre-token is ever
shuffled; what the first pass gathers to fill the table are summaries of
bounded size, one for each task, over all documents. The table is a cache: which
pre-tokens it holds changes the speed and never a count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.llm import charclass, packed
from cliplens.session import materialize

TABLE_SHARES = 1 << 18
TASK_SIZE = 1 << 15
MAX_PIECE = 64
CACHE_SIZE, CACHED_CHARS = 400_000, 256
_WORKER: dict[str, Tokens] = {}


class LengthTable:
    """Pre-tokens to their numbers of tokens, in flat arrays.

    Open addressing by hash; a hit counts only if the characters are the same.
    """

    def __init__(self, pieces: list[str], lengths: np.ndarray):
        self.data, offsets = charclass.code_points(pieces)
        self.starts, self.ends, self.lengths = offsets[:-1], offsets[1:], np.asarray(lengths, np.int64)
        hashes = packed.run_hashes(self.data, self.starts, self.ends)
        bits = max(4, int(2 * len(pieces)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.entry = np.full(1 << bits, -1, np.int32)
        self.reach = 1
        for i, h in enumerate(hashes.tolist()):
            slot, step = h >> (64 - bits), 1
            while self.entry[slot] >= 0 and self.keys[slot] != h:
                slot, step = (slot + 1) & self.mask, step + 1
            self.keys[slot], self.entry[slot] = h, i
            self.reach = max(self.reach, step)

    def get(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Lengths of the runs ``data[start:end]``, -1 where the table has none."""
        slot = (hashes >> self.shift).astype(np.int64)
        found = np.where(self.keys[slot] == hashes, self.entry[slot], -1)
        for _ in range(1, self.reach):
            left = np.flatnonzero((found < 0) & (self.entry[slot] >= 0))
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            at = slot[left]
            found[left] = np.where(self.keys[at] == hashes[left], self.entry[at], -1)
        out = np.full(len(hashes), -1, np.int64)
        hit = np.flatnonzero(found >= 0)
        entry = found[hit]
        hit_is = packed.same_runs(data, starts[hit], ends[hit], self.data, self.starts[entry], self.ends[entry])
        out[hit[hit_is]] = self.lengths[entry[hit_is]]
        return out


class Tokens:
    """One worker's tokenizer with its cache of pre-token lengths."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    @classmethod
    def of(cls, spec: str) -> Tokens:
        if spec not in _WORKER:
            _WORKER.clear()
            _WORKER[spec] = cls(spec)
        return _WORKER[spec]

    def lengths(self, pieces: list[str]) -> np.ndarray:
        """Lengths of pre-tokens; those met lately are kept, if they are not long."""
        out, new = [], []
        for i, piece in enumerate(pieces):
            n = self.young.get(piece)
            if n is None and (n := self.old.get(piece)) is not None:
                self.young[piece] = n
            if n is None:
                new.append(i)
            out.append(n)
        for i, n in zip(new, self.encode([pieces[i] for i in new])):
            out[i] = n
            if len(pieces[i]) <= CACHED_CHARS:
                self.young[pieces[i]] = n
        if len(self.young) > CACHE_SIZE:  # forget what has not been asked for lately
            self.old, self.young = self.young, {}
        return np.array(out, np.int64)

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


def _cut(texts: list[str], table: np.ndarray):
    """Groups of whole texts: (range, code points, text offsets, starts, ends, hashes)."""
    for lo, hi in charclass.groups_of(texts):
        data, offsets = charclass.code_points(texts[lo:hi])
        starts, ends = charclass.byte_level_tokens(data, offsets, table)
        yield lo, hi, data, offsets, starts, ends, packed.run_hashes(data, starts, ends)


def _frequent_udf(shared):
    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, specials = shared.value
        seen: Counter[str] = Counter()
        for batch in batches:
            parts, _, _ = charclass.segments(batch.column(0).to_pylist(), specials)
            for _, _, data, _, starts, ends, hashes in _cut(parts, table):
                at, back = packed.distinct_runs(data, starts, ends, hashes)
                n = np.bincount(back, minlength=len(at))
                often = (n >= 3) & (ends[at] - starts[at] <= MAX_PIECE)
                for i, count in zip(at[often].tolist(), n[often].tolist()):
                    seen[charclass.string_at(data, starts[i], ends[i])] += count
            if len(seen) > 8 * TASK_SIZE:
                seen = Counter(dict(seen.most_common(4 * TASK_SIZE)))
        top = seen.most_common(TASK_SIZE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
            names=["piece", "n"])

    return frequent


def _count_udf(shared, spec):
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (table, specials), (text, lookup) = shared.value, spec.value
        worker = Tokens.of(text)
        for texts in parts:
            strings, owner, after = charclass.segments(texts.to_pylist(), specials)
            total = np.zeros(len(texts), np.int64)
            np.add.at(total, owner, np.array([bool(s) for s in after], np.int64))
            for lo, _, data, offsets, starts, ends, hashes in _cut(strings, table):
                at, back = packed.distinct_runs(data, starts, ends, hashes)
                n = lookup.get(hashes[at], data, starts[at], ends[at])
                missed = np.flatnonzero(n < 0)
                n[missed] = worker.lengths([charclass.string_at(data, starts[i], ends[i])
                                            for i in at[missed].tolist()])
                of = owner[lo + packed.owners(starts, offsets)]
                total += np.bincount(of, n[back], len(total)).astype(np.int64)
            yield pa.array(total, pa.int64())

    return F.arrow_udf(count, "bigint").asNondeterministic()


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
                 out: str = "n_tokens", table_shares: int = TABLE_SHARES) -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    The tokenizer is a byte-level BPE file. Counts are those of encoding without
    added special tokens, truncation or padding; special strings inside a text
    are one token each, as the tokenizer has them by default.

    The table takes the pre-tokens that make up at least one of ``table_shares``
    parts of all those gathered, so it cannot have more entries than that.

    NULL counts as the empty text and has no tokens. Very long texts are
    counted whole. Repeated rows are counted alike, an empty table stays empty,
    and an existing column named ``out`` is replaced. Pre-tokens are grouped by a
    hash and compared whole, in the table as well.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    tokenizer = Tokenizer.from_str(spec)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((charclass.class_table(tokenizer.pre_tokenizer), specials))
    pieces = docs.select(F.col(text_col).alias("text")).mapInArrow(
        _frequent_udf(shared), "piece string, n bigint")
    sums = materialize(pieces.groupBy("piece").agg(F.sum("n").alias("n")), "pre-tokens")
    total = sums.agg(F.sum("n").alias("n")).first()["n"] or 0
    top = [r["piece"] for r in sums.where(F.col("n") * table_shares >= total).select("piece").collect()]
    lookup = LengthTable(top, np.array(Tokens(spec).encode(top), np.int64))
    counted = _count_udf(shared, context.broadcast((spec, lookup)))
    return docs.withColumn(out, counted(F.col(text_col)))
