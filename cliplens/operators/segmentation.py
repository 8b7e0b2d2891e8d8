"""Word segmentation of Han runs over a dictionary.

The dictionary is a double-array trie: two flat arrays that are broadcast once
and walked for all characters of a batch at the same time. Every run becomes a
graph of the dictionary's words, and its segmentation is the most probable path
(the largest sum of log frequencies; of equal ones the path whose first word is
longer). Neighbouring single characters on that path are an unknown run, which
a hidden Markov model of word beginnings, middles, ends and single characters
cuts again by its most probable states. All runs of a batch go through both
dynamic programs together, position by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliplens.functions.text import HAN_CLASS, WORD_RUN
from cliplens.session import materialize

WORD_SHARES = 1 << 20
MAX_WORD = 8
PART_CHARS, PART_BYTES = 1 << 17, 1 << 20  # what is cut at a time, of runs and of a batch's rows
_BEGIN, _MIDDLE, _END, _SINGLE = range(4)


def learned_words(runs: DataFrame, max_chars: int = MAX_WORD, min_count: int = 2,
                  shares: int = WORD_SHARES) -> DataFrame:
    """(word, n): the runs of a table (run) that are short and frequent enough to be words.

    A word makes up at least one of ``shares`` parts of all runs, so there are
    no more words than that at any size. NULL and empty runs are none.
    """
    counts = materialize(runs.where(F.length("run") > 0).groupBy(F.col("run").alias("word")).agg(
        F.count("*").alias("n")), "run-counts")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    return counts.where((F.length("word") <= max_chars) & (F.col("n") >= min_count)
                        & (F.col("n") * shares >= total))


class Dictionary:
    """Words with their counts as a double-array trie, and the model of unknown runs.

    Node ``v`` of the trie has the child ``base[v] + c`` for the character code
    ``c`` if ``check`` of that place is ``v``.
    """

    def __init__(self, words: dict[str, int]):
        words = {w: n for w, n in words.items() if w and n > 0}
        self.alphabet = np.array(sorted({ord(c) for w in words for c in w}), np.uint32)
        self.total = float(np.log(max(1, sum(words.values()))))
        self.longest = max(map(len, words), default=1)
        self._build(sorted((self.codes(np.array([ord(c) for c in w], np.uint32)).tolist(), n)
                           for w, n in words.items()))
        self._model(words)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Character codes from 1 on; 0 is a character of no word."""
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        known = self.alphabet[at] == points if len(self.alphabet) else np.zeros(len(points), bool)
        return np.where(known, at + 1, 0)

    def _build(self, words: list[tuple[list[int], int]]) -> None:
        size = 1 << 10
        base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
        score = np.full(size, -np.inf)
        check[0] = 0
        jump = list(range(size + 1))  # from a taken place towards the next free one
        level, depth = [(0, 0, len(words))], 0
        begin_at: dict[int, int] = {}  # by number of children: places before are mostly taken
        while level:
            below = []
            for node, lo, hi in level:
                if hi > lo and depth and len(words[lo][0]) == depth:
                    score[node] = np.log(words[lo][1]) - self.total
                    lo += 1
                cuts, at = [], lo
                while at < hi:
                    code, begin = words[at][0][depth], at
                    while at < hi and words[at][0][depth] == code:
                        at += 1
                    cuts.append((code, begin, at))
                if not cuts:
                    continue
                children = np.array([c for c, _, _ in cuts])
                slot = self._free(jump, max(1 + int(children[0]), begin_at.get(len(cuts), 0)))
                while True:
                    place = slot - int(children[0])
                    while place + children[-1] >= size:
                        base, check, score = (np.concatenate([a, np.full(size, fill, a.dtype)]) for a, fill in (
                            (base, 0), (check, -1), (score, -np.inf)))
                        jump.extend(range(size + 1, 2 * size + 1))
                        size *= 2
                    if (check[place + children] < 0).all():
                        break
                    slot = self._free(jump, slot + 1)
                if len(cuts) > 1:
                    begin_at[len(cuts)] = slot
                for slot in (place + children).tolist():
                    jump[slot] = slot + 1
                base[node] = place
                check[place + children] = node
                below += [(place + c, b, e) for c, b, e in cuts]
            level, depth = below, depth + 1
        # Any code may be asked for at any node without leaving the arrays.
        room = len(self.alphabet) + 1
        self.base = base
        self.check = np.concatenate([check, np.full(room, -1, np.int64)])
        self.score = np.concatenate([score, np.full(room, -np.inf)])

    @staticmethod
    def _free(jump: list[int], at: int) -> int:
        """The first free place from ``at`` on; shortens the way for the next search."""
        if at >= len(jump):
            return at
        end = at
        while end < len(jump) and jump[end] != end:
            end = jump[end]
        while at < len(jump) and jump[at] != at:
            jump[at], at = end, jump[at]
        return end

    def _model(self, words: dict[str, int]) -> None:
        """Log probabilities of states from one character to the next and of characters by state."""
        single = sum(n for w, n in words.items() if len(w) == 1)
        longer = [(w, n) for w, n in words.items() if len(w) > 1]
        begun = sum(n for _, n in longer)
        middles = sum(n * (len(w) - 2) for w, n in longer)
        inner = sum(n * max(0, len(w) - 3) for w, n in longer)
        with_middle = sum(n for w, n in longer if len(w) > 2)
        p_begin = (begun + 1) / (begun + single + 2)
        p_middle = (with_middle + 1) / (begun + 2)
        p_more = (inner + 1) / (middles + 2)
        move = np.zeros((4, 4))
        move[_BEGIN, _MIDDLE], move[_BEGIN, _END] = p_middle, 1 - p_middle
        move[_MIDDLE, _MIDDLE], move[_MIDDLE, _END] = p_more, 1 - p_more
        for state in (_END, _SINGLE):
            move[state, _BEGIN], move[state, _SINGLE] = p_begin, 1 - p_begin
        emit = np.ones((4, len(self.alphabet) + 1))
        for word, n in words.items():
            codes = self.codes(np.array([ord(c) for c in word], np.uint32))
            states = [_SINGLE] if len(codes) == 1 else [_BEGIN, *[_MIDDLE] * (len(codes) - 2), _END]
            np.add.at(emit, (states, codes), n)
        with np.errstate(divide="ignore"):
            self.move = np.log(move)
            self.start = np.log(np.array([p_begin, 0, 0, 1 - p_begin]))
            self.emit = np.log(emit / emit.sum(1, keepdims=True))

    def matches(self, codes: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Score of the word of each length (row) from each character on, -inf if there is none."""
        out = np.full((self.longest, len(codes)), -np.inf)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        for n in range(self.longest):
            keep = room[at] > n
            at, node = at[keep], node[keep]
            code = codes[at + n]
            child = self.base[node] + code
            real = (code > 0) & (self.check[child] == node) & (child > 0)
            at, node = at[real], child[real]
            out[n, at] = self.score[node]
            if not len(at):
                break
        return out

    def cuts(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where words begin, as a mask; runs lie side by side and cover all points."""
        begins = np.zeros(len(points), bool)
        if not len(points):
            return begins
        codes = self.codes(points)
        room = np.repeat(ends, ends - starts) - np.arange(len(points))
        found = self.matches(codes, room)
        found[0] = np.maximum(found[0], -self.total)  # an unknown character counts as met once
        step = self._route(found, starts, ends)
        at = starts.copy()
        while len(at):
            begins[at] = True
            at = at + step[at]
            at = at[at < len(points)]
            at = at[~begins[at]]
        self._unknown(codes, begins, step, starts, ends)
        return begins

    def _route(self, found: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Length of the word that the best path takes at each character."""
        best = np.zeros(found.shape[1] + 1)
        step = np.ones(found.shape[1], np.int64)
        order = np.argsort(starts - ends, kind="stable")  # longest first
        ends, shorter = ends[order], (starts - ends)[order]
        for t in range(1, -int(shorter[0]) + 1):
            at = ends[:np.searchsorted(shorter, -t, side="right")] - t
            top = np.full(len(at), -np.inf)
            for n in range(min(self.longest, t)):
                after = best[at + n + 1] if n + 1 < t else 0.0
                score = found[n, at] + after
                better = score >= top  # of equal paths the longer word
                better &= np.isfinite(found[n, at])
                top = np.where(better, score, top)
                step[at[better]] = n + 1
            best[at] = top
        return step

    def _unknown(self, codes, begins, step, starts, ends) -> None:
        """Cut runs of single characters again by the most probable states."""
        single = begins & (step == 1)
        first = single.copy()
        first[1:] &= ~single[:-1]
        first[starts] = single[starts]
        last = single.copy()
        last[:-1] &= ~single[1:]
        last[ends - 1] = single[ends - 1]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
        wide = hi - lo > 1
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            return
        order = np.argsort(lo - hi, kind="stable")
        lo, shorter = lo[order], (lo - hi)[order]
        most = -int(shorter[0])
        score = self.start + self.emit[:, codes[lo]].T
        came = []
        for t in range(1, most):
            n = np.searchsorted(shorter, -t, side="left")
            ways = score[:n, :, None] + self.move[None]
            back = ways.argmax(1)
            came.append(back)
            now = np.take_along_axis(ways, back[:, None, :], 1)[:, 0] + self.emit[:, codes[lo[:n] + t]].T
            score[:n] = now
        state = np.where(score[:, _END] >= score[:, _SINGLE], _END, _SINGLE)
        for t in range(most - 1, -1, -1):
            n = np.searchsorted(shorter, -t, side="left")
            begins[lo[:n] + t] = (state[:n] == _BEGIN) | (state[:n] == _SINGLE)
            if t:
                state[:n] = came[t - 1][np.arange(n), state[:n]]

    def segment(self, runs: list[str]) -> list[list[str]]:
        """Words of each run; runs of ``PART_CHARS`` together, or one longer one, are cut at a time."""
        out, part, size = [], [], 0
        for run in runs:
            if part and size + len(run) > PART_CHARS:
                out += self._segment(part)
                part, size = [], 0
            part.append(run)
            size += len(run)
        return out + self._segment(part)

    def _segment(self, runs: list[str]) -> list[list[str]]:
        sizes = np.array([len(r) for r in runs], np.int64)
        text = "".join(runs)
        ends = np.cumsum(sizes)
        full = sizes > 0
        begins = self.cuts(np.frombuffer(text.encode("utf-32-le"), np.uint32), (ends - sizes)[full], ends[full])
        at = np.r_[np.flatnonzero(begins), len(text)].tolist()
        words = [text[a:b] for a, b in zip(at, at[1:])]
        edges = np.searchsorted(at, np.r_[0, ends]).tolist()
        return [words[a:b] for a, b in zip(edges, edges[1:])]


def dictionary_of(words: DataFrame, max_bytes: int = 64 << 20) -> Dictionary:
    """The dictionary of a table (word, n), whose size is measured first."""
    size = words.agg(F.sum(F.octet_length("word") + 16).alias("b")).first()["b"] or 0
    if size > max_bytes:
        raise ValueError(f"a dictionary of {size} bytes is over the limit of {max_bytes}")
    return Dictionary({r["word"]: r["n"] for r in words.where("word IS NOT NULL").select("word", "n").collect()})


def dictionary_segment(spark, dictionary: Dictionary, run_class: str = HAN_CLASS) -> Callable[[Column], Column]:
    """A tokenizer for the hooks in ``functions.text``: Han runs by the dictionary, other runs whole.

    Texts without Han characters are cut by expressions alone. NULL stays NULL.
    """
    shared = spark.sparkContext.broadcast(dictionary)

    def words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for runs in batches:
            runs = runs.cast(pa.list_(pa.string()))
            made = [cut_rows(part) for part in _row_parts(runs)]
            yield pa.concat_arrays(made) if made else runs

    def cut_rows(runs: pa.Array) -> pa.Array:
        flat = runs.flatten().to_pylist()
        han = [i for i, run in enumerate(flat) if _is_han(run)]
        cut = dict(zip(han, shared.value.segment([flat[i] for i in han])))
        rows, at = [], 0
        for size in runs.value_lengths().to_pylist():
            if size is None:
                rows.append(None)
                continue
            rows.append([w for i in range(at, at + size) for w in cut.get(i, flat[i:i + 1])])
            at += size
        return pa.array(rows, pa.list_(pa.string()))

    udf = F.arrow_udf(words, "array<string>")

    def tokenize(text: Column) -> Column:
        plain = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
        spaced = F.regexp_replace(text, f"([{run_class}]+)", " $1 ")
        mixed = F.when(text.rlike(f"[{run_class}]"), F.regexp_extract_all(spaced, F.lit(WORD_RUN), F.lit(0)))
        return F.coalesce(udf(mixed), plain)

    return tokenize


def _row_parts(lists: pa.Array) -> Iterator[pa.Array]:
    """Slices of a list column of about ``PART_BYTES`` of text each; a longer row is one by itself."""
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    text = np.r_[0, np.cumsum(pc.binary_length(lists.flatten()).to_numpy(zero_copy_only=False))]
    part = text[np.cumsum(length)] // PART_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(lists)] if len(lists) else [0]
    for a, b in zip(edges, edges[1:]):
        yield lists.slice(a, b - a)


def _is_han(run: str) -> bool:
    return "一" <= run[0] <= "龥"
