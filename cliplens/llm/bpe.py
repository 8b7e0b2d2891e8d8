"""BPE encoding and decoding by speculation and proof.

A word is first cut greedily into the longest entries of the vocabulary. Such
a proposal is the true encoding exactly if every entry encodes to itself and
every two neighbours are compatible: no merge across their border comes due
before the merges that form them. The test undoes the later of the two merges
step by step and is run on the pairs of all new words at once in numpy. Only
words that fail it are merged one merge at a time.

Documents are encoded where they lie, without a shuffle; each worker keeps the
words it has met.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.llm import charclass, packed

CACHE_SIZE, CACHED_CHARS = 300_000, 256
_NEVER = np.int64(1 << 40)
_WORKER: dict[str, SpeculativeEncoder] = {}
ENCODED = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
ENCODED_FULL = "struct<ids:array<bigint>,decoded:string>"


def byte_alphabet() -> dict[int, str]:
    """Byte -> printable character: visible bytes stay, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class SpeculativeEncoder:
    """Words to ids of a BPE vocabulary with word ends."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        model = json.loads(spec)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.longest = max(map(len, self.vocab))
        self.strings = {i: s for s, i in self.vocab.items()}
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.strings[i] = token.content
        self.letters = str.maketrans({chr(b): c for b, c in byte_alphabet().items()})
        size = max(self.strings) + 1
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            pair, made = (self.vocab[a], self.vocab[b]), self.vocab[a + b]
            self.merges[pair] = (rank, made)
            self.left[made], self.right[made], self.rank[made] = *pair, rank
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ranks = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.stable = self._stable()
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        self.proposed = self.merged = 0

    @classmethod
    def of(cls, spec: str) -> SpeculativeEncoder:
        if spec not in _WORKER:
            _WORKER.clear()
            _WORKER[spec] = cls(spec)
        return _WORKER[spec]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.key_ranks[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Whether no merge of rank below ``limit`` ever crosses the border of a and b.

        Backwards in time: a crossing merge of the two pieces at the border must
        not be due before the later of them was formed. Of equal merges the
        leftmost is first.
        """
        good = np.ones(len(a), bool)
        open_, a, b, limit = np.arange(len(a)), a.copy(), b.copy(), limit.copy()
        while len(open_):
            crossed = self._pair_rank(a, b) < limit
            good[open_[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            open_, a, b, ra, rb = open_[go], a[go], b[go], ra[go], rb[go]
            undo_left = ra > rb
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return good

    def _stable(self) -> np.ndarray:
        """Entries that encode to themselves."""
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made])]
        whole = self.compatible(self.left[made], self.right[made], self.rank[made])
        stable = np.ones(len(self.rank), bool)
        for t, fine in zip(made.tolist(), whole.tolist()):
            stable[t] = fine and stable[self.left[t]] and stable[self.right[t]]
        return stable

    def propose(self, word: str) -> list[int]:
        """Greedy longest entries; the last one carries the word end."""
        ids, at, n = [], 0, len(word)
        while True:
            rest = n - at
            if rest <= self.longest and (last := self.vocab.get(word[at:] + self.suffix)) is not None:
                ids.append(last)
                return ids
            for size in range(min(self.longest, rest - 1), 0, -1):
                if (token := self.vocab.get(word[at:at + size])) is not None:
                    break
            ids.append(token)
            at += size

    def merge(self, word: str) -> list[int]:
        """The encoding itself: the earliest merge first, of equal ones the leftmost."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.suffix]]
        after = [*range(1, len(ids)), -1]
        before = [-1, *range(len(ids) - 1)]
        heap = [(self.merges[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        gone = [False] * len(ids)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i] = self.merges[pair][1]
            gone[j] = True
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0 and (p := (ids[at], ids[after[at]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], at, p))
        return [t for t, dropped in zip(ids, gone) if not dropped]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in the byte alphabet."""
        found = [self.propose(word) for word in words]
        if not found:
            return found
        sizes = np.array([len(ids) for ids in found])
        flat = np.concatenate([np.array(ids, np.int64) for ids in found])
        of = np.repeat(np.arange(len(found)), sizes)
        wrong = np.zeros(len(found), bool)
        wrong[of[~self.stable[flat]]] = True
        inner = np.flatnonzero(of[:-1] == of[1:])
        good = self.compatible(flat[inner], flat[inner + 1], np.full(len(inner), _NEVER))
        wrong[of[inner[~good]]] = True
        for i in np.flatnonzero(wrong).tolist():
            found[i] = self.merge(words[i])
        self.proposed += len(found)
        self.merged += int(wrong.sum())
        return found

    def coded(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the strings they decode to."""
        return (np.array(ids, "<u4").tobytes(),
                " ".join([self.strings[i] for i in ids]).encode())

    def words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Coded words; those met lately are kept, if they are not long."""
        out, new = [], []
        for i, word in enumerate(words):
            got = self.young.get(word)
            if got is None and (got := self.old.get(word)) is not None:
                self.young[word] = got
            if got is None:
                new.append(i)
            out.append(got)
        texts = [words[i].encode().decode("latin-1").translate(self.letters) for i in new]
        for i, ids in zip(new, self.encode_words(texts)):
            out[i] = self.coded(ids)
            if len(words[i]) <= CACHED_CHARS:
                self.young[words[i]] = out[i]
        if len(self.young) > CACHE_SIZE:  # forget what has not been met lately
            self.old, self.young = self.young, {}
        return out


class Normal:
    """Lower case and NFC, as the tokenizer's own normalizer gives them."""

    EASY = 0x250  # below it NFC changes nothing and lower case maps character to character

    def __init__(self, tokenizer):
        self.normalizer = tokenizer.normalizer
        self.lower = np.arange(self.EASY, dtype=np.uint32)
        self.hard = np.zeros(self.EASY, bool)
        for c in range(self.EASY):
            text = self.normalizer.normalize_str(chr(c)) if not chr(c).isspace() else chr(c)
            self.hard[c] = len(text) != 1
            self.lower[c] = ord(text) if len(text) == 1 else c

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = charclass.code_points(texts)
        easy = np.minimum(data, self.EASY - 1)
        hard = (data >= self.EASY) | self.hard[easy]
        if not hard.any():
            return self.lower[data], offsets
        texts = list(texts)
        for i in np.unique(packed.owners(np.flatnonzero(hard), offsets)).tolist():
            texts[i] = self.normalizer.normalize_str(texts[i])
        data, offsets = charclass.code_points(texts)
        easy = np.minimum(data, self.EASY - 1)
        return np.where(data < self.EASY, self.lower[easy], data), offsets


def _encoded(texts: list[str | None], worker: SpeculativeEncoder, normal: Normal,
             table: np.ndarray, specials: dict[str, int]) -> Iterator[tuple[bytes, bytes]]:
    """(ids as bytes, decoded UTF-8) of each text, in order."""
    parts, owner, after = charclass.segments(texts, list(specials))
    ids: list[bytes] = []
    decoded: list[bytes] = []
    at, n_parts = 0, len(parts)
    for lo, hi in charclass.groups_of(parts):
        data, offsets = normal(parts[lo:hi])
        starts, ends = charclass.word_tokens(data, offsets, table)
        first, back = packed.distinct_runs(data, starts, ends)
        coded = worker.words([charclass.string_at(data, a, b) for a, b in zip(
            starts[first].tolist(), ends[first].tolist())])
        id_bytes, strings = [c[0] for c in coded], [c[1] for c in coded]
        where = np.searchsorted(starts, offsets)
        order = back.tolist()
        for k in range(lo, hi):
            mine = order[where[k - lo]:where[k - lo + 1]]
            ids += [id_bytes[i] for i in mine]
            decoded += [strings[i] for i in mine]
            if after[k]:
                ids.append(specials[after[k]].to_bytes(4, "little"))
                decoded.append(after[k].encode())
            at = k + 1
            if at == n_parts or owner[at] != owner[k]:
                yield b"".join(ids), b" ".join(decoded)
                ids, decoded = [], []


def _encode_udf(shared, full: bool):
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spec, table, specials = shared.value
        worker = SpeculativeEncoder.of(spec)
        normal = Normal(worker.tokenizer)
        for texts in parts:
            rows = _encoded(texts.to_pylist(), worker, normal, table, specials)
            if full:
                rows = [(np.frombuffer(i, "<u4").astype(np.int64), d.decode()) for i, d in rows]
                columns = [pa.array([r[0] for r in rows], pa.list_(pa.int64())),
                           pa.array([r[1] for r in rows], pa.string())]
                names = ["ids", "decoded"]
            else:
                rows = [(len(i) // 4, hashlib.sha256(i).hexdigest(), hashlib.sha256(d).hexdigest())
                        for i, d in rows]
                columns = [pa.array([r[0] for r in rows], pa.int64()),
                           *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2))]
                names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.StructArray.from_arrays(columns, names=names)

    return F.arrow_udf(encode, ENCODED_FULL if full else ENCODED).asNondeterministic()


def encode_bpe(docs: DataFrame, tokenizer_path: str, text_col: str = "text",
               out: str = "encoded", digest: bool = False) -> DataFrame:
    """``docs`` with the ids of each whole text and what they decode to.

    The tokenizer is a BPE file with word ends. ``out`` is a struct of ``ids``
    and ``decoded``; with ``digest`` it holds the number of ids and the SHA-256
    of both instead, so that nothing long leaves the task. No special tokens
    are added; those inside a text are encoded as the tokenizer does.

    NULL counts as the empty text: no ids, an empty string. Very long texts are
    encoded whole, repeated rows alike, an empty table stays empty, and an
    existing column named ``out`` is replaced. Words are grouped by a hash and
    compared whole.
    """
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    tokenizer = Tokenizer.from_str(spec)
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    shared = docs.sparkSession.sparkContext.broadcast(
        (spec, charclass.class_table(tokenizer.pre_tokenizer), specials))
    return docs.withColumn(out, _encode_udf(shared, not digest)(F.col(text_col)))
