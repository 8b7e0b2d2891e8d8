"""Vectorised helpers over many texts at once, used inside Arrow UDFs.

Texts are laid end to end in one array with the offset of each, so that words
and tokens of thousands of documents are cut and hashed by a few numpy calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the next call."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                column = np.full(n, base, np.uint64)
                column[0] = 1
                _POWERS[i] = np.cumprod(column)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, so that their order is as good as random."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run ``data[start:end]``; runs are in order.

    Works through blocks of runs, so the scratch arrays stay small on a text of
    any length.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        lo = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, lo + (1 << 20), side="right")))
        hi = int(ends[to - 1])
        up, down = _powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = to
    return out


def same_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
              other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each run ``data[start:end]`` equals ``other[at:to]``, element by element."""
    same = (ends - starts) == (to - at)
    which = np.flatnonzero(same & (ends > starts))
    if data is other:
        which = which[starts[which] != at[which]]
    sums = np.cumsum(ends[which] - starts[which])
    lo = 0
    while lo < len(which):
        before = sums[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sums, before + (1 << 20), side="right")))
        rows = which[lo:hi]
        size, last = ends[rows] - starts[rows], sums[lo:hi] - before
        here = np.arange(last[-1]) + np.repeat(starts[rows] - (last - size), size)
        there = here + np.repeat(at[rows] - starts[rows], size)
        wrong = np.flatnonzero(data[here] != other[there])
        same[rows[np.searchsorted(last, wrong, side="right")]] = False
        lo = hi
    return same


def distinct_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                  hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One run of each value, and for every run the place of its value among these.

    Runs are grouped by hash and each is compared with the first of its hash, so
    runs that differ are never taken for one, whatever their hashes.
    """
    if hashes is None:
        hashes = run_hashes(data, starts, ends)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    wrong = np.flatnonzero(~same_runs(data, starts, ends, data, starts[first][back], ends[first][back]))
    if len(wrong):
        found: dict[bytes, int] = {}
        more = []
        for i in wrong.tolist():
            key = data[starts[i]:ends[i]].tobytes()
            if key not in found:
                found[key] = len(first) + len(more)
                more.append(i)
            back[i] = found[key]
        first = np.r_[first, np.array(more, first.dtype)]
    return first, back


def sequence_hashes(hashes: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` hashes that begin at each of ``firsts``."""
    out = np.zeros(len(firsts), np.uint64)
    for i in range(n):
        out = out * np.uint64(_BASE) + hashes[firsts + i]
    return mix(out)


def is_member(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in ``ordered`` (sorted, unique), and where it would be."""
    if not len(ordered):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values, at


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array end to end, and the offsets; NULL has none."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    buffers = texts.buffers()
    if not len(texts) or buffers[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is one by itself."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to
        at = to


def cut_runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True; no run crosses a text's offset."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def owners(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The text that each position belongs to."""
    return np.searchsorted(offsets, positions, side="right") - 1


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
