"""Character classes and pre-tokens, cut for many texts at once.

The class of every code point (white space, letter, number, other) is asked of
the tokenizer itself, so letters of any Unicode version are classed as it does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER = range(4)
CHUNK_CHARS = 1 << 20
_GUESS = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")),
          (SPACE, regex.compile(r"\s"))]


def _class_of(cut: Callable[[str], list], c: str) -> int:
    def joins(prefix: str) -> bool:
        pieces = cut(prefix + c)
        return len(pieces) == 1 and pieces[0][1][1] == 2

    if joins("a"):
        return LETTER
    if joins("!"):
        return OTHER
    if joins("1") or (len(cut(c)) == 1 and len(cut("a" + c + "a")) == 3 and not c.isspace()):
        return NUMBER
    return SPACE


def class_table(pre_tokenizer) -> np.ndarray:
    """The class of each of the 0x110000 code points, as ``pre_tokenizer`` has it.

    Runs of code points of one supposed class are confirmed by one call each;
    where that fails, every code point is asked for by itself.
    """
    cut = pre_tokenizer.pre_tokenize_str
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in _GUESS:
        for part in (range(0xD800), range(0xE000, 0x110000)):
            text = "".join(map(chr, part))
            table[[ord(m) for m in pattern.findall(text)]] = kind
    points = np.r_[0:0xD800, 0xE000:0x110000]
    kinds = table[points]
    cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(points) != 1)) + 1
    for run in np.split(points, cuts):
        kind = table[run[0]]
        for at in range(0, len(run), 512):
            part = run[at:at + 512]
            text = "".join(map(chr, part))
            prefix = {LETTER: "a", OTHER: "!", NUMBER: "1", SPACE: ""}[int(kind)]
            pieces = cut(prefix + text)
            whole = len(pieces) == 1 and pieces[0][1][1] == len(text) + 1
            if kind == SPACE or not whole:
                for c in part:
                    table[c] = _class_of(cut, chr(c))
    return table


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and the offset of each text."""
    data = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return data, offsets


def string_at(data: np.ndarray, start: int, end: int) -> str:
    return data[start:end].tobytes().decode("utf-32-le")


def segments(texts: list[str | None], specials: list[str]):
    """Texts cut at special strings: (segments, text of each, special after it or "")."""
    parts, owner, after = [], [], []
    cut = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
    for i, text in enumerate(texts):
        text = text or ""
        pieces = cut.split(text) if cut and any(s in text for s in specials) else [text]
        for at in range(0, len(pieces), 2):
            parts.append(pieces[at])
            owner.append(i)
            after.append(pieces[at + 1] if at + 1 < len(pieces) else "")
    return parts, np.array(owner, np.int64), after


def groups_of(texts: list[str], size: int = CHUNK_CHARS):
    """Ranges of whole texts of about ``size`` characters."""
    at = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > size:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def _text_starts(n: int, offsets: np.ndarray) -> np.ndarray:
    """Marks where a text begins."""
    mark = np.zeros(n + 1, bool)
    mark[offsets] = True
    return mark[:n]


def _contractions(data: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> None:
    """Split 's 't 'm 'd 're 've 'll off where an apostrophe begins a token."""
    n = len(data)
    at = np.flatnonzero((data == 39) & starts)
    at = at[at + 1 < n]
    at = at[~begins[at + 1]]
    one = np.isin(data[at + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(at), bool)
    more = np.flatnonzero(at + 2 < n)
    more = more[~begins[at[more] + 2]]
    for pair in ("re", "ve", "ll"):
        two[more] |= (data[at[more] + 1] == ord(pair[0])) & (data[at[more] + 2] == ord(pair[1]))
    starts[at[one | two] + 1] = False
    for length, which in ((2, one), (3, two)):
        end = at[which] + length
        starts[end[end < n]] = True


def byte_level_tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of all pre-tokens: contractions, then runs of letters,
    numbers or others with one space before them, then white space."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind, begins = table[data], _text_starts(n, offsets)
    starts = begins.copy()
    starts[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else stands alone, or leads it if it is a space.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~begins[1:])
    starts[last] = True
    starts[last[data[last] == 32] + 1] = False
    _contractions(data, starts, begins)
    first = np.flatnonzero(starts)
    return first, np.r_[first[1:], n]


def word_tokens(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Starts and ends of words: contractions, letter runs, single numbers, runs of
    others; white space is dropped."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kind, begins = table[data], _text_starts(n, offsets)
    starts = begins | (kind == NUMBER)
    starts[1:] |= kind[1:] != kind[:-1]
    _contractions(data, starts, begins)
    first = np.flatnonzero(starts)
    end = np.r_[first[1:], n]
    keep = kind[first] != SPACE
    return first[keep], end[keep]
