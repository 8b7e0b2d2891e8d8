"""Dictionary segmentation against a plain dynamic program and plain Viterbi."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cliplens.functions import text as X
from cliplens.operators import segmentation
from cliplens.operators.segmentation import Dictionary, dictionary_of, dictionary_segment, learned_words
from cliplens.plans import text as plans
from tests.conftest import SF

CHARS = "的一是了我不人在他有这个上们来到时大地为"


def plain(run, words, model):
    """Best path over the word graph from the right, then Viterbi over the single characters."""
    total, longest = float(np.log(sum(words.values()))), max(map(len, words))
    best, step = [0.0] * (len(run) + 1), [1] * len(run)
    for i in range(len(run) - 1, -1, -1):
        top = None
        for n in range(1, min(longest, len(run) - i) + 1):
            word = run[i:i + n]
            if word not in words and n > 1:
                continue
            p = np.log(words[word]) - total if word in words else -total
            p += best[i + n] if i + n < len(run) else 0.0
            if top is None or p >= top:
                top, step[i] = p, n
        best[i] = top
    parts, i = [], 0
    while i < len(run):
        parts.append(run[i:i + step[i]])
        i += step[i]
    out, held = [], ""
    for part in [*parts, None]:
        if part is not None and len(part) == 1:
            held += part
            continue
        out += viterbi(held, model) if len(held) > 1 else [held] if held else []
        held = ""
        if part:
            out.append(part)
    return out


def viterbi(run, d):
    codes = d.codes(np.array([ord(c) for c in run], np.uint32))
    score = [[d.start[s] + d.emit[s, codes[0]] for s in range(4)]]
    back = []
    for c in codes[1:]:
        ways = [[score[-1][a] + d.move[a, b] for a in range(4)] for b in range(4)]
        back.append([int(np.argmax(w)) for w in ways])
        score.append([max(w) + d.emit[b, c] for b, w in enumerate(ways)])
    states = [2 if score[-1][2] >= score[-1][3] else 3]
    for b in reversed(back):
        states.append(b[states[-1]])
    words = []
    for c, s in zip(run, reversed(states)):
        if s in (0, 3) or not words:
            words.append(c)
        else:
            words[-1] += c
    return words


@pytest.mark.parametrize("seed", range(8))
def test_equals_plain_dynamic_program(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choices(CHARS, k=rng.choice([1, 1, 2, 2, 3, 4]))): rng.randrange(1, 2000)
             for _ in range(120)}
    d = Dictionary(words)
    runs = ["".join(rng.choices(CHARS + "甲乙丙", k=rng.randrange(0, 40))) for _ in range(300)]
    runs += ["".join(rng.choices(sorted(words), k=3000)), "甲", "", "甲乙"]
    assert d.segment(runs) == [plain(r, words, d) for r in runs]


def test_trie_holds_exactly_its_words():
    rng = random.Random(1)
    words = {"".join(chr(rng.randrange(0x4e00, 0x9fa5)) for _ in range(rng.randrange(1, 6))): 3 for _ in range(5000)}
    d = Dictionary(words)
    for word in [*words, *(w + "一" for w in words), *(w[:-1] for w in words if len(w) > 1)]:
        codes = d.codes(np.array([ord(c) for c in word], np.uint32))
        got = d.matches(codes, np.arange(len(codes), 0, -1))
        assert all(np.isfinite(got[n, 0]) == (word[:n + 1] in words) for n in range(min(len(word), d.longest)))


def test_as_a_tokenizer(spark):
    words = spark.createDataFrame([("深度", 50), ("学习", 60), ("深度学习", 80), ("教程", 40), (None, 3)],
                                  "word string, n long")
    hook = dictionary_segment(spark, dictionary_of(words))
    rows = [(1, "深度学习教程2024 Pro版"), (2, "plain words 12"), (3, None), (4, ""), (5, "【教程】GPU深度"), (6, "！")]
    got = dict(spark.createDataFrame(rows, "id int, t string").select(
        "id", X.model_tokens(F.col("t"), hook)).collect())
    assert got == {1: ["深度学习", "教程", "2024", "pro", "版"], 2: ["plain", "words", "12"], 3: [], 4: [],
                   5: ["教程", "gpu", "深度"], 6: []}
    assert dictionary_of(words.where("false")).segment(["一二"])
    with pytest.raises(ValueError):
        dictionary_of(words, max_bytes=10)


def test_registered_query(spark):
    titles = plans.han_titles(spark, SF)
    words = {r["word"]: r["n"] for r in learned_words(plans.han_runs(titles)).collect()}
    d = Dictionary(words)
    got = {r["video_id"]: r["words"] for r in plans.segment_titles(spark, SF).collect()}
    rows = titles.withColumn("runs", F.regexp_extract_all("title", F.lit(f"[{X.HAN_CLASS}]+|[^{X.HAN_CLASS}]+"),
                                                          F.lit(0))).orderBy("video_id").limit(40).collect()
    assert len(got) == titles.count()
    import regex

    for r in rows:
        want = []
        for run in r["runs"] or []:
            want += plain(run, words, d) if "一" <= run[0] <= "龥" else regex.findall(r"[\p{L}\p{N}]+", run)
        assert got[r["video_id"]] == " ".join(want)


def test_a_batch_is_cut_in_bounded_parts(monkeypatch):
    words = {"天地": 5, "地": 3, "人": 2}
    whole = segmentation.Dictionary(words)
    runs = ["天地人", "", "地天", "人人地天地"] * 40
    expected = [w for r in runs for w in whole.segment([r])]
    seen = []
    monkeypatch.setattr(segmentation, "PART_CHARS", 16)
    cut = whole.cuts
    monkeypatch.setattr(whole, "cuts", lambda points, *ends: seen.append(len(points)) or cut(points, *ends))
    assert whole.segment(runs) == expected
    assert max(seen) <= 16 and sum(seen) == sum(map(len, runs))


def test_rows_of_a_batch_are_sliced_by_their_bytes(monkeypatch):
    monkeypatch.setattr(segmentation, "PART_BYTES", 20)
    rows = [["abc"], None, [], ["x" * 50], ["yy", "zz"], ["abcdefgh"] * 2] * 5
    lists = pa.array(rows, pa.list_(pa.string()))
    parts = list(segmentation._row_parts(lists))
    assert [r for p in parts for r in p.to_pylist()] == rows and len(parts) > 5
    assert all(len(p) == 1 or sum(len(w) for r in p.to_pylist()[1:] for w in r or []) <= 20 for p in parts)
    assert list(segmentation._row_parts(lists[:0])) == []
