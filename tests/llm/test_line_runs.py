"""op6: planted passages of 1 to 8 lines against a plain count of repeated runs."""

import random

from cliplens.llm.lines import dedup_lines


def sentence(rng, words):
    return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(words))


def planted():
    rng, rows, copies = random.Random(11), [], []
    passages = [[sentence(rng, 51 if n == 1 else rng.randrange(3, 60)) for _ in range(n)]
                for n in range(1, 9) for _ in range(6)]
    for p in passages:
        for _ in range(3):
            before, after = ([sentence(rng, rng.randrange(2, 50)) for _ in range(rng.randrange(4))]
                             for _ in "ab")
            rows.append((len(rows), "\n".join(before + p + after)))
            copies.append((len(before), len(p)))
    short = sentence(rng, 50)  # one line of 50 words stays, and so does one beside a blank line
    rows += [(len(rows) + i, f"{sentence(rng, 9)}\n\n{short}\n\n{sentence(rng, 9)}") for i in range(3)]
    return rows, copies


def removed_lines(rows):
    """A line goes if it is in a run of two or more, or has over 50 words, and stood before."""
    seen, out = set(), {}
    for i, text in rows:
        lines, gone = text.split("\n"), set()
        full = [n for n, x in enumerate(lines) if x.strip()]
        units = [range(a, b + 1) for a, b in zip(full, full[1:])]
        units += [range(n, n + 1) for n in full if len(lines[n].split()) > 50]
        for unit in sorted(units, key=lambda u: u[0]):
            body = tuple(lines[n] for n in unit)
            gone |= set(unit) if body in seen else set()
            seen.add(body)
        out[i] = gone
    return out


def test_planted_passages_go_whole(spark):
    rows, copies = planted()
    want = removed_lines(rows)
    for n, (at, length) in enumerate(copies):
        assert want[n] == (set(range(at, at + length)) if n % 3 else set())
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for r in dedup_lines(docs).collect():
        lines, report = r["text"].split("\n"), r["line_dedup"]
        assert report["text"] == "\n".join(x for n, x in enumerate(lines) if n not in want[r["doc_id"]])
        assert report["n_removed"] == len(want[r["doc_id"]])


def test_lines_that_repeat_in_one_text_stay_once(spark):
    docs = spark.createDataFrame([(1, "a\na\na\na"), (2, "b\na\na")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["line_dedup"]["text"] for r in dedup_lines(docs).collect()}
    assert got == {1: "a", 2: "b"}
