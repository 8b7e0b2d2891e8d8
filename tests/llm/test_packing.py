"""op13: against the tokenizer library and best fit piece by piece."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cliplens.llm import charclass
from cliplens.llm.packing import Plan, WordIds, pack, pack_documents, text_ids
from tests.llm.test_tokens_bpe import texts, thue_morse

WORDS = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    """Sequences that best fit needs, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, room in enumerate(rooms) if room >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return rooms


def check_sequences(rows, capacity):
    """(sequence, offset, length) without gaps or overlaps."""
    sequences = {}
    for s, o, n in rows:
        sequences.setdefault(s, []).append((o, n))
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return sequences


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = [10, 50, 97, 128, 300, 4096][seed]
    lengths = [rng.choice([rng.randrange(1, capacity + 1), rng.randrange(1, 2 + capacity // 8), 3])
               for _ in range(rng.randrange(1, 1500))]
    counts = Counter(lengths)
    plan = Plan(counts, capacity)
    assert plan.taken == counts
    rows = []
    for n, c in counts.items():
        s, o = plan.slots(np.full(c, n), np.arange(c))
        rows += zip(s.tolist(), o.tolist(), [n] * c)
    sequences = check_sequences(rows, capacity)
    rooms = sorted(capacity - sum(n for _, n in parts) for parts in sequences.values())
    assert rooms == sorted(best_fit(lengths, capacity)) and len(sequences) == plan.sequences
    assert Plan({}, capacity).sequences == 0


def test_documents(spark, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    got = pack_documents(edge_docs, WORDS, capacity=64).collect()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    want = []
    for i, text in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 64)):
            part = ids[start:start + 64]
            want.append((i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=repr) == sorted(want, key=repr)
    assert len({r["sequence_id"] for r in got}) == len(best_fit([w[3] for w in want], 64))
    assert pack_documents(no_docs, WORDS).count() == 0


def test_ids_equal_the_library():
    library = Tokenizer.from_file(WORDS)
    with open(WORDS, encoding="utf-8") as file:
        worker = WordIds(file.read())
    table = charclass.class_table(library.pre_tokenizer)
    specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    odd = ["J\u030c", "İ", "ΑΣ", "<|ENDOFTEXT|>", "a" * 5000, *thue_morse("ab", 2048)]
    rows = [*texts(), *odd, " ".join(odd), None]
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(i, "<u4").tolist() for i in text_ids(rows, worker, table, specials)]
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in rows]


def test_hot_length_is_dealt_over_tasks(spark):
    rows = [(i, 5 if i % 3 else 1 + i % 40) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc long, length long").repartition(8)
    got = pack(pieces, 64).collect()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in got], 64)
    assert sorted((r["doc"], r["length"]) for r in got) == rows
    assert len({r["sequence_id"] for r in got}) == len(best_fit([n for _, n in rows], 64))
