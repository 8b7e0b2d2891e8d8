"""op2 and op8: against the tokenizer library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cliplens.llm import charclass, packed
from cliplens.llm.bpe import SpeculativeEncoder, encode_bpe
from cliplens.llm.tokens import LengthTable, count_tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ALPHABET = list("aabcs'tremdvl  \n\t12!.?'ABİΣ") + [
    "é", "ß", "中", "\xa0", "<|endoftext|>", "<|startoftext|>", "😀", "́", "Ⅷ", "thether", " and "]


def texts(n=400):
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randrange(40))) for _ in range(n)] + ["a" * 4000, "the" * 900]


def test_counts_equal_the_library(spark, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(BYTES)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs, BYTES, table_shares=50).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in rows}
    edge = count_tokens(edge_docs, BYTES, out="shard").collect()
    assert sorted(r["shard"] for r in edge) == sorted(len(library.encode(t or "")) for _, t in edge_rows)
    assert count_tokens(no_docs, BYTES).count() == 0


def thue_morse(letters, size):
    """Two words of equal polynomial hash modulo 2**64, whatever its odd base."""
    word, swap = letters[0], str.maketrans(letters, letters[::-1])
    while len(word) < size:
        word += word.translate(swap)
    return word, word.translate(swap)


def test_length_table():
    pieces = ["a", "bc", "", "the", *thue_morse("ab", 1024)]
    table = LengthTable(pieces, np.arange(1, 7))
    asked = pieces + ["x", "th"]
    data, offsets = charclass.code_points(asked)
    starts, ends = offsets[:-1], offsets[1:]
    got = table.get(packed.run_hashes(data, starts, ends), data, starts, ends).tolist()
    assert got == [1, 2, 3, 4, -1, 6, -1, -1]  # of two words of one hash the table holds the later


def test_words_of_equal_hashes(spark):
    for size, letters in ((2048, "ab"), (1024, "an")):
        for text in thue_morse(letters, size):
            rows = [(1, text), (2, " ".join(thue_morse(letters, size))), (3, text + " " + text)]
            docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
            bytes_, words = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
            assert [r["n_tokens"] for r in count_tokens(docs, BYTES).orderBy("doc_id").collect()] == [
                len(bytes_.encode(t)) for _, t in rows]
            assert [list(r["encoded"]["ids"]) for r in encode_bpe(docs, WORDS).orderBy("doc_id").collect()] == [
                words.encode(t, add_special_tokens=False).ids for _, t in rows]


def test_encoding_and_decoding_equal_the_library(spark, edge_docs, edge_rows, no_docs):
    library = Tokenizer.from_file(WORDS)
    rows = list(enumerate(texts())) + [(-1, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    digests = {r["doc_id"]: r["encoded"] for r in encode_bpe(docs, WORDS, digest=True).collect()}
    for r in encode_bpe(docs, WORDS).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert list(r["encoded"]["ids"]) == want, r["text"]
        assert r["encoded"]["decoded"] == library.decode(want, skip_special_tokens=False)
        d = digests[r["doc_id"]]
        assert d["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert (d["n_tokens"], d["decoded_sha256"]) == (
            len(want), hashlib.sha256(r["encoded"]["decoded"].encode()).hexdigest())
    edge = encode_bpe(edge_docs, WORDS, out="shard").collect()
    assert sorted(len(r["shard"]["ids"]) for r in edge) == sorted(
        len(library.encode(t or "", add_special_tokens=False).ids) for _, t in edge_rows)
    assert encode_bpe(no_docs, WORDS).count() == 0


def test_proofs_decide_as_merging_does():
    with open(WORDS, encoding="utf-8") as file:
        encoder = SpeculativeEncoder(file.read())
    rng = random.Random(9)
    words = ["".join(rng.choices("etaoinshr", k=rng.randrange(1, 12))) for _ in range(3000)]
    assert encoder.encode_words(words) == [encoder.merge(w) for w in words]
    assert 0 < encoder.merged < encoder.proposed  # some proposals stand, some fail


@pytest.mark.parametrize("path, cut", [
    (BYTES, charclass.byte_level_tokens), (WORDS, charclass.word_tokens)])
def test_pre_tokens_equal_the_library(path, cut):
    library = Tokenizer.from_file(path)
    table = charclass.class_table(library.pre_tokenizer)
    rng = random.Random(1)
    odd = [chr(rng.choice([rng.randrange(0x250), rng.randrange(0xD800), rng.randrange(0xE000, 0x20000)]))
           for _ in range(60)]
    all_texts = ["".join(rng.choices(ALPHABET + odd, k=rng.randrange(30))) for _ in range(3000)]
    data, offsets = charclass.code_points(all_texts)
    starts, ends = cut(data, offsets, table)
    of = np.searchsorted(offsets, starts, side="right") - 1
    for i, text in enumerate(all_texts):
        mine = [(int(a - offsets[i]), int(b - offsets[i])) for a, b in zip(starts[of == i], ends[of == i])]
        assert mine == [span for _, span in library.pre_tokenizer.pre_tokenize_str(text)]
