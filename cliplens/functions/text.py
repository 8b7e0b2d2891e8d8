"""Text cleaning and segmentation as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The stop list (one of its entries is repeated in the source list).
STOP_WORDS = [
    "的", "是", "了", "在", "我", "你", "他", "她", "它", "们", "都", "也",
    "一个", "怎么", "这种", "这个", "一下", "真的", "就是", "还是", "不是",
    "什么", "为什么", "可以", "没有", "以及", "但是", "因为", "如果", "所以",
    "【", "】", "！", "？", "，", "。", " ", "#", "视频", "内容", "今天",
    "大家", "非常", "那个", "然后", "接着", "最后", "开始",
]

# Fixed value: the characters that cleaning keeps.
KEPT_CLASS = r"\x{4e00}-\x{9fa5}a-zA-Z0-9"
HAN_CLASS = r"\x{4e00}-\x{9fa5}"
WORD_RUN = r"[\p{L}\p{N}]+"
PART_BYTES = 1 << 20  # what a user's tokenizer is given of a batch at a time


def clean_for_embedding(text: Column) -> Column:
    """Each character outside Han and ASCII letters or digits becomes one space."""
    return F.trim(F.regexp_replace(text, f"[^{KEPT_CLASS}]", " "))


def clean_for_keywords(text: Column) -> Column:
    """Like ``clean_for_embedding`` but a whole run becomes one space; NULL is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{KEPT_CLASS}]+", " "))


def segment(text: Column) -> Column:
    """Words of a text: letter or digit runs, and character pairs inside Han runs."""
    plain = F.regexp_extract_all(text, F.lit(WORD_RUN), F.lit(0))
    spaced = F.regexp_replace(text, f"([{HAN_CLASS}]+)", " $1 ")
    runs = F.regexp_extract_all(spaced, F.lit(WORD_RUN), F.lit(0))
    mixed = F.flatten(F.transform(runs, _split_run))
    return F.when(text.rlike(f"[{HAN_CLASS}]"), mixed).otherwise(plain)


def _split_run(run: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2))
    )
    is_pairable = run.rlike(f"^[{HAN_CLASS}]") & (F.length(run) > 1)
    return F.when(is_pairable, pairs).otherwise(F.array(run))


def drop_stop_words(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def retrieval_tokens(title: Column, tokenizer=segment) -> Column:
    """Lower-case, segment, then drop stop words and single characters."""
    return drop_stop_words(tokenizer(F.lower(F.coalesce(title, F.lit("")))))


def model_tokens(title: Column, tokenizer=segment) -> Column:
    """Lower-case and segment, nothing dropped."""
    return tokenizer(F.lower(F.coalesce(title, F.lit(""))))


def keyword_words(title: Column, tokenizer=segment) -> Column:
    """Words of the cleaned text as they stand, used for plain counting.

    Segmenting a cleaned text gives its Han runs and its ASCII runs, so the
    default tokenizer cuts these out of the text at once.
    """
    if tokenizer is not segment:
        return drop_stop_words(tokenizer(clean_for_keywords(title)))
    text = F.coalesce(title, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[{HAN_CLASS}]+|[a-zA-Z0-9]+"), F.lit(0))
    words = F.when(text.rlike(f"[{HAN_CLASS}]"), F.flatten(F.transform(runs, _split_run)))
    return drop_stop_words(words.otherwise(runs))


def keyword_tokens(title: Column, tokenizer=segment) -> Column:
    """Cleaned words joined again, lower-cased and cut at word boundaries.

    The words of the default tokenizer hold no boundary and no single
    character, so joining and cutting would give them back.
    """
    words = keyword_words(title, tokenizer)
    if tokenizer is segment:
        return F.transform(words, lambda w: F.lower(w))
    joined = F.lower(F.array_join(words, " "))
    return F.regexp_extract_all(joined, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def sliced(rows, sizes: np.ndarray, limit: int) -> Iterator:
    """Slices of an Arrow array or batch with about ``limit`` of ``sizes`` in each, one row at least."""
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(rows)] if len(rows) else []
    for a, b in zip(edges, edges[1:]):
        yield rows.slice(a, b - a)


def tokenizer_udf(split):
    """Wrap ``split(str) -> list[str]`` as an Arrow tokenizer for the hooks above."""

    def tokenize(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.string())
        for texts in batches:
            texts = texts.cast(pa.string())
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            yield pa.concat_arrays([pa.array([], kind), *(
                pa.array([[] if t is None else split(t) for t in part.to_pylist()], kind)
                for part in sliced(texts, sizes, PART_BYTES))])

    return F.arrow_udf(tokenize, T.ArrayType(T.StringType()))
