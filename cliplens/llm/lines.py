"""Line dedup by content-defined chunks of lines.

A rolling window over the hashes of neighbouring lines makes every two
neighbouring lines with text one chunk, and every line of over 50 words one by
itself. A chunk depends on its own lines only, so a passage is found alike
wherever it stands and whatever stands around it, to its last line. Chunks that
occur more than once in the corpus are removed but for their first occurrence.
Chunks that overlap and have their first occurrences side by side in one
document are one run, whose bytes are compared as a whole.

Only hashes and positions are grouped; a chunk that very many documents share
is counted before it is shuffled and looked up by broadcast. The texts move
once, to meet their documents' runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplens.llm import packed
from cliplens.operators.joins import weighted_join
from cliplens.session import materialize

ALONE_WORDS = 50  # a line of more words is a chunk by itself
MAX_BYTES = 32 << 10
_CHUNK = "array<struct<start:int,end:int,key:binary>>"
_CHUNK_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("key", pa.binary())]))
_REPORT = "struct<text:string,n_lines:bigint,n_removed:bigint,removed:array<struct<start:int,end:int>>>"


def line_bounds(data: np.ndarray, offsets: np.ndarray):
    """Starts and ends of all lines without their line feeds, and where each text begins."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([feeds, offsets[1:]]), kind="stable")
    # Each text has one line more than it has line feeds.
    first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
    return starts, ends, first


def line_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each line, split at ASCII white space."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    filled = starts[starts < ends]
    begins[filled] = inside[filled]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(begins, out=before[1:])
    return before[ends] - before[starts]


def text_chunks(texts: pa.Array) -> Iterator[list[dict]]:
    """The chunks of each text: byte bounds and a 128-bit hash.

    They are every two neighbours among the lines that are not white space,
    with the blank lines between them, up to ``MAX_BYTES`` bytes, and every line
    of more than ``ALONE_WORDS`` words, of any length.
    """
    from xxhash import xxh3_128_digest

    data, offsets = packed.text_bytes(texts)
    for lo, hi in packed.chunks(offsets):
        part, at = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, first = line_bounds(part, at)
        words = line_words(part, starts, ends)
        for i in range(hi - lo):
            a, b, begin = first[i], first[i + 1], int(at[i])
            lines = a + np.flatnonzero(words[a:b])
            s, e = starts[lines], ends[lines]
            long = np.flatnonzero(words[lines] > ALONE_WORDS)
            pairs = np.flatnonzero(e[1:] - s[:-1] <= MAX_BYTES)
            bounds = [*zip(s[:-1][pairs].tolist(), e[1:][pairs].tolist()),
                      *zip(s[long].tolist(), e[long].tolist())]
            yield [{"start": x - begin, "end": y - begin, "key": xxh3_128_digest(part[x:y])}
                   for x, y in bounds]


def _chunk_udf():
    def chunk(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array(text_chunks(texts), _CHUNK_ARROW)

    return F.arrow_udf(chunk, _CHUNK).asNondeterministic()


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The unions of spans that overlap, in order."""
    out = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _runs_udf():
    def runs(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in parts:
            yield pa.array([[{"start": a, "end": b} for a, b in merged(
                [(c["start"], c["end"]) for c in row])] for row in rows.to_pylist()],
                pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return F.arrow_udf(runs, "array<struct<start:int,end:int>>").asNondeterministic()


def _cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Without whole lines: the line feed after a span goes too, or the one before the last."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = min(end + 1, len(text))
    kept.append(text[at:])
    left = b"".join(kept)
    ended = spans[-1][1] == len(text)
    return left[:-1] if ended and left.endswith(b"\n") else left


def _remove_udf():
    def remove(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, chunks in parts:
            rows = []
            for text, spans in zip(texts.to_pylist(), chunks.to_pylist()):
                if text is None:
                    rows.append({"text": None, "n_lines": 0, "n_removed": 0, "removed": []})
                    continue
                whole = text.encode()
                out = merged([(s["start"], s["end"]) for s in spans or ()])
                rows.append({
                    "text": _cut_out(whole, out).decode() if out else text,
                    "n_lines": whole.count(b"\n") + 1,
                    "n_removed": sum(whole.count(b"\n", s, e) + 1 for s, e in out),
                    "removed": [{"start": s, "end": e} for s, e in out]})
            yield pa.array(rows, pa.struct([
                ("text", pa.string()), ("n_lines", pa.int64()), ("n_removed", pa.int64()),
                ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return F.arrow_udf(remove, _REPORT).asNondeterministic()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                out: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct ``out``: the text left, its lines, the lines removed and where.

    A run of at least two lines with text, or a line of more than 50 words,
    that stands in the corpus more than once is kept where it stands first, in
    order of id (NULL first), then of a hash of the text, then of its place, and
    removed with its line feeds elsewhere, so every line stays somewhere. Byte
    bounds of what was removed are in ``removed``. White space alone is never
    removed. Two lines of over 32 KiB together, none of over 50 words, are no run.

    NULL stays NULL and has no lines; the empty text has one empty line. Rows of
    equal id and text are one document and keep alike. Runs whose 128-bit hashes
    are equal but whose bytes are not are told apart by the comparison and
    stay. An empty table stays empty. An existing column named ``out`` is replaced.
    """
    keys = {"__doc": F.col(id_col), "__digest": F.xxhash64(F.col(text_col).isNull(), F.col(text_col))}
    found = materialize(
        docs.select(*[c.alias(k) for k, c in keys.items()],
                    F.explode(_chunk_udf()(F.col(text_col))).alias("c"))
        .select("__doc", "__digest", "c.start", "c.end", "c.key"), "chunks")
    repeated = materialize(
        found.groupBy("key").agg(
            F.count("*").alias("n"),
            F.min(F.struct("__doc", "__digest", "start")).alias("first")).where("n > 1"), "repeated")
    met = weighted_join(found, repeated, "key", "n", "inner", ["__doc", "__digest", "start"])
    here = F.struct("__doc", "__digest", "start")
    delta = F.col("start") - F.col("first.start")
    runs = met.where(~here.eqNullSafe(F.col("first"))).groupBy(
        "__doc", "__digest", F.col("first.__doc").alias("_from"),
        F.col("first.__digest").alias("_from_digest"), delta.alias("_delta")).agg(
        F.collect_set(F.struct("start", "end")).alias("_hits"))
    runs = runs.withColumn("r", F.explode(_runs_udf()("_hits"))).select(
        "__doc", "__digest", "_from", "_from_digest", (F.col("r.start") - F.col("_delta")).alias("_at"),
        "r.start", "r.end")
    runs = materialize(runs.withColumn("key", F.concat_ws(
        "|", F.col("_from").isNull(), F.coalesce(F.col("_from").cast("string"), F.lit("")),
        "_from_digest", "_at", F.col("end") - F.col("start"))), "runs")
    heads = materialize(runs.groupBy("key").agg(F.count("*").alias("n"), F.first(F.struct(
        "_from", "_from_digest", "_at", (F.col("_at") + F.col("end") - F.col("start")).alias("end"))
    ).alias("f")), "first-runs")
    each = runs.select("__doc", "__digest", "start", "end", "key", F.lit(False).alias("first")).union(
        heads.select("f._from", "f._from_digest", "f._at", "f.end", "key", F.lit(True)))
    of_doc = materialize(
        each.select("__doc", "__digest", F.struct("start", "end", "key", "first").alias("c"))
        .groupBy("__doc", "__digest").agg(F.collect_set("c").alias("__chunks")), "document-runs")
    keyed = docs.withColumns(keys)
    same = (F.coalesce(keyed["__doc"].cast("string"), F.lit("")) == F.coalesce(
        of_doc["__doc"].cast("string"), F.lit(""))) & (keyed["__digest"] == of_doc["__digest"]) & (
        keyed["__doc"].isNull() == of_doc["__doc"].isNull())
    joined = materialize(
        keyed.join(of_doc, same, "left").select(
            *docs.columns, keyed["__doc"], keyed["__digest"], "__chunks"),
        "documents-with-chunks", compression="zstd")
    wrong = _different(joined, heads.select("key", "n"), text_col)
    chunks = F.filter("__chunks", lambda c: ~c["first"])
    if wrong is not None:
        joined = joined.join(wrong, joined["__doc"].eqNullSafe(wrong["_w_doc"]) & (
            joined["__digest"] == wrong["_w_digest"]), "left")
        chunks = F.filter("__chunks", lambda c: ~c["first"] & ~F.array_contains(
            F.coalesce("_w_spans", F.array().cast("array<struct<start:int,end:int>>")),
            F.struct(c["start"].alias("start"), c["end"].alias("end"))))
    spans = F.coalesce(chunks, F.filter(F.lit(None).cast(
        "array<struct<start:int,end:int,key:string,first:boolean>>"), lambda c: F.lit(True)))
    columns = [c for c in docs.columns if c.lower() != out.lower()]
    return joined.select(*columns, _remove_udf()(F.col(text_col), spans).alias(out))


def _different(joined: DataFrame, sizes: DataFrame, text_col: str) -> DataFrame | None:
    """Runs whose bytes differ from the first of equal hashes; None if there are none."""
    each = joined.where("__chunks IS NOT NULL").select(
        "__doc", "__digest", F.col(text_col).cast("binary").alias("_bytes"),
        F.explode("__chunks").alias("c")).select(
        "__doc", "__digest", F.col("c.start").alias("start"), F.col("c.end").alias("end"),
        F.col("c.key").alias("key"), F.col("c.first").alias("first"),
        F.substring("_bytes", F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("bytes"))
    heads = each.where("first").groupBy("key").agg(F.first("bytes").alias("head")).join(sizes, "key")
    compared = weighted_join(
        each.where("NOT first"), materialize(heads, "first-bytes"), "key", "n", "inner",
        ["__doc", "__digest", "start"])
    wrong = materialize(
        compared.where("bytes <> head").groupBy(F.col("__doc").alias("_w_doc"), F.col("__digest").alias(
            "_w_digest")).agg(F.collect_set(F.struct("start", "end")).alias("_w_spans")), "different-runs")
    return wrong if wrong.limit(1).count() else None


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines cut from the texts.

    A document of which nothing but white space is left goes; one that had
    nothing else before stays as it is.
    """
    report = F.col("__line_dedup")
    blank = F.trim(F.regexp_replace(report["text"], r"\s+", " ")) == ""
    return dedup_lines(docs, id_col, text_col, "__line_dedup").where(
        (report["n_removed"] == 0) | ~blank).withColumn(text_col, report["text"]).select(*docs.columns)
