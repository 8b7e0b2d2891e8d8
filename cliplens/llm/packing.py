"""Best-fit packing of documents into sequences, planned on a histogram of lengths.

How many pieces there are of each length is all that best fit needs to know:
lengths are taken in falling order, and as many pieces of one length as fit go
at once into all the sequences with the tightest room for it. Sequences that
were filled alike are one entry of the plan with a count. The plan gives each
length a run of slots, and the pieces of a length, numbered over all tasks, take
the slots of their numbers. Only the histogram (a row for each length up to the
capacity) and the plan, which depends on it alone, pass through the driver.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cliplens.llm import bpe, charclass, packed
from cliplens.operators.ranking import numbered
from cliplens.session import materialize, spread

CAPACITY = 4096
_WORKER: dict[str, WordIds] = {}
_PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


class Plan:
    """Best fit, longest first, of ``counts`` (length -> pieces) into sequences of ``capacity``.

    A slot run is (first number in its length, first sequence, pieces a
    sequence, offset): the pieces of a length with numbers from the first on
    take it, so many to each sequence in turn.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        # Room left -> [(sequences, what they hold)], what they hold being a chain of (length, times, before).
        rooms: dict[int, list[tuple[int, tuple | None]]] = {}
        # No more sequences than are left to fill: room is looked up from the least upwards.
        for length in sorted((n for n, c in counts.items() if c), reverse=True):
            left = counts[length]
            waiting = [room for room in rooms if room >= length]
            waiting.sort(reverse=True)
            while left and waiting:
                room = waiting.pop()
                groups = rooms.pop(room)
                while groups and left:
                    sequences, held = groups.pop()
                    left = self._fill(rooms, room, sequences, held, length, left)
                if groups:
                    rooms.setdefault(room, []).extend(groups)
            if left:
                each = capacity // length
                self._fill(rooms, capacity, -(-left // each), None, length, left)
        self._number(rooms)

    @staticmethod
    def _fill(rooms, room: int, sequences: int, held, length: int, left: int) -> int:
        """Put pieces of one length into equal sequences, each filled before the next; how many are left."""
        each = room // length
        full = min(sequences, left // each)
        rest = min(left - full * each, each - 1) if full < sequences else 0
        for n, times in ((full, each), (bool(rest), rest), (sequences - full - bool(rest), 0)):
            if n:
                chain = (length, times, held) if times else held
                rooms.setdefault(room - times * length, []).append((int(n), chain))
        return left - full * each - rest

    def _number(self, rooms) -> None:
        runs: list[tuple[int, int, int, int, int]] = []  # length, number, sequence, times, offset
        taken: dict[int, int] = {}
        self.sequences = 0
        for room in sorted(rooms):
            for n, held in rooms[room]:
                entries = []
                while held:
                    length, times, held = held
                    entries.append((length, times))
                offset = 0
                for length, times in reversed(entries):
                    at = taken.get(length, 0)
                    runs.append((length, at, self.sequences, times, offset))
                    taken[length] = at + n * times
                    offset += length * times
                self.sequences += n
        runs.sort()
        self.runs = np.array(runs, np.int64).reshape(-1, 5)
        self.taken = taken

    def slots(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces of these lengths and numbers within them."""
        lengths, first = self.runs[:, 0], self.runs[:, 1]
        lo, hi = np.searchsorted(lengths, length), np.searchsorted(lengths, length, side="right")
        # Runs are in order of (length, number), so one sorted key finds them.
        stride = int(first.max(initial=0)) + 1
        at = np.searchsorted(lengths * stride + first, length * stride + np.minimum(number, stride - 1),
                             side="right") - 1
        at = np.clip(at, lo, hi - 1)
        _, _, sequence, times, offset = self.runs[at].T
        inside = number - first[at]
        return sequence + inside // times, offset + inside % times * length


class WordIds:
    """Ids of words by the tokenizers library; words met lately are kept, if they are not long."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.normal = bpe.Normal(Tokenizer.from_str(spec))
        # Words come normalized, and normalizing twice can differ from once.
        self.tokenizer = Tokenizer.from_str(json.dumps({**json.loads(spec), "normalizer": None}))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, spec: str) -> WordIds:
        if spec not in _WORKER:
            _WORKER.clear()
            _WORKER[spec] = cls(spec)
        return _WORKER[spec]

    def __call__(self, words: list[str]) -> list[bytes]:
        out, new = [], []
        for i, word in enumerate(words):
            got = self.young.get(word)
            if got is None and (got := self.old.get(word)) is not None:
                self.young[word] = got
            if got is None:
                new.append(i)
            out.append(got)
        if new:
            found = self.tokenizer.encode([words[i] for i in new], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, "<u4").tobytes()
            ends = 4 * np.cumsum(np.bincount(np.array(found.word_ids, np.int64), minlength=len(new)))
            at = 0
            for i, end in zip(new, ends.tolist()):
                out[i], at = ids[at:end], end
                if len(words[i]) <= bpe.CACHED_CHARS:
                    self.young[words[i]] = out[i]
        if len(self.young) > bpe.CACHE_SIZE:
            self.old, self.young = self.young, {}
        return out


def text_ids(texts: list[str | None], worker: WordIds, table: np.ndarray,
             specials: dict[str, int]) -> Iterator[bytes]:
    """Ids of each text as little-endian 32-bit integers; different words are encoded once."""
    parts, owner, after = charclass.segments(texts, list(specials))
    held: list[bytes] = []
    for lo, hi in charclass.groups_of(parts):
        data, offsets = worker.normal(parts[lo:hi])
        starts, ends = charclass.word_tokens(data, offsets, table)
        first, back = packed.distinct_runs(data, starts, ends)
        coded = worker([charclass.string_at(data, a, b) for a, b in zip(
            starts[first].tolist(), ends[first].tolist())])
        sizes = np.array([len(c) // 4 for c in coded], np.int64)
        begins = np.cumsum(sizes) - sizes
        each = sizes[back]
        done = np.r_[0, np.cumsum(each)]
        ids = np.frombuffer(b"".join(coded), "<u4")[
            np.arange(done[-1]) + np.repeat(begins[back] - done[:-1], each)]
        cuts = done[np.searchsorted(starts, offsets)].tolist()
        for k in range(lo, hi):
            held.append(ids[cuts[k - lo]:cuts[k - lo + 1]].tobytes())
            if after[k]:
                held.append(specials[after[k]].to_bytes(4, "little"))
            if k + 1 == len(parts) or owner[k + 1] != owner[k]:
                yield b"".join(held)
                held = []


def _cut_udf(shared, capacity: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, table, specials = shared.value
        worker = WordIds.of(spec)
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for i, ids in enumerate(text_ids(batch.column(1).to_pylist(), worker, table, specials)):
                ids += tail
                for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + capacity)]
                    for column, value in zip(rows, (i, piece, start, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()),
                 *[pa.array(r, pa.int64()) for r in rows[2:]]],
                names=["doc", "piece", "start", "length", "ids_crc32"])

    return cut


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """(doc, piece, start, length, ids_crc32): the ids of each text and ``end_id``, cut where too long."""
    from tokenizers import Tokenizer

    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    tokenizer = Tokenizer.from_str(spec)
    specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    shared = docs.sparkSession.sparkContext.broadcast(
        (spec, charclass.class_table(tokenizer.pre_tokenizer), specials))
    source = spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")))
    kind = source.schema["doc"].dataType.simpleString()
    return source.mapInArrow(_cut_udf(shared, capacity, end_id), f"doc {kind}, {_PIECE}")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces``, which have a ``length`` from 1 to ``capacity``, with sequence_id and offset.

    The sequences are those of best fit with the longest pieces first; a
    sequence's pieces lie end to end from offset 0. Pieces of equal length take
    their slots in the order of all their columns, and equal rows have a slot
    each. No rows give no rows.
    """
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    plan = Plan(counts, capacity)
    before, firsts = 0, {}
    for length in sorted(counts):
        firsts[length], before = before, before + counts[length]
    base = np.zeros(capacity + 1, np.int64)
    base[list(firsts)] = list(firsts.values())
    shared = pieces.sparkSession.sparkContext.broadcast((plan, base))
    order = [F.col("length"), *[F.col(f"`{c}`") for c in pieces.columns if c != "length"]]
    ranked = numbered(pieces, order, "__number", 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    arrow = [*to_arrow_schema(pieces.schema), pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, base = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = plan.slots(length, batch.column("__number").to_numpy() - base[length])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in arrow[:-2]], pa.array(sequence), pa.array(offset)],
                schema=pa.schema(arrow))

    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """All documents as token ids in sequences of at most ``capacity``: one row for each piece.

    Columns: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset.
    A NULL or empty text is its end id alone. Only a document of more than
    ``capacity`` ids is cut, into pieces of that length and a last one. Repeated
    rows are packed each, an empty table gives no rows, and other columns of
    ``docs`` do not matter, whatever their names.
    """
    pieces = tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)
    return pack(pieces, capacity).withColumnRenamed("doc", id_col)
