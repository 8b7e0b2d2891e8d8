"""Language identification: sparse multinomial logistic regression on TF-IDF n-grams.

Character n-grams of letters and word borders are hashed to a fixed number of
features. Document frequencies come from all learning documents; the weights
are fitted by follow-the-regularised-leader with L1 and L2 penalties on a
sample of at most ``sample_rows`` distinct ones, as many for each language;
the temperature of the scores is fitted on a part of the sample that the
weights have not seen. Every document is judged by its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cliplens.llm import charclass
from cliplens.session import materialize

FEATURES = 1 << 15
ORDERS = (1, 2, 3)
UNDECIDED = "und"
SAMPLE_ROWS = 3000
HOLD_BACK = 5  # every fifth sampled row of a language calibrates
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def letter_table() -> np.ndarray:
    """Code point -> its lower case if it is a letter, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (char := chr(c)).isalpha():
            low = char.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def text_features(texts: list[str | None], table: np.ndarray):
    """(features, counts) of each text; both empty if it has no letter."""
    texts = [t or "" for t in texts]
    for lo, hi in charclass.groups_of(texts):
        data, offsets = charclass.code_points(texts[lo:hi])
        letters = table[data]
        keep = letters != 0
        keep[1:] |= letters[:-1] != 0  # one mark for each run of other characters
        begins = offsets[:-1][offsets[:-1] < len(keep)]
        keep[begins] = True
        has = np.zeros(len(letters) + 1, np.int64)
        np.cumsum(letters != 0, out=has[1:])
        has = np.diff(has[offsets])
        at = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        at, x = at[offsets], letters[keep]
        grams = []
        for n in ORDERS:
            h = np.zeros(max(0, len(x) - n + 1), np.uint32)
            for i in range(n):
                h = (h ^ x[i:i + len(h)]) * _FACTORS[i] + np.uint32(n)
                h ^= h >> np.uint32(15)
            grams.append((h * _FACTORS[0]) >> np.uint32(17))
        for i in range(hi - lo):
            if not has[i]:
                yield np.empty(0, np.int64), np.empty(0)
                continue
            a, b = at[i], at[i + 1]
            counts = np.bincount(np.concatenate([
                g[a:max(a, b - n + 1)] for n, g in zip(ORDERS, grams)]), minlength=FEATURES)
            found = np.flatnonzero(counts)
            yield found, counts[found]


def weigh(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit-length TF-IDF weights with damped counts."""
    x = (1.0 + np.log(counts)) * idf[found]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int,
               alpha: float = 1.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002,
               epochs: int = 6, seed: int = 42) -> np.ndarray:
    """Weights (features + 1, classes); the last row is the intercept."""
    z = np.zeros((FEATURES + 1, classes))
    n = np.zeros_like(z)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / (
            (beta + np.sqrt(ns)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = np.append(rows[i][0], FEATURES), np.append(rows[i][1], 1.0)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            p = softmax(x @ w)
            p[labels[i]] -= 1.0
            g = x[:, None] * p[None, :]
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class LanguageModel:
    """Languages, IDF, weights and temperature; predicts from text alone."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray,
                 temperature: float, table: np.ndarray):
        self.languages, self.idf, self.table = languages, idf, table
        self.weights, self.temperature = weights, temperature

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for found, counts in text_features(texts, self.table):
            if not len(found) or not self.languages:
                names.append(UNDECIDED)
                scores.append(0.0)
                continue
            x = weigh(found, counts, self.idf)
            p = softmax((x @ self.weights[found] + self.weights[-1]) / self.temperature)
            best = int(p.argmax())
            names.append(self.languages[best])
            scores.append(float(min(1.0, p[best])))
        return names, scores


def _frequency_udf(shared):
    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for found, _ in text_features(batch.column(0).to_pylist(), shared.value):
                total[found] += 1
                rows += bool(len(found))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, -1), pa.int64()),
             pa.array(np.append(total[used], rows), pa.int64())], names=["feature", "n"])

    return frequencies


def _sample_udf(shared):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(text_features(batch.column(2).to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                names=["lang", "draw", "found", "counts"])

    return features


def sample(learn: DataFrame, rows: int) -> DataFrame:
    """(lang, draw, text): the same number of texts for each language, as far as it has them.

    Equal rows are one before anything is drawn, and texts without a letter take
    no part. Within each language the ``rows`` / languages smallest draws, hashes
    of the row, are taken, one at least.
    """
    draw = F.shiftrightunsigned(F.xxhash64("text", "lang"), 1)
    able = learn.where(F.col("text").rlike(r"\p{L}")).select("lang", draw.alias("draw"), "text")
    drawn = materialize(able.groupBy("lang", "draw").agg(F.count("*").alias("copies")), "language-draws")
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("n"))
    quota = max(1, rows // max(1, sizes.count()))
    # Twice the quota and more lies below the bound, so the window sees few rows.
    picked = drawn.join(F.broadcast(sizes), "lang").where(
        F.col("draw") < F.lit(2.0 ** 63 * (2 * quota + 100)) / F.col("n")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(
        F.col("rank") <= quota).select("lang", "draw")
    return able.join(F.broadcast(picked), ["lang", "draw"]).dropDuplicates(["lang", "draw"])


def train(learn: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from (lang, text) rows without NULL.

    Statistics are taken from all rows. The weights see a sample of at most
    ``sample_rows``, the same number of distinct rows for each language as far as
    it has them (see ``sample``; one each if there are more languages); only that sample's features and one
    count per feature reach the driver. Rows without letters teach nothing.
    """
    table = letter_table()
    shared = learn.sparkSession.sparkContext.broadcast(table)
    df = {r["feature"]: r["n"] for r in learn.select("text").mapInArrow(
        _frequency_udf(shared), "feature bigint, n bigint").groupBy("feature").agg(
        F.sum("n").alias("n")).collect()}
    documents = df.pop(-1, 0)
    counts = np.zeros(FEATURES)
    counts[list(df)] = list(df.values())
    idf = np.log((1.0 + documents) / (1.0 + counts)) + 1.0
    sampled = sample(learn, sample_rows).select("lang", "draw", "text").mapInArrow(
        _sample_udf(shared), "lang string, draw bigint, found array<int>, counts array<int>").where(
        F.size("found") > 0).toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    langs = sampled.column("lang").to_pylist()
    names = sorted(set(langs))
    labels = np.array([names.index(v) for v in langs], np.int64)
    rows = [(np.array(f.values.to_numpy(), np.int64), np.array(c.values.to_numpy(), np.float64))
            for f, c in zip(sampled.column("found"), sampled.column("counts"))]
    rows = [(f, weigh(f, c, idf)) for f, c in rows]
    late = np.zeros(len(rows), bool)
    for label in range(len(names)):
        late[np.flatnonzero(labels == label)[HOLD_BACK - 1::HOLD_BACK]] = True
    weights = train_ftrl([r for r, x in zip(rows, late) if not x], labels[~late], len(names))
    logits = np.array([x @ weights[f] + weights[-1] for (f, x), l in zip(rows, late) if l])
    return LanguageModel(names, idf, weights, fit_temperature(logits, labels[late]), table)


def _predict_udf(shared):
    def predict(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            names, scores = shared.value.predict(texts.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=["lang_pred", "score"])

    return F.arrow_udf(predict, "struct<lang_pred:string,score:double>").asNondeterministic()


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", out: str = "language",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with a struct ``out`` of ``lang_pred`` and ``score`` for each whole text.

    The model learns from text and label of the documents that ``held_out``
    does not keep back; a document without id is neither learned from nor held
    out. A NULL label teaches nothing.

    NULL texts and texts without a letter, empty ones among them, are "und"
    with score 0, and so is everything if nothing could be learned. Equal
    scores go to the first language in order. Repeated rows are judged alike,
    an empty table stays empty, and an existing column named ``out`` is replaced.
    """
    learn = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    shared = docs.sparkSession.sparkContext.broadcast(train(learn, sample_rows))
    return docs.withColumn(out, _predict_udf(shared)(F.col(text_col)))
