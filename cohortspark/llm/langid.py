"""Language identification from TF-IDF character n-grams.

A sparse multinomial logistic regression, trained with follow-the-regularised-leader
(per-coordinate steps, elastic-net penalties) and calibrated with one temperature.

Document frequencies cover every training text and are counted by Spark. Only the fit uses
a sample, whose bound is a parameter: ``sample_rows`` rows over all languages, the same
number for each, taken by the hash of the id. The sample's n-gram counts (at most
``2 ** bits`` per row) and the model (``2 ** bits`` weights per language) are what the
driver holds; both are independent of the number of documents.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import local_table
from .common import by_value, inputs, spare, tidy

by_value(__name__)

UNDETERMINED = "und"
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def letter_bits() -> bytes:
    """One bit per code point: whether it is a letter."""
    flags = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return np.packbits(flags).tobytes()


class Grams:
    """Hashed counts of the 1- to ``longest``-grams of a text's lower-case letters.

    Everything that is no letter becomes one blank; a gram of blanks only does not count.
    """

    def __init__(self, letters: bytes, bits: int, longest: int):
        self.letters = np.unpackbits(np.frombuffer(letters, np.uint8)).astype(bool)
        self.bits, self.longest = bits, longest

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        points = np.where(self.letters[points], points, np.uint32(0))
        keep = points != 0
        keep[1:] |= points[:-1] != 0
        keep[:1] = True
        points = np.concatenate([[0], points[keep], [0]]).astype(np.uint32)
        buckets = []
        for length in range(1, self.longest + 1):
            count = len(points) - length + 1
            if count <= 0:
                break
            code = np.full(count, length, np.uint32)
            for i in range(length):
                code = (code ^ points[i : i + count]) * np.uint32(MULTIPLIERS[i % 4])
                code ^= code >> np.uint32(15)
            if length == 1:
                code = code[points != 0]
            buckets.append(code >> np.uint32(32 - self.bits))
        counts = np.bincount(np.concatenate(buckets).astype(np.int64), minlength=1 << self.bits)
        used = np.flatnonzero(counts)
        return (used, counts[used]) if (points != 0).any() else (used[:0], used[:0])


@dataclass
class LanguageModel:
    """``weights``: 2^bits rows, one column per language; empty without training rows."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    bits: int
    longest: int


def vector(used: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights with logarithmic counts, of length one."""
    values = (1 + np.log(counts)) * idf[used]
    norm = np.sqrt((values**2).sum())
    return values / norm if norm else values


def softmax(scores: np.ndarray) -> np.ndarray:
    powers = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def follow_the_leader(rows, labels, size, classes, alpha, beta, l1, l2, epochs, batch=32):
    """Weights and bias: FTRL-proximal on mini-batches, in the rows' order.

    ``rows`` are (positions, values). Each coordinate's weight follows from its running
    gradient sum ``z`` and squared-gradient sum ``n``; only coordinates whose ``z`` exceeds
    the L1 penalty are other than zero. The bias is coordinate ``size``, without penalty.
    """
    z, n = np.zeros((size + 1, classes)), np.zeros((size + 1, classes))

    def solve(at):
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    def solve_bias():
        return -z[size] * alpha / (beta + np.sqrt(n[size]))

    for _ in range(epochs):
        for start in range(0, len(rows), batch):
            part = rows[start : start + batch]
            touched, where = np.unique(np.concatenate([r[0] for r in part]), return_inverse=True)
            weights, bias = solve(touched), solve_bias()
            gradient, bias_gradient, at = np.zeros_like(weights), np.zeros(classes), 0
            for (used, values), label in zip(part, labels[start : start + batch]):
                local = where[at : at + len(used)]
                at += len(used)
                error = softmax(values @ weights[local] + bias)
                error[label] -= 1
                gradient[local] += values[:, None] * error
                bias_gradient += error
            for index, g, w in ((touched, gradient, weights), (size, bias_gradient, bias)):
                squares = n[index] + g**2
                z[index] += g - (np.sqrt(squares) - np.sqrt(n[index])) / alpha * w
                n[index] = squares
    return solve(np.arange(size)), solve_bias()


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    One row's worth of doubt is spread over the labels, so that a faultless sample does not make all
    certain.
    """
    if not len(scores):
        return 1.0
    doubt = 1 / (len(scores) + 1)

    def loss(t):
        shifted = scores / np.exp(t)
        shifted = shifted - shifted.max(axis=1, keepdims=True)
        aimed = (1 - doubt) * shifted[np.arange(len(labels)), labels] + doubt * shifted.mean(axis=1)
        return (np.log(np.exp(shifted).sum(axis=1)) - aimed).sum()

    low, high, ratio = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(train: DataFrame, bits: int, longest: int, letters: bytes) -> tuple[int, np.ndarray]:
    """Texts with letters, and in how many of them each bucket occurs."""
    size = 1 << bits

    def count(batches):
        grams, total = Grams(letters, bits, longest), np.zeros(size + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                used, _ = grams(text.as_py())
                total[used] += 1
                total[size] += len(used) > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "texts"])

    rows = (
        train.select("text").mapInArrow(tidy(count), "bucket long, texts long")
        .groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()
    )
    total = np.zeros(size + 1, np.int64)
    total[rows["bucket"].to_numpy()] = rows["texts"].to_numpy()
    return int(total[size]), total[:size]


def train_language_model(
    train: DataFrame,
    sample_rows: int = 4000,
    bits: int = 15,
    longest: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.01,
    l2: float = 0.1,
    epochs: int = 4,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> LanguageModel:
    """A calibrated model from the rows with an id, a text and a language.

    A fifth of the sample is kept from the fit and sets the temperature. Rows repeated under
    one id and language count once in the sample. Without any row the model knows no language.
    """
    train = inputs(train, "documents", doc_id=doc_id, text=text, lang=lang).dropna()
    letters = letter_bits()
    total, frequency = document_frequencies(train, bits, longest, letters)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    rows_of = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    languages = sorted(rows_of)
    empty = LanguageModel([], idf, np.zeros((1 << bits, 0)), np.zeros(0), 1.0, bits, longest)
    if not languages:
        return empty
    share = max(10, sample_rows // len(languages))
    # A hash below a language's rate keeps about twice its share, so few rows are ranked.
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    rates = F.create_map(*[F.lit(x) for lang in languages for x in (lang, 2.0 * share / rows_of[lang])])
    chosen = (
        train.select("doc_id", "lang").withColumn("place", order)
        .filter(F.col("place") / 2.0**64 + 0.5 < rates[F.col("lang")]).distinct()
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
        .filter(F.col("rank") <= share).select("doc_id", "lang", "place").toArrow().to_pylist()
    )
    wanted = local_table(
        train.sparkSession, [(r["doc_id"], r["lang"], r["place"]) for r in chosen],
        f"doc_id {train.schema['doc_id'].dataType.simpleString()}, lang string, place long",
    )

    def features(batches):
        grams = Grams(letters, bits, longest)
        for batch in batches:
            pairs = [grams(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([u.astype("<i4").tobytes() for u, _ in pairs], pa.binary()),
                    pa.array([c.astype("<i4").tobytes() for _, c in pairs], pa.binary()),
                ],
                ["place", "lang", "used", "counts"],
            )

    # ``wanted`` has at most ``sample_rows`` rows (ten per language at least).
    rows = (
        train.join(F.broadcast(wanted), ["doc_id", "lang"]).select("place", "lang", "text")
        .mapInArrow(tidy(features), "place long, lang string, used binary, counts binary")
        .groupBy("place", "lang").agg(F.max(F.struct("used", "counts")).alias("gram"))
        .select("place", "lang", "gram.used", "gram.counts").toArrow().to_pylist()
    )
    rows = sorted((r for r in rows if r["used"]), key=lambda r: (r["place"], r["lang"]))
    data = []
    for row in rows:
        used = np.frombuffer(row["used"], "<i4").astype(np.int64)
        data.append((used, vector(used, np.frombuffer(row["counts"], "<i4"), idf)))
    labels = np.array([languages.index(r["lang"]) for r in rows], np.int64)
    if not data:
        return empty
    held = np.arange(len(data)) % 5 == 4
    fit = [i for i in range(len(data)) if not held[i]]
    weights, bias = follow_the_leader(
        [data[i] for i in fit], labels[fit], 1 << bits, len(languages), alpha, beta, l1, l2, epochs
    )
    checked = [i for i in range(len(data)) if held[i]]
    scores = np.array([data[i][1] @ weights[data[i][0]] + bias for i in checked]).reshape(-1, len(languages))
    temperature = best_temperature(scores, labels[checked])
    return LanguageModel(languages, idf, weights, bias, temperature, bits, longest)


def predict_languages(
    docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = (), text: str = "text"
) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``.

    A null text, one without letters, and any text under a model that knows no language get
    ``und`` and score 0. The score is the calibrated probability of the predicted language; ties go
    to the language first in order. Whole texts are read; a row's work is linear in its text.
    """
    columns = list(keep)
    source = docs.select(*[docs[c] for c in columns], docs[text].alias("__text"))
    from pyspark.sql import types as T

    schema = T.StructType([*[docs.schema[c] for c in columns], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    letters = letter_bits()

    def run(batches):
        grams = Grams(letters, model.bits, model.longest)
        for batch in batches:
            predicted, scores = [], []
            for value in batch.column(len(columns)):
                used, counts = grams(value.as_py())
                if not len(used) or not model.languages:
                    predicted.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                raw = vector(used, counts, model.idf) @ model.weights[used] + model.bias
                chance = softmax(raw / model.temperature)
                best = int(chance.argmax())
                predicted.append(model.languages[best])
                scores.append(float(chance[best]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(columns)], pa.array(predicted, pa.string()), pa.array(scores, pa.float64())],
                [*columns, "lang_pred", "score"],
            )

    return source.mapInArrow(tidy(run), schema)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined with a score of at least ``least``."""
    names = docs.columns
    clash = dict(zip(names, spare(docs, *[f"kept_{c}" for c in names])))
    plain = docs.withColumnsRenamed({c: clash[c] for c in names if c.lower() in ("lang_pred", "score", "__text")})
    back = {clash[c]: c for c in names}
    out = predict_languages(plain, model, tuple(plain.columns), clash[text] if clash[text] in plain.columns else text)
    sure = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)
    return out.filter(sure).drop("lang_pred", "score").withColumnsRenamed(back).select(*names)
