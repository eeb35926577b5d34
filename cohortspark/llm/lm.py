"""Language-model scores from a log-bilinear model trained by noise-contrastive estimation.

The model predicts one of a fixed number of outputs from the two before: the end of a text,
the ``heads`` most frequent words, and classes of all other words by their first two bytes. Inside
a class, words have add-one unigram probabilities over the whole vocabulary, so that
``log P(word) = log P(output | context) + log P(word | class)`` is normalised. The first part is
log-bilinear: context vectors, each under the matrix of its position, add up to a
predicted vector, whose products with all output vectors are normalised at once.

What covers the corpus is counted by Spark over every training text: the words, and the triples of
outputs, of which there are at most ``outputs^3``. Training draws from the triples, in
their proportions, in numpy on the driver. The number of steps follows the square root of the training tokens:
the parameters are of a fixed number, and the noise of their estimate falls with the root of the draws.

The vocabulary grows with the corpus and is never broadcast. Documents are dealt to blocks
of bounded size; each block asks for the counts of the words it holds (an equality join on the words'
64-bit hashes) and scores its documents with the answer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, in_fold, inputs, stage

by_value(__name__)

END = 0
KNOWN_WORDS = 300_000
LEAST_STEPS = 4000


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lowered; bytes split at the six ASCII white-space characters only."""
    return (text or "").encode().lower().split()


def key_of(word: bytes) -> int:
    """A signed 64-bit hash of a word."""
    from xxhash import xxh64_intdigest

    value = xxh64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


def start_of(word: bytes) -> int:
    """The first two bytes as a number."""
    return int.from_bytes(word[:2].ljust(2, b"\0"), "big")


@dataclass
class Outputs:
    """The numbering of outputs: 0 is the end, then head words, then classes, the rest last."""

    heads: dict[int, int]
    starts: dict[int, int]

    @property
    def count(self) -> int:
        return 2 + len(self.heads) + len(self.starts)

    def of(self, word: bytes) -> int:
        head = self.heads.get(key_of(word))
        return self.starts.get(start_of(word), self.count - 1) if head is None else head


class WordOutputs(dict):
    """Outputs of the words met, kept while the table is small."""

    def __init__(self, outputs: Outputs):
        super().__init__()
        self.outputs = outputs

    def __missing__(self, word):
        self[word] = out = self.outputs.of(word)
        return out

    def of_text(self, text) -> np.ndarray:
        if len(self) > KNOWN_WORDS:
            self.clear()
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def triples(outputs: np.ndarray, count: int) -> np.ndarray:
    """Code of (second last, last, this) for each output of a text and its end.

    Before the first stands ``count``, which is only ever a context.
    """
    line = np.concatenate([[count, count], outputs, [END]])
    return (line[:-2] * (count + 1) + line[1:-1]) * count + line[2:]


def word_counts(train: DataFrame) -> DataFrame:
    """(key, start, total): how often each word occurs in all texts of ``train``."""

    def count(batches):
        from collections import Counter

        def rows(counts):
            keys = [(key_of(w), start_of(w), n) for w, n in counts.items()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*keys), (pa.int64(), pa.int32(), pa.int64()))],
                ["key", "start", "total"],
            )

        counts = Counter()
        for batch in batches:
            for text in batch.column(0):
                counts.update(words_of(text.as_py()))
                if len(counts) > 4 * KNOWN_WORDS:
                    yield rows(counts)
                    counts = Counter()
        if counts:
            yield rows(counts)

    return (
        train.select("text").mapInArrow(count, "key long, start int, total long")
        .groupBy("key").agg(F.max("start").alias("start"), F.sum("total").alias("total"))
    )


def triple_counts(train: DataFrame, outputs: Outputs) -> np.ndarray:
    """How often each triple of outputs occurs in all texts of ``train``."""
    size = outputs.count * (outputs.count + 1) ** 2

    def count(batches):
        known, total, held, pending = WordOutputs(outputs), np.zeros(size, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(triples(known.of_text(text.as_py()), outputs.count))
                pending += len(held[-1])
                if pending > size:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, pending = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "total"])

    rows = (
        train.select("text").mapInArrow(count, "code long, total long")
        .groupBy("code").agg(F.sum("total").alias("total")).toArrow()
    )
    total = np.zeros(size, np.int64)
    total[rows["code"].to_numpy()] = rows["total"].to_numpy()
    return total


@dataclass
class LogBilinear:
    """Context and output vectors, one matrix per context position, and output biases."""

    contexts: np.ndarray
    outputs: np.ndarray
    matrices: np.ndarray
    bias: np.ndarray

    def log10(self) -> np.ndarray:
        """Normalised log10 probabilities, one row per context code, a column per output."""
        parts = [self.contexts @ m for m in self.matrices]
        predicted = (parts[0][:, None, :] + parts[1][None, :, :]).reshape(-1, self.outputs.shape[1])
        scores = predicted @ self.outputs.T + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        scores -= np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return (scores / np.log(10)).astype(np.float32)


def steps_for(tokens: int) -> int:
    """Gradient steps for so many training tokens: half their square root, and at least ``LEAST_STEPS``."""
    return max(LEAST_STEPS, math.isqrt(tokens) // 2)


def train_bilinear(
    counts: np.ndarray, count: int, size: int = 32, steps: int | None = None, batch: int = 1024, noise: int = 32, rate: float = 0.1, seed: int = 7
) -> LogBilinear:
    """Noise-contrastive estimation over triples drawn in proportion to their counts.

    A batch shares its noise words, drawn from the unigram distribution, so that all scores are
    matrix products; steps (``steps_for`` all triples by default) are AdaGrad. Biases begin at the unigram log probabilities. Without any
    triple the model is uniform.
    """
    random = np.random.default_rng(seed)
    shape = (count + 1, size)
    unigram = counts.reshape(-1, count).sum(axis=0) + 0.5
    unigram = unigram / unigram.sum()
    model = LogBilinear(
        random.normal(0, 0.1, shape), random.normal(0, 0.1, (count, size)),
        np.stack([np.eye(size)] * 2), np.log(unigram),
    )
    used = np.flatnonzero(counts)
    if not len(used):
        model.outputs[:] = 0
        return model
    ladder = np.cumsum(counts[used]) / counts.sum()
    squares = [np.full(p.shape, 1e-6) for p in (model.contexts, model.outputs, model.matrices, model.bias)]

    def step(index, parameter, gradient):
        squares[index] += gradient**2
        parameter -= rate * gradient / np.sqrt(squares[index])

    for _ in range(steps_for(int(counts.sum())) if steps is None else steps):
        code = used[np.minimum(np.searchsorted(ladder, random.random(batch), side="right"), len(used) - 1)]
        word, last = code % count, code // count % (count + 1)
        before = code // (count * (count + 1))
        drawn = random.choice(count, noise, p=unigram)
        a, b = model.contexts[before], model.contexts[last]
        predicted = a @ model.matrices[0] + b @ model.matrices[1]
        log_noise = np.log(noise * unigram)
        data = (predicted * model.outputs[word]).sum(axis=1) + model.bias[word] - log_noise[word]
        other = predicted @ model.outputs[drawn].T + model.bias[drawn] - log_noise[drawn]
        pull = (1 / (1 + np.exp(-np.clip(data, -30, 30))) - 1) / batch
        push = 1 / (1 + np.exp(-np.clip(other, -30, 30))) / batch
        toward = pull[:, None] * model.outputs[word] + push @ model.outputs[drawn]
        for_outputs, for_bias = np.zeros_like(model.outputs), np.zeros(count)
        np.add.at(for_outputs, word, pull[:, None] * predicted)
        np.add.at(for_outputs, drawn, push.T @ predicted)
        np.add.at(for_bias, word, pull)
        np.add.at(for_bias, drawn, push.sum(axis=0))
        for_contexts = np.zeros_like(model.contexts)
        np.add.at(for_contexts, before, toward @ model.matrices[0].T)
        np.add.at(for_contexts, last, toward @ model.matrices[1].T)
        for_matrices = np.stack([a.T @ toward, b.T @ toward])
        for index, (parameter, gradient) in enumerate(
            ((model.contexts, for_contexts), (model.outputs, for_outputs), (model.matrices, for_matrices), (model.bias, for_bias))
        ):
            step(index, parameter, gradient)
    return model


def choose_outputs(counts: DataFrame, heads: int, classes: int) -> Outputs:
    """The most frequent words, and the most frequent starts of the others."""
    top = counts.orderBy(F.desc("total"), "key").limit(heads).select("key").collect()
    chosen = {r[0]: 1 + i for i, r in enumerate(top)}
    starts = (
        counts.filter(~F.col("key").isin(list(chosen))).groupBy("start").agg(F.sum("total").alias("total"))
        .orderBy(F.desc("total"), "start").limit(classes).select("start").collect()
    )
    return Outputs(chosen, {r[0]: 1 + len(chosen) + i for i, r in enumerate(starts)})


def score_texts(
    docs: DataFrame,
    trained_on,
    heads: int = 63,
    classes: int = 63,
    block_chars: int = 1 << 24,
    doc_id: str = "doc_id",
    text: str = "text",
    **training,
) -> DataFrame:
    """(doc_id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``trained_on`` is a condition on ``doc_id`` (the role name): the rows to learn from. A text's tokens are
    its words and one end; a null text has the end alone. ``base_score`` is add-one unigram,
    with all words unseen in training as one; ``score`` is the model's log10 probability of the text.
    Rows repeated count and are scored each for itself. Without any training row, counts are
    zero and the model is uniform over its outputs. An empty table gives no rows.
    """
    rows = inputs(docs, "documents", doc_id=doc_id, text=text).withColumn("trained", trained_on)
    train = rows.filter("trained")
    counts = stage(word_counts(train))
    sizes = rows.agg(
        F.sum(F.length("text")), F.sum(F.col("trained").cast("long"))
    ).first()
    chars, ends = sizes[0] or 0, sizes[1] or 0
    outputs = choose_outputs(counts, heads, classes)
    model = train_bilinear(triple_counts(train, outputs), outputs.count, **training)
    # Words and tokens by class, heads left out, and over all.
    ranks = F.create_map(*[F.lit(x) for pair in outputs.starts.items() for x in pair]) if outputs.starts else None
    group = F.coalesce(ranks[F.col("start")], F.lit(outputs.count - 1)) if ranks is not None else F.lit(outputs.count - 1)
    by_class = (
        counts.withColumn("output", F.when(F.col("key").isin(list(outputs.heads)), -1).otherwise(group))
        .groupBy("output").agg(F.sum("total").alias("total"), F.count("*").alias("words")).collect()
    )
    train_tokens = ends + sum(r["total"] for r in by_class)
    vocabulary = (ends > 0) + sum(r["words"] for r in by_class)
    inside = np.zeros(outputs.count)
    for r in by_class:
        if r["output"] >= 0:
            inside[r["output"]] = -np.log10(r["total"] + r["words"] + 1)
    below = np.log10(train_tokens + vocabulary + 1)
    end_known = int(ends > 0)

    blocks = max(1, -(-chars // block_chars))
    spread = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    dealt = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "trained", spread.alias("block")).repartition(blocks, "block")

    def distinct_words(table):
        words = set()
        for value in table.column("text"):
            words.update(words_of(value.as_py()))
        keys = np.fromiter(map(key_of, words), np.int64, len(words))
        block = pa.array(np.full(len(keys), table.column("block")[0].as_py(), np.int32))
        return pa.table({"key": pa.array(keys), "asked": block})

    asked = dealt.groupBy("block").applyInArrow(distinct_words, "key long, asked int")
    answers = asked.join(counts.select("key", "total"), "key").select(F.col("asked").alias("block"), "key", "total")

    def score(own, known):
        keys, totals = known.column("key").to_numpy(), known.column("total").to_numpy()
        order = np.argsort(keys)
        keys, totals = keys[order], totals[order]
        places: dict[bytes, int] = {}
        texts = []
        for value in own.column("text"):
            words = words_of(value.as_py())
            texts.append(np.fromiter((places.setdefault(w, len(places)) for w in words), np.int32, len(words)))
        hashed = np.fromiter(map(key_of, places), np.int64, len(places))
        found = np.zeros(len(places), np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            found = np.where(keys[at] == hashed, totals[at], 0)
        log_c, seen = np.log10(found + 1), found > 0
        out_of = np.fromiter(map(outputs.of, places), np.int64, len(places))
        table, end_log, out = model.log10().reshape(-1), np.log10(ends + 1), []
        for key, ids, flag in zip(own.column("doc_id"), texts, own.column("trained")):
            logs, outs = log_c[ids], out_of[ids]
            base = logs.sum() + end_log - (len(ids) + 1) * below
            tail = outs > len(outputs.heads)
            chosen = table[triples(outs, outputs.count)].sum(dtype=np.float64) + (logs + inside[outs])[tail].sum()
            out.append((key.as_py(), flag.as_py(), len(ids) + 1, int(seen[ids].sum()) + end_known, float(base), float(chosen)))
        columns = list(zip(*out)) or [()] * 6
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ("doc_id", "trained", "n_tokens", "n_known", "base_score", "score")
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))

    result = (
        dealt.groupBy("block").cogroup(answers.groupBy("block"))
        .applyInArrow(score, "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double")
    )
    return result.withColumn("train_tokens", F.lit(int(train_tokens)).cast("long"))


def held_out_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, **options) -> DataFrame:
    """``score_texts`` learning from the ids outside one fold; ``held_out`` is that fold."""
    scored = score_texts(docs, ~in_fold("doc_id", modulus, remainder), **options)
    return scored.select(
        "doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
