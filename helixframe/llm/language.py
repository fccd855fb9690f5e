"""Language identification: averaged hashed subword embeddings under a linear softmax.

Words are runs of letters, lower-cased, between single spaces; their character n-grams of ``GRAMS``
code points, boundaries included, are hashed into ``BUCKETS`` rows of an embedding table. A text is
the mean of its n-grams' embeddings, and a linear softmax over the mean gives the languages'
probabilities. Embeddings and softmax are trained together by stochastic gradient descent in numpy,
on a bounded sample of labelled texts: ``FIT_ROWS`` rows and in expectation ``FIT_BYTES`` bytes, the same
share for each language, texts of at most ``FIT_TEXT_BYTES`` each, taken by hash of the text. A fifth of
the sample, again by hash, is kept from training and calibrates: a temperature divides the logits so
that probabilities fit (least log loss), and texts are rejected below the least probability at which the
accepted ones are right with ``TARGET`` share.

The layer after the mean is linear, so tasks that predict look up the product of embedding and
softmax, one number per bucket and language, and read whole texts in pieces of bounded size.

Defined results: a null text, or one without a letter, is ``und`` with score 0.0, and so is every text
when no row teaches a language. Learned are the values of lang as they stand, but null ones; a single
value has score 1.0 everywhere. Rows whose id is null are training rows. Repeated rows are
predicted each for itself. Columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import by_batches, text_of
from .toxicity import held_out

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
DIMENSIONS = 16
FIT_ROWS = 4_000
FIT_BYTES = 8 << 20
FIT_TEXT_BYTES = 1 << 16
EPOCHS = 3
RATE = 0.5
#: Share of accepted texts that calibration wants right.
TARGET = 0.995
#: Code points of a text that are hashed at once.
PIECE = 1 << 18
SEED = 7
UNKNOWN = "und"
_BREAK = re.compile(r"[\W\d_]+")


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams with repeats, a bounded piece of the text at a time."""
    clean = f" {_BREAK.sub(' ', text.lower()).strip()} "
    overlap = max(GRAMS) - 1
    for at in range(0, max(len(clean) - overlap, 1), PIECE):
        codes = np.frombuffer(clean[at : at + PIECE + overlap].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        last = at + PIECE + overlap >= len(clean)
        mixed = np.zeros(len(codes), np.uint64)
        found = []
        for n in range(1, max(GRAMS) + 1):
            if len(codes) < n:
                break
            mixed = mixed[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
            if n in GRAMS:
                # Starts in the overlap belong to the next piece.
                own = mixed if last else mixed[:PIECE]
                hashed = own ^ (own >> np.uint64(31))
                hashed = hashed * np.uint64(0xBF58476D1CE4E5B9)
                found.append(hashed >> np.uint64(64 - BUCKETS.bit_length() + 1))
        yield np.concatenate(found).astype(np.int32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its n-grams that each has."""
    parts = [*grams(text)]
    buckets, times = np.unique(np.concatenate(parts), return_counts=True)
    return buckets, times / times.sum()


@dataclass
class Model:
    """Languages, their logits per bucket (an n-gram's embedding times the softmax), bias, temperature, rejection bound."""

    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, texts: list[str]) -> np.ndarray:
        rows = np.empty((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            total, n = np.zeros(len(self.languages)), 0
            for found in grams(text):
                total += self.logits[found].sum(axis=0, dtype=np.float64)
                n += len(found)
            rows[i] = total / n + self.bias
        return softmax(rows / self.temperature)


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, softmax weights and bias by stochastic gradient descent with a rate that falls to 0."""
    rng = np.random.default_rng(SEED)
    table = (rng.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS).astype(np.float32)
    weights, bias = np.zeros((DIMENSIONS, n_classes), np.float32), np.zeros(n_classes, np.float32)
    steps = max(EPOCHS * len(rows), 1)
    # Rare languages count as much as common ones.
    size = np.bincount(y, minlength=n_classes)
    importance = np.minimum(len(y) / (n_classes * np.maximum(size, 1)), 10.0)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, share = rows[i]
            rate = RATE * (1 - step / steps)
            mean = share @ table[buckets]
            error = softmax(mean @ weights + bias)
            error[y[i]] -= 1
            error *= importance[y[i]]
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * 0.1 * error
            # A mean over many n-grams moves each little: steps are scaled by the largest share.
            table[buckets] -= np.outer(share * (rate / share.max()), back)
            step += 1
    return table, weights, bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the least probability whose accepted rows are right often enough."""
    if not len(y):
        return 1.0, 0.0
    place = np.arange(len(y))
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[place, y], 1e-300)).mean()
    temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    p = softmax(logits / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == y
    order = np.argsort(-best, kind="stable")
    accepted = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    # Texts of one probability are accepted or rejected together.
    ends = np.r_[best[order][1:] != best[order][:-1], True]
    good = np.flatnonzero((accepted >= TARGET) & ends)
    return temperature, float(best[order][good[-1]]) if len(good) else 1.0


def has_letter(name: str = "text") -> Column:
    return F.coalesce(F.col(name).rlike(r"\p{L}"), F.lit(False))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [counted(t) for t in batch.column(0).to_pylist()]
        columns = [
            pa.array([b.astype("<i4").tobytes() for b, _ in rows], pa.binary()),
            pa.array([s.astype("<f4").tobytes() for _, s in rows], pa.binary()),
        ]
        yield pa.record_batch([*columns, batch.column(1), batch.column(2)], names=["buckets", "shares", "lang", "h"])


def sample(docs: DataFrame) -> DataFrame:
    """text, lang and hash of the bounded sample of training rows."""
    known = docs.where(~held_out() & F.col("lang").isNotNull() & has_letter()).select(
        "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text", "lang").alias("h"), F.octet_length("text").alias("n")
    )
    fitting = known.where(F.col("n") <= FIT_TEXT_BYTES)
    sizes = pin(fitting.groupBy("lang").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes")))
    languages = sizes.count()
    if not languages:
        return fitting.select("text", "lang", "h")
    share = F.least(F.lit(FIT_ROWS / languages) / F.col("rows"), F.lit(FIT_BYTES / languages) / F.col("bytes"))
    # 2^20 steps of the hash; every language keeps its rows below the same number of bytes and rows.
    below = F.least(share, F.lit(1.0)) * F.lit(float(1 << 20))
    drawn = join_measured(fitting, sizes.select("lang", below.alias("_below")), ["lang"]).where(F.pmod(F.col("h"), F.lit(1 << 20)) < F.col("_below"))
    return drawn.select("text", "lang", "h").orderBy("h", "lang").limit(FIT_ROWS)


def train(docs: DataFrame) -> Model:
    """The model of the training rows' texts and languages (a bounded sample comes to the driver)."""
    packed = by_batches(sample(docs), _packed, "buckets binary, shares binary, lang string, h bigint")
    rows = packed.distinct().orderBy("h", "lang", "buckets").toArrow()
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    if len(languages) < 2:
        return Model(languages, np.zeros((BUCKETS, len(languages)), np.float32), np.zeros(len(languages)))
    y = np.array([languages.index(n) for n in names])
    found = [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(s.as_buffer(), "<f4")) for b, s in zip(rows["buckets"], rows["shares"])]
    kept_back = (rows["h"].to_numpy() >> 20) % 5 == 0
    if len(set(y[~kept_back])) < len(languages) or not kept_back.any():
        kept_back = np.zeros(len(y), bool)
    fit = np.flatnonzero(~kept_back)
    table, weights, bias = descend([found[i] for i in fit], y[fit], len(languages))
    logits = table @ weights
    check = np.flatnonzero(kept_back)
    means = np.array([s @ logits[b] for b, s in (found[i] for i in check)]).reshape(len(check), len(languages))
    temperature, least = calibrate(means + bias, y[check])
    return Model(languages, logits.astype(np.float32), bias, temperature, least)


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred (the likeliest language), score (its probability) and accepted, of every row."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            told = np.flatnonzero(batch.column(1).to_numpy(zero_copy_only=False)) if model.languages else []
            if len(told):
                p = model.probabilities(batch.column(2).take(pa.array(told)).to_pylist())
                best = p.argmax(axis=1)
                scores[told] = p[np.arange(len(told)), best]
                for i, b in zip(told, best):
                    names[i] = model.languages[b]
            accepted = (scores >= model.least) & (np.array(names, object) != UNKNOWN)
            columns = [batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(accepted.astype(bool))]
            yield pa.record_batch(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_letter().alias("told"), text_of().alias("text"))
    return by_batches(rows, predict, "doc_id bigint, lang_pred string, score double, accepted boolean")


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, language (``und`` where the model rejects its own best guess) and score."""
    language = F.when(F.col("accepted"), F.col("lang_pred")).otherwise(UNKNOWN)
    return predicted(docs, model).select("doc_id", language.alias("language"), "score")


def report(docs: DataFrame) -> DataFrame:
    return predicted(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
