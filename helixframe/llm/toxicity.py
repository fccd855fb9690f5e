"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are hashed 5-grams of lower-cased code points, present or not, over the whole text; a
space stands before and after it. Counts per feature and label come from all labelled training
rows: each task counts into arrays and sends the features it met, and Spark sums them. The
log-count ratio of a feature is smoothed towards 0 in proportion to the class sizes. The classifier
is a logistic regression over presence times ratio of all features whose ratios lie ``MIN_STRENGTH``
standard errors from 0. It is fitted on a bounded sample of training texts (``FIT_ROWS`` and ``FIT_BYTES``, the first by
hash, each as often as it occurs), each with ratios that leave it out; a feature that no sampled text
has gets the mean weight of the others. The model, at most 16 bytes for each of ``BUCKETS``, goes to the tasks that score all texts.

Defined results: a null or empty text has only the bias and gets the score of a text without
features. Labels that are null or refer to no document teach nothing; of labels that contradict each
other 1 wins; rows whose id is null are never held out. Without training rows of both labels every score is the share of label 1 (0.0
without rows). Repeated rows are scored each for itself. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import by_batches, fresh, text_of

GRAM = 5
BUCKETS = 1 << 20
FIT_ROWS = 6_000
#: Bytes of the sampled texts' features, four each: what the driver fits on at most (one text may have more).
FIT_BYTES = 64 << 20
#: Ratios nearer to 0 than so many standard errors say nothing. This and the ridge were chosen by five folds
#: (by hash of the text) of the 2,990 training rows of the sf0.1 tables: of the pairs whose F1 at the threshold
#: lies within a standard error of the best (0.850; 3.0 with 1, 3 and 10), the one of least log loss.
MIN_STRENGTH = 3.0
SMOOTHING = 1.0
RIDGE = 10.0
HELD_OUT = 2
THRESHOLD = 0.3
_FLUSH_ROWS = 1 << 16


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def features(text: str) -> np.ndarray:
    """Buckets of the text's n-grams, with repeats."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    mixed = np.zeros(n, np.uint64)
    for i in range(GRAM):
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed += codes[i : i + n]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


class _Once:
    """Distinct values of small arrays, with one stamp per bucket instead of a sort."""

    def __init__(self) -> None:
        self.stamp = np.zeros(BUCKETS, np.int64)

    def __call__(self, found: np.ndarray) -> np.ndarray:
        order = np.arange(len(found))
        self.stamp[found] = order
        return found[self.stamp[found] == order]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, once = np.zeros((2, BUCKETS), np.int64), _Once()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[label, once(features(text))] += 1
    met = np.flatnonzero(counts.any(axis=0))
    for at in range(0, len(met), _FLUSH_ROWS):
        part = met[at : at + _FLUSH_ROWS]
        yield pa.record_batch([pa.array(part), pa.array(counts[0, part]), pa.array(counts[1, part])], names=["feature", "c0", "c1"])


def _training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    rows = docs.select("doc_id", text_of().alias("text"))
    return join_measured(rows.where(~held_out()), known.where(~held_out()), ["doc_id"])


def _logistic(x_rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, times_met: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps with conjugate gradients; x is sparse presence, scaled per label of the row and feature."""
    lengths = np.array([len(r) for r in x_rows])
    cols, rows = np.concatenate([*x_rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(y)), lengths)
    m, n = scale.shape[1], len(y)
    x = scale[y.astype(int)[rows], cols]
    times = lambda w: np.bincount(rows, x * w[cols], n) + w[-1]
    back = lambda v: np.append(np.bincount(cols, x * v[rows], m), v.sum())
    w, ridge = np.zeros(m + 1), np.append(np.full(m, RIDGE), 1e-6)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(times(w), -30, 30)))
        gradient = back(times_met * (p - y)) + ridge * w
        curve = times_met * np.maximum(p * (1 - p), 1e-6)
        step, residual = np.zeros(m + 1), -gradient
        direction, norm = residual.copy(), residual @ residual
        for _ in range(40):
            if norm < 1e-8:
                break
            product = back(curve * times(direction)) + ridge * direction
            alpha = norm / (direction @ product)
            step += alpha * direction
            residual -= alpha * product
            norm, old = residual @ residual, norm
            direction = residual + (norm / old) * direction
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature buckets, their weights (ratio included) and the bias."""
    rows = _training(docs, labels)
    sums = by_batches(rows.select("text", "label"), _count, "feature bigint, c0 bigint, c1 bigint")
    counts = pin(sums.groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    sizes = rows.groupBy("label").count().collect()
    n = {r["label"]: r["count"] for r in sizes}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    alpha1, alpha0 = SMOOTHING * n1 / (n0 + n1), SMOOTHING * n0 / (n0 + n1)
    ratio = F.log((F.col("c1") + alpha1) / n1) - F.log((F.col("c0") + alpha0) / n0)
    strength = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("c0") + 1) + 1 / (F.col("c1") + 1))
    rated = counts.withColumn("ratio", ratio).where(strength >= MIN_STRENGTH)
    chosen = rated.select("feature", "ratio", "c0", "c1").toArrow().sort_by("feature")
    buckets, ratios = chosen["feature"].to_numpy(), chosen["ratio"].to_numpy()
    # A row's own count is left out of the ratios that it is fitted with, or n-grams that only it
    # has would explain its label.
    c0, c1 = chosen["c0"].to_numpy().astype(float), chosen["c1"].to_numpy().astype(float)
    part = lambda c, alpha, n: np.log((np.maximum(c, 0) + alpha) / n)
    without_own = np.stack([
        part(c1, alpha1, n1) - part(c0 - 1, alpha0, max(n0 - 1, 1)),
        part(c1 - 1, alpha1, max(n1 - 1, 1)) - part(c0, alpha0, n0),
    ])

    place = np.full(BUCKETS, -1, np.int64)
    place[buckets] = np.arange(len(buckets))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = _Once()
        for batch in batches:
            found = (place[once(features(t))] for t in batch.column(0).to_pylist())
            packed = [np.sort(f[f >= 0]).astype(np.int32).tobytes() for f in found]
            yield pa.record_batch([pa.array(packed, pa.binary()), batch.column(1), batch.column(2)], names=["present", "label", "h"])

    # The first texts by hash: chosen by narrow rows, so that no task gathers texts. Copies of a
    # text are one text that counts as often, or a common one would fill the sample.
    keyed = rows.withColumn("_h", F.xxhash64("text"))
    last = keyed.select("_h").distinct().orderBy("_h").limit(FIT_ROWS).agg(F.max("_h")).first()[0]
    drawn = keyed.where(F.col("_h") <= last).select("text", "label", "_h")
    sample = pin(by_batches(drawn, present, "present binary, label int, h bigint"))
    # Long texts have many features: texts are taken, in the order of the hash, as far as their bytes go.
    sizes = sample.groupBy("h").agg(F.max(F.length("present")).alias("n")).orderBy("h").toArrow()
    enough = np.cumsum(sizes["n"].to_numpy()) <= FIT_BYTES
    last = sizes["h"][int(max(enough.sum(), 1)) - 1].as_py()
    fitted = sample.where(F.col("h") <= last).groupBy("present", "label").count().orderBy("present", "label").toArrow()
    y, times_met = (fitted[c].to_numpy().astype(float) for c in ("label", "count"))
    x_rows = [np.frombuffer(r.as_buffer(), np.int32) for r in fitted["present"]]
    weights, bias = _logistic(x_rows, without_own, y, times_met)
    seen = np.zeros(len(buckets), bool)
    for row in x_rows:
        seen[row] = True
    if seen.any():
        weights[~seen] = weights[seen].mean()
    return buckets, weights * ratios, bias


def _scores(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, np.ndarray, float]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with the scores of their rows; the last column is the text."""
    buckets, weights, bias = model
    table = np.zeros(BUCKETS)
    table[buckets] = weights
    once = _Once()
    for batch in batches:
        sums = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            found = features(text)
            # Only features with a weight matter, and few of a text's n-grams have one.
            sums.append(table[once(found[table[found] != 0])].sum() + bias)
        yield batch, 1 / (1 + np.exp(-np.clip(np.array(sums), -700, 700)))


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(batches, model):
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return by_batches(rows, score, "doc_id bigint, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train(docs, labels)).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows below the threshold, each by its own score; the model is trained on the labelled ones among them all."""
    model = train(docs, labels)
    (text,) = fresh(docs, "_text")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, p in _scores(batches, model):
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(p < THRESHOLD))

    return by_batches(docs.withColumn(text, text_of()), below, docs.schema)
