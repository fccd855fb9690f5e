"""Language identification: features and calibration against plain Python, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np
import pytest
from cases import DOCS, SF
from pyspark.sql import functions as F

from helixframe.llm import language


def bucket(gram):
    mixed = 0
    for n, c in enumerate(gram, 1):
        mixed = (mixed * 0x9E3779B97F4A7C15 + ord(c) + n) % 2**64
    mixed ^= mixed >> 31
    return mixed * 0xBF58476D1CE4E5B9 % 2**64 >> 64 - 16


def grams_by_hand(text):
    letters = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in text.lower())
    clean = f" {' '.join(letters.split())} "
    return sorted(bucket(clean[i : i + n]) for n in language.GRAMS for i in range(len(clean) - n + 1))


@pytest.mark.parametrize("piece", [3, 10, 1 << 18])
def test_grams(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    for text in ("Hello, World!", "a", "", "42 — 17", "naïve Straße_x9y " * 7, "ab"):
        assert sorted(np.concatenate([*language.grams(text)]).tolist()) == grams_by_hand(text)


def test_calibration():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 4000)
    truth = np.where(rng.random(4000) < 0.9, y, (y + 1) % 3)
    sharp = 12.0 * np.eye(3)[y]
    t, least = language.calibrate(sharp, truth)
    p = language.softmax(sharp / t).max(axis=1)
    assert abs(p.mean() - 0.9) < 0.02 and least == 1.0  # nothing is right often enough
    sharp[:2000] *= np.where(truth[:2000] == y[:2000], 3, 0.1)[:, None]
    t, least = language.calibrate(sharp, truth)
    p = language.softmax(sharp / t)
    accepted = p.max(axis=1) >= least
    assert accepted.sum() > 1000 and (p.argmax(axis=1) == truth)[accepted].mean() >= language.TARGET
    assert language.calibrate(np.zeros((0, 3)), np.zeros(0, int)) == (1.0, 0.0)


def test_held_out(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.1/documents.parquet")
    rows = language.report(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]
    assert len(held) > 1000 and sum(held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_blind_to_the_rest(spark):
    """Languages of held-out rows, ids and sources change no prediction."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(language.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in language.report(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in language.report(other.repartition(5)).collect()}


def test_rejection(spark, words):
    rng = random.Random(2)
    two = {"xa": words(1, 50), "xb": [w[::-1] + "q" for w in words(2, 50)]}
    rows = [(i, " ".join(rng.choices(two[lang], k=30)), lang, "s", 0) for i, lang in enumerate(["xa", "xb"] * 150)]
    model = language.train(spark.createDataFrame(rows, DOCS))
    assert model.languages == ["xa", "xb"]
    model.least = 0.999
    other = spark.createDataFrame([(1, "ЖЖ ЩЩ", None, None, None), (2, " ".join(two["xb"]), None, None, None)], DOCS)
    found = {r.doc_id: r.language for r in language.identified(other, model).collect()}
    assert found == {1: "und", 2: "xb"}


def test_bounded_sample(documents, words, spark, monkeypatch):
    monkeypatch.setattr(language, "FIT_ROWS", 40)
    monkeypatch.setattr(language, "FIT_TEXT_BYTES", 2000)
    texts = [" ".join(words(i, 40)) for i in range(400)] + [" ".join(words(1, 4000))]
    docs = documents(texts).withColumn("lang", F.when(F.col("doc_id") % 8 == 0, "de").otherwise("en"))
    drawn = language.sample(docs).collect()
    assert 20 <= len(drawn) <= 40 and {r.lang for r in drawn} == {"de", "en"} and all(len(r.text.encode()) <= 2000 for r in drawn)


def test_odd(odd, spark):
    rows = language.report(odd).collect()
    assert len(rows) == odd.count()
    none = [r for r in rows if r.lang_pred == "und"]
    assert {r.score for r in none} == {0.0} and sorted(r.doc_id for r in none) == [0, 1, 2]
    # One language only: certain, but for texts without letters.
    assert {(r.lang_pred, r.score) for r in rows} == {("en", 1.0), ("und", 0.0)}
    nothing = language.report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score, r.accepted) for r in nothing} == {("und", 0.0, False)}
    assert language.report(odd.limit(0)).count() == 0
    digits = spark.createDataFrame([(1, "12 34 ²", None, None, None)], DOCS)
    assert language.predicted(digits, language.train(odd)).first().lang_pred == "und"
