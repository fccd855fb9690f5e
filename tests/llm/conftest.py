import random
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

for folder in (Path(__file__).resolve().parent, Path(__file__).resolve().parents[1], Path(__file__).resolve().parents[2]):
    sys.path.insert(0, str(folder))

from cases import DOCS  # noqa: E402

SYLLABLES = ["the", "er", "ion", "é", "ß", "ing", "ñ", "an", "o", "ka", "um", "li"]


@pytest.fixture(scope="session")
def words():
    """Seeded words."""

    def make(seed, n):
        rng = random.Random(seed)
        return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n)]

    return make


@pytest.fixture(scope="session")
def documents(spark, words):
    """Texts to documents: null, empty and white-space texts, one long text, a null id, extra columns."""

    def make(texts, first=0):
        rows = [(first + i, t, "en", f"s{i % 3}", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(documents, spark, words):
    """Every odd case at once, with columns that clash with the operators' own."""
    long = " ".join(words(7, 20_000))
    texts = [None, "", " \t\n", "one", "one", "two  three", "two three", long, long + " tail", "a\x00b", "é" * 60, "x" * 5000]
    rows = documents(texts).unionByName(documents(["one"], 3))
    rows = rows.unionByName(spark.createDataFrame([(None, "no id here", None, None, None)], DOCS))
    clash = {c: "x" for c in ("size", "class", "band", "digest", "tag", "_key", "_n", "kept", "label", "h", "spans", "_first", "_id", "_turn", "_position")}
    for name, value in clash.items():
        rows = rows.withColumn(name, F.lit(value))
    return rows.repartition(3)
