"""Ranked lexical search against brute force, bounds against products, odd rows."""

import math
import random
import re
from collections import Counter, namedtuple

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ball_tree

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id bigint, text string"
Asked = namedtuple("Asked", "item_id term times")


def terms_by_hand(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_by_hand(docs, items, k=10):
    """(item, rank, doc, score) of (doc_id, text) and (item_id, text) pairs."""
    found = [(i, Counter(terms_by_hand(t))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n, total = len(found), sum(x for _, _, x in found)
    df = Counter(t for _, c, _ in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, Counter()).update(terms_by_hand(text))
    out = []
    for item, times in asked.items():
        scores = []
        for doc, c, length in found:
            m = 25 + 75 * length * n // total
            score = sum(
                x * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m))
                for t, x in times.items() if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, None if null else doc, -score))
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(seed, n, words):
    rng = random.Random(seed)
    pool = words(seed, 150)
    return [" ".join(rng.choices(pool, k=rng.randint(0, 40))) + rng.choice(["", ".", " É É", "\x00x"]) for _ in range(n)]


@pytest.mark.parametrize(("leaf", "entries", "block"), [(32, 1 << 20, 100_000), (1, 300, 60), (3, 2000, 100_000)])
def test_search(documents, spark, words, monkeypatch, leaf, entries, block):
    monkeypatch.setattr(ball_tree, "LEAF", leaf)
    monkeypatch.setattr(ball_tree, "TREE_ENTRIES", entries)
    monkeypatch.setattr(ball_tree, "BLOCK_TERMS", block)
    texts = made(leaf, 300, words)
    texts += [texts[3]] * 25 + [texts[4].upper()] * 2
    items = [(i, " ".join(made(90 + i, 1, words)[0].split()[:12] * (1 + i % 2))) for i in range(25)]
    items += [(3, texts[8]), (None, texts[9]), (77, "nothing-like-it"), (78, ""), (79, None)]
    found = ball_tree.search(documents(texts).repartition(4), spark.createDataFrame(items, ITEMS))
    assert collected(found) == ranked_by_hand(list(enumerate(texts)), items)


def test_bounds_hold(words):
    """No point's product with an item is above the bound of any ball that it lies in."""
    rng = random.Random(5)
    pool = [t.encode() for t in dict.fromkeys(words(5, 200))]
    rows = [Asked(i, t, rng.randint(1, 3)) for i in range(12) for t in rng.sample(pool, 15)]
    block = ball_tree._block(rows)
    weight = np.array([rng.choice([0, 1, 500, 9000]) for _ in block.vocabulary])
    queries, points = ball_tree.Queries(block, weight), ball_tree.Points(10)
    weighted = np.flatnonzero(weight)
    for doc in range(500):
        cols = np.sort(np.array(rng.sample(weighted.tolist(), rng.randint(1, 20))))
        points.add(doc, cols, weight[cols] * np.array([rng.randint(1, 700_000) for _ in cols]))
    tree = ball_tree.Tree(points, queries)
    below = {}

    def gather(node):
        span = tree.span[node]
        below[node] = set(range(*span)) if span else set().union(*(gather(c) for c in tree.children[node]))
        return below[node]

    assert gather(0) == set(range(len(points.docs)))
    for item in range(len(block.items)):
        asked = np.zeros(len(weight), np.int64)
        own = slice(block.ptr[item], block.ptr[item + 1])
        asked[block.cols[own]] = block.times[own]
        products = np.add.reduceat(asked[tree.cols] * tree.vals, tree.ptr[:-1])
        for node, inside in below.items():
            assert tree.bounds[node, item] >= max(products[i] for i in inside)


def test_subtrees_are_left_out(words):
    """A query of rare terms meets few leaves."""
    vocabulary = [w.encode() + str(i).encode() for i, w in enumerate(words(1, 400))]
    block = ball_tree._block([Asked(i // 10, t, 1) for i, t in enumerate(vocabulary)])
    weight = np.full(len(vocabulary), 5000)
    queries, points, rng = ball_tree.Queries(block, weight), ball_tree.Points(10), random.Random(2)
    for doc in range(4000):
        topic = rng.randrange(40)
        own = block.cols[block.ptr[topic] : block.ptr[topic + 1]]
        cols = np.sort(np.array(rng.sample(own.tolist(), 6)))
        points.add(doc, cols, 5000 * np.array([rng.randint(100_000, 500_000) for _ in cols]))
    tree = ball_tree.Tree(points, queries)
    asked = np.zeros(len(weight), np.int64)
    asked[block.cols[:10]] = 1
    leaves = sum(s is not None for s in tree.span)
    assert tree.search(0, asked, [], 10) < leaves / 5


@pytest.mark.parametrize("piece", [5, 64, 1 << 20])
def test_terms(monkeypatch, words, piece):
    monkeypatch.setattr(ball_tree, "PIECE_BYTES", piece)
    for text in ("", "A", "Ab-cD é_È 12\x0034", "x" * 300, "é" * 99 + " tail", " ".join(words(3, 90)), "-" * 200):
        assert [t.decode() for p in ball_tree.terms(text.encode()) for t in p] == terms_by_hand(text)


def test_odd(odd, spark):
    items = [(1, "one TWO three"), (2, "no id here"), (3, None)]
    asked = spark.createDataFrame(items, ITEMS).withColumn("term", F.lit("x")).withColumn("doc", F.lit(1))
    found = collected(ball_tree.search(odd, asked))
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found == ranked_by_hand(texts, items)
    assert ball_tree.search(odd.limit(0), asked).count() == 0
    assert ball_tree.search(odd, asked.limit(0)).count() == 0
    assert ball_tree.search(odd, spark.createDataFrame([(1, "...")], ITEMS)).columns == ["item_id", "rank", "doc_id", "score"]
