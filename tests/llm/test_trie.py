"""The prefix trie against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from helixframe.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def ordered(rows):
    """conv_id -> its (role, text) in order."""
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            named = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            found.setdefault(conv, []).append((turn is not None, turn or 0, named, role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt_by_hand(found):
    out = {}
    for c, turns in found.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = found.get(base, [])[:h] + turns[h:]
    return out


def nodes_by_hand(found):
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = 1 if not children[p] else sum(leaves[q] for q in children[p])
        own = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        saved[p] = own + sum(saved[q] for q in children[p])
    rows = []
    for p, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(found[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(ids), len(p), parent, len(ids), len(children[p]), leaves[p], saved[p], digest))
    return sorted(rows, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_trie(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b b", "", None, "c d  e", "\t"]
    rows = []
    for c in rng.sample(range(-30, 130), 60):
        for t in range(rng.choice([1, 2, 3, 7, 8, 9, 16, 17, 30])):
            rows.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "user", None]), rng.choice(words[: 2 + seed * 2])))
    rows += rows[:7]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5)
    found = ordered(rows)
    assert collected(trie.plain_trie(df)) == nodes_by_hand(found)
    assert collected(trie.report(df)) == nodes_by_hand(rebuilt_by_hand(found))


def test_long_conversations(spark, monkeypatch):
    """Blocks are chained over chunks; two conversations part only after many of them."""
    monkeypatch.setattr(trie, "CHUNK", 2)
    monkeypatch.setattr(trie, "PIECE_BYTES", 8)
    rows = [(c, t, "user", f"turn {t}" if t < cut else f"turn {t} of {c}") for c, cut in ((1, 100), (2, 57), (3, 64), (4, 65)) for t in range(100)]
    rows += [(c, t, "user", f"turn {t}") for c in range(20, 50) for t in range(40)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(7)
    assert collected(trie.plain_trie(df)) == nodes_by_hand(ordered(rows))


def test_hot_conversation_is_numbered_in_ranges(spark):
    rows = [(5, t // 3, "user", f"x{t % 2}") for t in range(3000)] + [(6, 0, "user", "same")] * 1500 + [(c, 0, "u", "x") for c in range(7, 90)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(6)
    found = trie.turn_rows(df)
    per = found.groupBy("conv_id").agg(F.count("*").alias("n"), F.countDistinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("b"))
    assert all(r.n == r.d == r.b and r.a == 1 for r in per.collect())
    hashes = [r.tid for r in found.where("conv_id = 5").orderBy("pos").collect()]
    by_hand = [hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] for role, text in ordered(rows)[5]]
    assert [bytes(h) for h in hashes] == by_hand


def test_odd_conversations(spark):
    """No rows, rows without an id, a conversation whose family's first one is absent, clashing columns."""
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert collected(trie.report(empty)) == [] and collected(trie.plain_trie(empty)) == []
    rows = [(None, 0, "user", "lost"), (7, 0, "user", "x" * 100_000), (8, None, None, None), (9, 0, "user", "")]
    df = spark.createDataFrame(rows, CONVERSATIONS)
    for name in ("t1", "pos", "tid", "block", "size", "_range", "level", "depth", "kx"):
        df = df.withColumn(name, F.lit("x"))
    assert collected(trie.report(df)) == nodes_by_hand(rebuilt_by_hand(ordered(rows)))
