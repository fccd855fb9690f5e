"""Ranked lexical search by exact inner products over ball trees.

A document is a sparse vector, a query another, and a score their integer inner product. Vectors of
a task's documents form a tree of balls: a node has a centre and a radius around it, a query's product
with any document below is at most its product with the centre plus its length times the radius.
The tree is searched best first; a subtree whose bound is below the k-th best score so far is left out,
what is reached is scored exactly in 64-bit integers. Bounds are computed in doubles from vectors that are
scaled by the root of the weights, so that query and document carry the same share, and are rounded up:
every radius and bound is raised by far more than its arithmetic can lose (``SLACK``).

A ball around whole vectors is wide, since a document's terms of other queries count in its radius. The
space is therefore cut into subspaces, the terms that only one query of a block has, and ``SHARED`` groups of
the others by weight; a node has a radius in each, the bound adds up those the query reaches, and the
smaller of both bounds counts.

Queries are taken in blocks of ``BLOCK_TERMS`` terms, by hash of the item, so that one block's vocabulary
is all that tasks are sent; only its terms are coordinates. A pass over the texts counts all documents
(terms, lengths, document frequencies) and writes the vectors, a second pass builds and searches a tree
for each ``TREE_ENTRIES`` of them. Equal vectors are one point with its k smallest ids. Each task
returns at most k documents for an item, which are merged in two steps.

Defined results: terms are runs of ASCII letters, digits and all code points from U+0080 on, only A-Z
lower-cased. A null or empty text has no terms. Each row is a document of its own, a null doc_id comes
last among equals. Rows that share an item_id (or have none) are one item with the terms of all. Items
without a match have no rows, and an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import pin
from .common import by_batches, staged

K = 10
#: Distinct terms of items that one pass serves, in expectation.
BLOCK_TERMS = 100_000
#: Entries of the vectors in one tree, and points in a leaf.
TREE_ENTRIES = 1 << 20
LEAF = 32
SHARED = 32
#: Relative error that is allowed for; doubles lose less than 1e-11 over a million terms.
SLACK = 1e-9
PACK_BYTES = 4 << 20
PIECE_BYTES = 1 << 20
NO_ID = (1 << 63) - 1
#: Bytes outside terms become spaces, A-Z become a-z.
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_VECTORS = "kind int, term int, n bigint, packed binary"
DF, DOCUMENTS, LENGTH, PACKED = range(4)


def terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, a bounded piece at a time."""
    at = 0
    while at < len(data):
        end = at + PIECE_BYTES
        piece = data[at:end].translate(_CLEAN)
        if end < len(data) and (cut := piece.rfind(b" ")) > 0:
            piece, end = piece[:cut], at + cut
        elif end < len(data):
            # One term is longer than a piece.
            rest = data[end:].translate(_CLEAN)
            stop = rest.find(b" ")
            piece, end = piece + (rest if stop < 0 else rest[:stop]), len(data) if stop < 0 else end + stop
        yield piece.split()
        at = end


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, data in zip(*(c.to_pylist() for c in batch.columns)):
            found = Counter(t for piece in terms(data or b"") for t in piece)
            yield pa.record_batch(
                [pa.array([item] * len(found), pa.int64()), pa.array([*found], pa.binary()), pa.array([*found.values()], pa.int64())],
                names=["item_id", "term", "times"],
            )


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and times."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    found = by_batches(rows, _item_terms, "item_id bigint, term binary, times bigint")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


@dataclass
class Block:
    """Items and their terms: entries ``ptr[i]:ptr[i + 1]`` are item i's columns and times."""

    items: list[int | None]
    vocabulary: list[bytes]
    ptr: np.ndarray
    cols: np.ndarray
    times: np.ndarray


def _block(rows: list) -> Block:
    rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, bytes(r.term)))
    items = list(dict.fromkeys(r.item_id for r in rows))
    vocabulary = sorted({bytes(r.term) for r in rows})
    place, number = {t: i for i, t in enumerate(vocabulary)}, {i: n for n, i in enumerate(items)}
    sizes = np.bincount([number[r.item_id] for r in rows], minlength=len(items))
    cols = np.array([place[bytes(r.term)] for r in rows], np.int64)
    return Block(items, vocabulary, np.r_[0, np.cumsum(sizes)], cols, np.array([r.times for r in rows], np.int64))


def _row(kind: int, term: int | None = None, n: int | None = None, packed: bytes | None = None) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.record_batch([pa.array([v], k) for v, k in zip((kind, term, n, packed), kinds)], names=["kind", "term", "n", "packed"])


def _pack(docs: list[int], lengths: list[int], found: list[Counter]) -> bytes:
    sizes = [len(f) for f in found]
    columns = [
        np.array([len(docs), sum(sizes)], "<i8"), np.array(docs, "<i8"), np.array(lengths, "<i8"), np.array(sizes, "<i8"),
        np.array([i for f in found for i in f], "<i4"), np.array([n for f in found for n in f.values()], "<i4"),
    ]
    return b"".join(c.tobytes() for c in columns)


def _unpack(data: bytes) -> tuple[np.ndarray, ...]:
    docs, entries = (int(x) for x in np.frombuffer(data, "<i8", 2))
    wide = [np.frombuffer(data, "<i8", docs, 16 + 8 * docs * i) for i in range(3)]
    narrow = [np.frombuffer(data, "<i4", entries, 16 + 24 * docs + 4 * entries * i) for i in range(2)]
    return *wide, *narrow


def _vectors(vocabulary: list[bytes]):
    """What a task's documents hold: vectors over the vocabulary, packed, and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(vocabulary)}.get
        df, documents, length = np.zeros(len(vocabulary), np.int64), 0, 0
        docs, lengths, found, size = [], [], [], 0
        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = 0, Counter()
                for piece in terms(data.as_py() or b""):
                    n += len(piece)
                    counts.update([i for t in piece if (i := place(t)) is not None])
                documents += n > 0
                length += n
                if not counts:
                    continue
                df[[*counts]] += 1
                docs.append(doc)
                lengths.append(n)
                found.append(counts)
                size += 24 + 8 * len(counts)
                if size >= PACK_BYTES:
                    yield _row(PACKED, packed=_pack(docs, lengths, found))
                    docs, lengths, found, size = [], [], [], 0
        if docs:
            yield _row(PACKED, packed=_pack(docs, lengths, found))
        yield _row(DOCUMENTS, n=documents)
        yield _row(LENGTH, n=length)
        met = np.flatnonzero(df)
        nothing = pa.nulls(len(met), pa.binary())
        kinds = [pa.array(np.full(len(met), DF, np.int32)), pa.array(met.astype(np.int32)), pa.array(df[met]), nothing]
        yield pa.record_batch(kinds, names=["kind", "term", "n", "packed"])

    return run


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) for each term; 0 for terms that no document has."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in df.tolist()], np.int64)


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Queries:
    """A block's items as scaled vectors, with their lengths in each subspace."""

    def __init__(self, block: Block, weight: np.ndarray) -> None:
        self.block, self.weight = block, weight
        self.root = np.sqrt(weight.astype(float))
        self.values = block.times * self.root[block.cols]
        holders = np.bincount(block.cols, minlength=len(weight))
        owner = np.repeat(np.arange(len(block.items)), np.diff(block.ptr))
        self.space = np.zeros(len(weight), np.int64)
        self.space[block.cols] = owner
        shared = np.flatnonzero(holders > 1)
        by_weight = shared[np.argsort(weight[shared], kind="stable")]
        self.space[by_weight] = len(block.items) + np.arange(len(shared)) * SHARED // max(len(shared), 1)
        self.spaces = len(block.items) + SHARED
        flat = np.bincount(owner * self.spaces + self.space[block.cols], self.values**2, len(block.items) * self.spaces)
        self.lengths = np.sqrt(flat.reshape(len(block.items), self.spaces)) * (1 + SLACK)
        self.length = np.sqrt(np.bincount(owner, self.values**2, len(block.items))) * (1 + SLACK)

    def bounds(self, centre: np.ndarray, radius: float, radii: np.ndarray) -> np.ndarray:
        """No item's product with a vector in the ball is above."""
        middle = np.add.reduceat(centre[self.block.cols] * self.values, self.block.ptr[:-1])
        far = np.minimum(self.length * radius, self.lengths @ radii)
        return (middle + far) * (1 + SLACK) + 1


class Points:
    """Distinct vectors: entries ``ptr[i]:ptr[i + 1]`` are point i's columns and integer values."""

    def __init__(self, limit: int) -> None:
        self.limit = limit
        self.known: dict[bytes, int] = {}
        self.cols: list[np.ndarray] = []
        self.vals: list[np.ndarray] = []
        self.docs: list[list[int]] = []
        self.entries = 0

    def add(self, doc: int, cols: np.ndarray, vals: np.ndarray) -> None:
        key = cols.tobytes() + vals.tobytes()
        at = self.known.get(key)
        if at is None:
            self.known[key] = len(self.docs)
            self.cols.append(cols)
            self.vals.append(vals)
            self.docs.append([doc])
            self.entries += len(cols)
            return
        held = self.docs[at]
        if len(held) < self.limit or doc < held[-1]:
            insort(held, doc)
            del held[self.limit :]


class Tree:
    """Balls over points, each with the bound of every item."""

    def __init__(self, points: Points, queries: Queries) -> None:
        sizes = np.array([len(c) for c in points.cols])
        cols, vals = np.concatenate(points.cols).astype(np.int64), np.concatenate(points.vals)
        ptr = np.r_[0, np.cumsum(sizes)]
        scaled = vals / queries.root[cols]
        self.bounds, self.children, self.span, order = [], [], [], []
        pending = [(np.arange(len(sizes)), -1)]
        while pending:
            own, parent = pending.pop()
            node = len(self.bounds)
            if parent >= 0:
                self.children[parent].append(node)
            counts = sizes[own]
            at = np.repeat(ptr[own] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            row, c, x = np.repeat(np.arange(len(own)), counts), cols[at], scaled[at]
            centre = np.bincount(c, x, len(queries.weight)) / len(own)
            away = self._ball(queries, centre, row, c, x, len(own))
            self.children.append([])
            if len(own) <= LEAF:
                self.span.append((len(order), len(order) + len(own)))
                order.extend(own.tolist())
                continue
            self.span.append(None)
            left = self._split(queries, row, c, x, away, len(own))
            pending += [(own[left], node), (own[~left], node)]
        order = np.array(order)
        counts = sizes[order]
        at = np.repeat(ptr[order] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
        self.cols, self.vals, self.ptr = cols[at], vals[at], np.r_[0, np.cumsum(counts)]
        self.docs = [points.docs[i] for i in order]
        self.bounds = np.array(self.bounds)

    def _ball(self, queries: Queries, centre: np.ndarray, row: np.ndarray, c: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        """Note the bounds of the least ball around the centre; the points' squared distances from it."""
        space = row * queries.spaces + queries.space[c]
        own = centre[c]
        base = np.bincount(queries.space, centre**2, queries.spaces)
        shape = (n, queries.spaces)
        apart = np.bincount(space, (x - own) ** 2 - own**2, n * queries.spaces).reshape(shape) + base
        mass = np.bincount(space, x**2, n * queries.spaces).reshape(shape)
        raised = np.maximum(apart, 0) + SLACK * (base + mass)
        radii = np.sqrt(raised.max(axis=0)) * (1 + SLACK)
        whole = raised.sum(axis=1)
        self.bounds.append(queries.bounds(centre, math.sqrt(whole.max()) * (1 + SLACK), radii))
        return whole

    @staticmethod
    def _split(queries: Queries, row: np.ndarray, c: np.ndarray, x: np.ndarray, away: np.ndarray, n: int) -> np.ndarray:
        """Points nearer to the one farthest from the centre than to the one farthest from that."""

        def dense(i: int) -> np.ndarray:
            return np.bincount(c[row == i], x[row == i], len(queries.weight))

        norms = np.bincount(row, x * x, n)
        one = dense(int(away.argmax()))
        to_one = norms - 2 * np.bincount(row, x * one[c], n)
        other = dense(int(to_one.argmax()))
        to_other = norms - 2 * np.bincount(row, x * other[c], n)
        left = to_one + one @ one <= to_other + other @ other
        if left.all() or not left.any():
            left = np.arange(n) < n // 2
        return left

    def search(self, item: int, asked: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Improve the item's best (-score, doc) pairs; the number of leaves that were scored."""
        bounds, scored = self.bounds[:, item], 0
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if len(best) == k and -bound < -best[-1][0]:
                break
            if self.span[node] is None:
                for child in self.children[node]:
                    heapq.heappush(heap, (-bounds[child], child))
                continue
            scored += 1
            low, high = self.span[node]
            a, b = self.ptr[low], self.ptr[high]
            scores = np.add.reduceat(asked[self.cols[a:b]] * self.vals[a:b], self.ptr[low:high] - a)
            least = -best[-1][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                score = int(scores[i])
                for doc in self.docs[low + i]:
                    if len(best) == k and (-score, doc) >= best[-1]:
                        break
                    insort(best, (-score, doc))
                    del best[k:]
        return scored


def _search(block: Block, df: np.ndarray, documents: int, length: int, k: int):
    """The best documents of a task for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights(df, documents)
        queries = Queries(block, weight)
        best: list[list[tuple[int, int]]] = [[] for _ in block.items]
        asked = np.zeros(len(weight), np.int64)

        def solve(points: Points) -> None:
            if not points.docs:
                return
            tree = Tree(points, queries)
            for i in range(len(block.items)):
                own = slice(block.ptr[i], block.ptr[i + 1])
                asked[block.cols[own]] = block.times[own]
                tree.search(i, asked, best[i], k)
                asked[block.cols[own]] = 0

        points = Points(k)
        for batch in batches:
            for data in batch.column(0):
                docs, lengths, sizes, cols, tf = _unpack(data.as_py())
                m = np.array([25 + 75 * n * documents // length for n in lengths.tolist()], np.int64)
                vals = weight[cols] * saturated(tf, np.repeat(m, sizes))
                ends = np.cumsum(sizes)
                for doc, a, b in zip(docs.tolist(), (ends - sizes).tolist(), ends.tolist()):
                    held = np.flatnonzero(vals[a:b]) + a
                    if len(held):
                        held = held[np.argsort(cols[held], kind="stable")]
                        points.add(doc, cols[held], vals[held])
                    if points.entries >= TREE_ENTRIES:
                        solve(points)
                        points = Points(k)
        solve(points)
        rows = [(item, doc, -score) for item, found in zip(block.items, best) for score, doc in found]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], names=["item_id", "doc", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each item, of parts of its rows first."""
    best = [F.col("score").desc(), F.col("doc")]
    part = F.pmod(F.xxhash64("doc"), F.lit(64))
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
    local = found.withColumn("_part", part).withColumn("_n", rank("item_id", "_part")).where(F.col("_n") <= k)
    return local.withColumn("rank", rank("item_id")).where(F.col("rank") <= k).select("item_id", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents of each item (an action for each block of items)."""
    asked = pin(item_terms(items))
    blocks = asked.count() // BLOCK_TERMS + 1
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.col("text").cast("binary").alias("text"))
    results = []
    for number in range(blocks):
        chosen = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        block = _block(chosen.collect())
        if not block.items:
            continue
        made = staged(by_batches(rows, _vectors(block.vocabulary), _VECTORS), "vectors")
        counts = made.where(F.col("kind") < PACKED).groupBy("kind", "term").agg(F.sum("n").alias("n")).toArrow()
        kind, term, n = (counts[c].to_numpy() for c in ("kind", "term", "n"))
        df = np.zeros(len(block.vocabulary), np.int64)
        df[term[kind == DF].astype(np.int64)] = n[kind == DF]
        documents, length = (int(n[kind == x].sum()) for x in (DOCUMENTS, LENGTH))
        packed = made.where(F.col("kind") == PACKED).select("packed")
        found = by_batches(packed, _search(block, df, documents, length, k), "item_id bigint, doc bigint, score bigint")
        results.append(pin(_ranked(found, k)))
    if not results:
        empty = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc bigint, score bigint")
        results = [empty]
    united = reduce(DataFrame.unionByName, results)
    return united.select("item_id", "rank", F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "score")


def oracle() -> str:
    return r"""
    WITH x AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS upper, 'abcdefghijklmnopqrstuvwxyz' AS lower),
    d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), upper, lower), term) AS t FROM documents, x),
    c AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::BIGINT AS l FROM d),
    q AS (SELECT item_id, t, count(*) AS times
          FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), upper, lower), term)) AS t FROM benchmark, x) GROUP BY 1, 2),
    p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY 1, 2),
    w AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t),
    m AS (SELECT r, doc_id, 100 - 75 + (75 * len(t) * n) // l AS m FROM d, c WHERE len(t) > 0),
    s AS (SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
          FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY 1, 2, 3)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
    FROM s WHERE score > 0 QUALIFY rank <= 10"""
