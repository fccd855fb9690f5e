"""Near-duplicate detection by DartMinHash over 5-word shingles.

A text is a multiset of shingles; its weight at a shingle is how often it occurs, and similarity is
the weighted Jaccard index. Hashed darts fall on the plane of weight and rank above every shingle,
one per unit of area on average; a text is hit by the darts below its weight. Every dart belongs to
one of ``K`` coordinates by hash, and the signature keeps the earliest dart of each. A text looks
only at darts up to the rank at which ``T`` of them are due for its total weight, which takes time
in the length of the text plus K log K instead of their product; coordinates still empty there are
filled by doubling that rank. Ranks are cut into strips by powers of four, each with its own hashed
number of darts, so that texts of all lengths see the same ones.

Signatures are joined by bands. Copies (equal words) are collapsed first. In each bucket the members
are paired with the bucket's central member, in later rounds, as far as they are in another class
than most, with the first and last in other orders. That joins large groups of copies with few pairs, at most
4n in a round for a bucket of n texts. Every pair of a bucket that is in two classes after these rounds is
then tested: members are dealt into chunks, and pairs of chunks are blocks of bounded size that
tasks take one by one. Members of the bucket's largest class don't meet each other. A sketch of the signature drops
pairs that cannot reach the threshold, the others are checked exactly on their shingles, and classes
are connected components. Every step is an aggregate that combines before the shuffle, a join that
adaptive execution can split or a task over blocks, and nothing gathers a bucket, a class or an edge
list in one task. The number of pairs is quadratic only in members of a bucket outside its largest class.

Defined results: a null or empty text, or one without words, is in a class of its own; a text with
one to four words is one shingle. Rows that share a doc_id are one document, and join the classes
of all their texts. Rows with a null doc_id get a null class. Columns other than doc_id and text are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import SPACE, by_batches, fresh, staged, text_of, without_ids

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
#: Darts due per text: each coordinate gets ln K + 2 of them on average.
T = K * (math.log(K) + 2)
#: Bounds of the rank strips; the next ones are four times as far.
FIRST_STRIP = 1 / 256
_BATCH_BYTES = 1 << 20
EDGES_PER_PART = 500_000
CELLS_PER_PART = 10_000
PAIRS_PER_PART = 20_000
MEMBERS_PER_PART = 250_000
#: Rounds of few pairs before the blocks, at most; they save pairs and decide nothing.
ROUNDS = 3
#: Members, and cells of their texts, of a chunk; a block has two chunks.
CHUNK, CHUNK_CELLS = 1024, 1 << 20
#: Bytes of a sketch. Of two texts that are alike to 0.8, fewer than half agree once in a million.
SKETCH = 64
MAY_BE_ALIKE = 0.5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_BASE = 0x5851F42D4C957F2D
_POWERS = _powers(1 << 16, _BASE)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word: a polynomial in its bytes, from differences of one running sum."""
    raw = np.frombuffer(data, np.uint8)
    word = np.empty(len(raw) + 2, bool)
    word[0] = word[-1] = False
    word[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    global _POWERS
    if len(raw) >= len(_POWERS):
        _POWERS = _powers(2 * len(raw), _BASE)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(raw)], out=sums[1:])
    # The word's part of the sum is its polynomial times a power of the odd base; the inverse power removes that.
    own = (sums[ends] - sums[starts]) * _inverse(starts)
    return starts, mix(own + (ends - starts).astype(np.uint64) * _ODD)


_INVERSE = _powers(1 << 16, pow(_BASE, -1, 1 << 64))


def _inverse(at: np.ndarray) -> np.ndarray:
    global _INVERSE
    if len(at) and at[-1] >= len(_INVERSE):
        _INVERSE = _powers(2 * int(at[-1]) + 2, pow(_BASE, -1, 1 << 64))
    return _INVERSE[at]


def shingle_cells(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Cells and their text numbers, ordered by text and cell; the n-th copy of a shingle is a cell of its own."""
    hashes, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):  # a long text in pieces that end in white space
            cut = len(text) if len(text) - at <= _BATCH_BYTES else _space_before(text, at, at + _BATCH_BYTES)
            found = _word_hashes(text[at:cut])[1]
            hashes.append(found)
            owner.append(np.full(len(found), i))
            at = cut
    words, text_of_word = np.concatenate(hashes), np.concatenate(owner)
    counts = np.bincount(text_of_word, minlength=len(texts))
    ends = np.cumsum(counts)
    begins = ends - counts
    windows = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    text_of_window = np.repeat(np.arange(len(texts)), windows)
    first = np.arange(len(text_of_window)) - np.repeat(np.cumsum(windows) - windows, windows) + begins[text_of_window]
    value = np.zeros(len(first), np.uint64)
    for k in range(SHINGLE):
        inside = first + k < ends[text_of_window]
        value = value * _ODD + np.where(inside, words[np.minimum(first + k, max(len(words) - 1, 0))], np.uint64(0))
    value = mix(value)
    order = np.lexsort((value, text_of_window))
    value, owners = value[order], text_of_window[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owners[1:] != owners[:-1])
    at = np.arange(len(value))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(at) else at
    return mix(value + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), owners


def _space_before(text: bytes, at: int, limit: int) -> int:
    """The end of the last white space before a limit, or the next one after it."""
    for i in range(limit, at, -1):
        if text[i - 1] in b" \t\n\x0b\x0c\r":
            return i
    while limit < len(text) and text[limit] not in b" \t\n\x0b\x0c\r":
        limit += 1
    return limit


def _step(n: int, odd: int) -> np.uint64:
    return np.uint64(n * odd & (1 << 64) - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """The distribution function of the number of darts, as far as a double tells it from 1."""
    steps, term, total = [], math.exp(-mean), 0.0
    for n in range(1, 200):
        total += term
        steps.append(total)
        if total >= 1 - 1e-16:
            break
        term *= mean / n
    return np.array(steps)


def darts(cells: np.ndarray, owners: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, rank and identity of every dart on the cells, up to the rank that the owner looks at."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low, high, strip = 0.0, FIRST_STRIP, 0
    limit = reach[owners]
    while True:
        seen = limit > low
        if not seen.any():
            break
        keys, who = mix(cells[seen] + _step(strip + 1, 0x9E3779B97F4A7C15)), owners[seen]
        # A strip is split until a cell has few darts in it, so that the counts stay small.
        parts = max(1, round((high - low) / 3))
        width = (high - low) / parts
        steps = _poisson_steps(width)
        for part in range(parts):
            own = mix(keys + _step(part, 0xA24BAED4963EE407))
            n = np.searchsorted(steps, _unit(own), side="right")
            hit = np.flatnonzero(n)
            nth = 1
            while len(hit):
                dart = mix(own[hit] + _step(nth, 0x9FB21C651E98DF25))
                rank = low + (part + _unit(dart)) * width
                near = rank < reach[who[hit]]
                found.append((who[hit][near], rank[near], mix(dart[near])))
                hit = hit[n[hit] > nth]
                nth += 1
        low, high, strip = high, high * 4, strip + 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(column) for column in zip(*found))


def signatures(cells: np.ndarray, owners: np.ndarray, n: int, k: int = K, t: float = T) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts with cells, and a row of k values for each."""
    weight = np.bincount(owners, minlength=n)
    present = np.flatnonzero(weight)
    out = np.zeros((n, k), np.uint64)
    reach = np.zeros(n)
    reach[present] = t / weight[present]
    todo = present
    while len(todo):
        mine = np.zeros(n, bool)
        mine[todo] = True
        chosen = mine[owners]
        who, rank, dart = darts(cells[chosen], owners[chosen], np.where(mine, reach, 0))
        place = who * k + (dart % np.uint64(k)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        best = np.full(n * k, -1, np.int64)
        best[place[order]] = order  # the earliest dart of a place is written last
        best = best.reshape(n, k)[todo]
        full = (best >= 0).all(axis=1)
        out[todo[full]] = dart[best[full]]
        todo = todo[~full]
        reach[todo] *= 2
    return present, out[present]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about as many bytes each."""
    sizes = pc.binary_length(batch.column(1)).to_pylist()
    begin = size = 0
    for i, n in enumerate(sizes):
        size += n
        if size >= _BATCH_BYTES or i == len(sizes) - 1:
            part = batch.slice(begin, i + 1 - begin)
            yield part, part.column(1).cast(pa.binary()).to_pylist()
            begin, size = i + 1, 0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The band keys of every text and its number of cells; the first one comes with a sketch, a byte
    of some coordinates, and with all keys."""
    for batch in batches:
        for part, texts in _groups(batch):
            cells, owners = shingle_cells(texts)
            present, values = signatures(cells, owners, len(texts))
            keys = np.zeros((len(present), BANDS), np.uint64)
            for row in range(ROWS):
                keys = mix(keys * _ODD + values[:, row::ROWS])
            keys = mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            ids = part.column(0).to_numpy(zero_copy_only=False)[present]
            sketches, all_keys = ([None] * (len(present) * BANDS) for _ in range(2))
            sketches[::BANDS] = [row.tobytes() for row in mix(values[:, :SKETCH]).astype(np.uint8)]
            all_keys[::BANDS] = [row.tobytes() for row in keys]
            sizes = np.bincount(owners, minlength=len(texts))[present]
            columns = [keys.reshape(-1).view(np.int64), np.repeat(ids, BANDS), np.repeat(sizes, BANDS)]
            yield pa.record_batch(
                [*(pa.array(c, pa.int64()) for c in columns), *(pa.array(c, pa.binary()) for c in (sketches, all_keys))],
                names=["band", "doc_id", "size", "sketch", "keys"],
            )


def _promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree in enough bytes that their texts may be alike."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
        kept = pa.array((x == y).mean(axis=1) >= MAY_BE_ALIKE)
        yield pa.record_batch([batch.column(0).filter(kept), batch.column(1).filter(kept)], names=["a", "b"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _groups(batch):
            cells, owners = shingle_cells(texts)
            order = np.lexsort((cells, owners))
            bounds = np.searchsorted(owners, np.arange(len(texts) + 1))
            packed = [cells[order[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.binary())], names=["doc_id", "cells"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, second, alike = batch.column(0), batch.column(1), []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([x, y])
            both.sort(kind="stable")  # two sorted runs
            shared = int((both[1:] == both[:-1]).sum())
            alike.append(shared >= SIMILARITY * (len(both) - shared))
        kept = pa.array(alike, pa.bool_())
        yield pa.record_batch([first.filter(kept), second.filter(kept)], names=["a", "b"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows with equal first three columns: the blocks of a sorted partition."""
    held, name = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
        cuts = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if held and tuple(names[:, begin]) != name:
                yield pa.Table.from_batches(held)
                held = []
            name = tuple(names[:, begin])
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _candidates(block: pa.Table, classes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a block with those that may be alike and are in another class now.

    Every pair comes in one bucket only, that of the first band that both texts share.
    """
    n = block.num_rows
    band, low, high = (block.column(i)[0].as_py() for i in range(3))
    band = np.array([band]).view(np.uint64)[0]
    second = block.column("second").to_numpy()
    sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(n, SKETCH)
    keys = np.frombuffer(b"".join(block.column("keys").to_pylist()), np.uint64).reshape(n, BANDS)
    right = np.flatnonzero(second) if low < high else np.arange(n)
    columns = np.ascontiguousarray(sketches[right].T)
    for i in np.flatnonzero(~second).tolist():
        at = 0 if low < high else i + 1
        same = (columns[:, at:] == sketches[i][:, None]).view(np.uint8).sum(axis=0, dtype=np.uint8)
        others = right[at:][same >= MAY_BE_ALIKE * SKETCH]
        others = others[classes[others] != classes[i]]
        if len(others):
            shared = keys[others] == keys[i]
            others = others[shared.any(axis=1) & (keys[i][shared.argmax(axis=1)] == band)]
        if len(others):
            yield i, others


def _promising_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of blocks that may be alike to another one there."""
    for block in _blocks(batches):
        wanted = np.zeros(block.num_rows, bool)
        for i, others in _candidates(block, block.column("class").to_numpy()):
            wanted[i] = True
            wanted[others] = True
        if wanted.any():
            yield from block.filter(pa.array(wanted)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of blocks that join classes, checked exactly; a pair whose classes are joined by then is not needed."""
    for block in _blocks(batches):
        classes, ids = block.column("class").to_numpy().copy(), block.column("doc_id").to_numpy()
        packed = block.column("cells").to_pylist()
        sizes = np.array([len(c) // 8 for c in packed])
        ends, codes, found = np.cumsum(sizes), None, []
        for i, others in _candidates(block, classes):
            if codes is None:
                values, codes = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)
                mine = np.zeros(len(values), bool)
                codes = np.split(codes, ends[:-1])
            least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
            others = others[least >= SIMILARITY * most]
            if not len(others):
                continue
            mine[codes[i]] = True
            starts = np.cumsum(sizes[others]) - sizes[others]
            shared = np.add.reduceat(mine[np.concatenate([codes[j] for j in others])], starts, dtype=np.int64)
            mine[codes[i]] = False
            for j in others[shared >= SIMILARITY * (sizes[others] + sizes[i] - shared)].tolist():
                if classes[j] != classes[i]:
                    found.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    classes[classes == classes[j]] = classes[i]
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])


def _words() -> Column:
    """The text's words with one space between them."""
    return F.trim(F.regexp_replace(text_of(), F.lit(SPACE + "+"), F.lit(" ")))


def copies(docs: DataFrame) -> DataFrame:
    """doc_id, the hash of the words and the smallest doc_id with the same ones, for documents with words and an id."""
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _words().alias("_w"))
    hashed = pin(rows.where("_w <> ''").select("doc_id", F.sha2("_w", 256).alias("_sha")))
    several = hashed.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    found = join_measured(hashed, several, ["_sha"], "left")
    return found.select("doc_id", "_sha", F.coalesce("_first", "doc_id").alias("first"))


def _first_texts(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """Rows whose words no document with a smaller id has. An id's other rows stay when one of them is a copy."""
    again = copied.where("doc_id <> first")
    mixed = pin(copied.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("doc_id") != F.col("first")).alias("c")).where("n > 1 AND c").select("doc_id"))
    if mixed.isEmpty():
        return without_ids(texts, again)
    hashed = join_measured(texts, mixed, ["doc_id"], "left_semi").withColumn("_sha", F.sha2(_words(), 256))
    others = join_measured(hashed, again.select("doc_id", "_sha").distinct(), ["doc_id", "_sha"], "left_anti")
    return without_ids(texts, again.select("doc_id").unionByName(mixed)).unionByName(others.drop("_sha"))


def _in_parts(pinned: DataFrame, rows: int) -> DataFrame:
    """A pinned table in as many parts as its rows need (an action): later rounds are many and small."""
    return pinned.coalesce(pinned.count() // rows + 1)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) of an edge list (a, b).

    Large stars and small stars in turn: every node hands its neighbours to the smallest one it
    knows, until all hang on their root. Minima are combined before the shuffle.
    """
    state = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        parts = state.count() // EDGES_PER_PART + 1
        state = state.coalesce(parts)
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        told = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = told.coalesce(parts).distinct().coalesce(parts)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a").coalesce(parts)
        told = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        state = pin(told.select("e.*").where("a <> b").distinct().coalesce(parts))
        # Done when every node hangs on one root that hangs on none.
        ends = state.select(F.col("a").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
            state.select(F.col("b").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
        )
        open_ = ends.groupBy("x").agg(F.sum("hangs").alias("n"), F.max("holds").alias("h")).where("n > 1 OR n = 1 AND h = 1").coalesce(parts)
        if not open_.agg(F.count("*")).first()[0]:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _paired(buckets: DataFrame, classes: DataFrame | None, order: int, parts: int) -> DataFrame:
    """Members of every bucket with some of its members of another class.

    At first all with the bucket's central member, the one that shares most buckets with others:
    the text that edited copies were made from, if it is there. That ends most of the work on
    large groups of copies. Then those outside the bucket's smallest class, which is most often its
    large one, with the first and the last of that class, and with the first and the last among
    themselves, in an order of the bucket's own: two texts that share buckets meet in one of them
    even where others lie between them.
    """
    if classes is None:
        central = buckets.groupBy("band").agg(F.max(F.struct("met", (-F.col("doc_id")).alias("d"))).alias("c"))
        star = buckets.join(central.select("band", (-F.col("c.d")).alias("_end")), "band").where("doc_id <> _end")
        return star.select(F.least("doc_id", "_end").alias("a"), F.greatest("doc_id", "_end").alias("b")).coalesce(parts).distinct()
    rows = join_measured(buckets, classes, ["doc_id"], "left").withColumn("class", F.coalesce("class", "doc_id"))
    rows = rows.withColumn("o", F.xxhash64(F.lit(order), "band", "doc_id"))
    ends = [F.min(F.struct("class", o, "doc_id")) for o in (F.col("o"), F.bitwise_not("o").alias("o"))]
    least = rows.groupBy("band").agg(F.array(*ends).alias("_ends"), F.max("class").alias("hi")).where("hi > _ends[0].class")
    others = rows.join(least.drop("hi"), "band").where("class > _ends[0].class")
    pairs = others.select("doc_id", F.explode("_ends.doc_id").alias("_end"))
    members = F.struct("o", "doc_id", "class")
    ends = others.groupBy("band").agg(
        F.array(F.min(members), F.max(members)).alias("_ends"), F.min("class").alias("lo"), F.max("class").alias("hi")
    ).where("lo < hi").select("band", F.explode("_ends").alias("f"))
    among = others.drop("_ends").join(ends, "band").where("class <> f.class")
    pairs = pairs.unionByName(among.select("doc_id", F.col("f.doc_id").alias("_end")))
    return pairs.select(F.least("doc_id", "_end").alias("a"), F.greatest("doc_id", "_end").alias("b")).coalesce(parts).distinct()


def _likely(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches don't rule them out; what an exact check is worth."""
    first = sketches.select(F.col("doc_id").alias("sketched_a"), F.col("sketch").alias("_x"))
    second = sketches.select(F.col("doc_id").alias("sketched_b"), F.col("sketch").alias("_y"))
    full = pairs.join(first, F.col("a") == F.col("sketched_a")).join(second, F.col("b") == F.col("sketched_b"))
    return by_batches(full.select("a", "b", "_x", "_y"), _promising, "a bigint, b bigint")


def _cells_of(named: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id and packed cells of the texts with these ids."""
    wanted = join_measured(texts, named, ["doc_id"], "left_semi")
    cells = staged(by_batches(wanted, _cells, "doc_id bigint, cells binary"), "cells")
    return _in_parts(cells, CELLS_PER_PART)


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose weighted Jaccard index reaches the threshold."""
    cells = _cells_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), texts)
    second = cells.select(F.col("doc_id").alias("shingled_b"), F.col("cells").alias("cells_b"))
    first = cells.select(F.col("doc_id").alias("shingled_a"), F.col("cells").alias("cells_a"))
    full = pairs.join(second, F.col("b") == F.col("shingled_b")).join(first, F.col("a") == F.col("shingled_a"))
    return by_batches(full.select("a", "b", "cells_a", "cells_b"), _compare, "a bigint, b bigint")


def _dealt(buckets: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of every bucket with several classes, once for each block that they are in.

    Chunks below ``_others`` are of members outside the largest class. Each of these meets itself and
    all other chunks; a block is named by the bucket and its two chunks.
    """
    rows = join_measured(buckets.drop("met"), classes, ["doc_id"], "left").withColumn("class", F.coalesce("class", "doc_id"))
    of_class = rows.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    sums = [F.max(F.struct("n", "class", "s")).alias("big"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("c")]
    # Of two members the first round has tested the only pair.
    several = of_class.groupBy("band").agg(*sums).where("c > 1 AND n > 2")
    whole = (F.col("n") <= CHUNK) & (F.col("s") <= CHUNK_CELLS)
    chunks = lambda n, s: F.ceil(F.greatest(n / CHUNK, s / CHUNK_CELLS, F.lit(1.0))).cast("int")
    several = several.select(
        "band",
        F.when(~whole, F.col("big.class")).alias("_big"),
        F.when(whole, 1).otherwise(chunks(F.col("n") - F.col("big.n"), F.col("s") - F.col("big.s"))).alias("_others"),
        F.when(whole, 0).otherwise(chunks(F.col("big.n"), F.col("big.s"))).alias("_bigs"),
    )
    held = join_measured(rows, several, ["band"])
    inside = F.coalesce(F.col("class") == F.col("_big"), F.lit(False))
    spread = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    held = held.withColumn("_own", F.when(inside, F.col("_others") + spread(F.greatest("_bigs", F.lit(1)))).otherwise(spread(F.col("_others"))))
    meets = F.sequence(F.lit(0), F.col("_others") + F.when(inside, 0).otherwise(F.col("_bigs")) - 1)
    met = held.withColumn("_with", F.explode(meets))
    return met.select(
        "band", F.least("_own", "_with").alias("low"), F.greatest("_own", "_with").alias("high"),
        (F.col("_own") > F.col("_with")).alias("second"), "doc_id", "class",
    )


def _rest(buckets: DataFrame, classes: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among all pairs of a bucket that are in two classes: as many as join the classes of a block."""
    fields = "band bigint, low int, high int, second boolean, doc_id bigint, class bigint, sketch binary, keys binary"
    name = ["band", "low", "high"]
    of_member = sketches.select(F.col("doc_id").alias("sketched"), "sketch", "keys")
    dealt = _dealt(buckets, classes)
    full = dealt.join(of_member, F.col("doc_id") == F.col("sketched")).drop("sketched")
    sorted_ = full.repartition(*name).sortWithinPartitions(*name)
    members = pin(by_batches(sorted_, _promising_members, fields))
    if members.isEmpty():
        return members.selectExpr("doc_id a", "doc_id b")
    cells = _cells_of(members.select("doc_id").distinct(), texts).withColumnRenamed("doc_id", "shingled")
    full = members.join(cells, F.col("doc_id") == F.col("shingled")).drop("shingled")
    return pin(by_batches(full.repartition(*name).sortWithinPartitions(*name), _linked, "a bigint, b bigint"))


def near_classes(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class) and class_size of every row."""
    copied = pin(copies(docs))
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    distinct = _first_texts(texts, copied)
    bands = pin(by_batches(distinct, _sign, "band bigint, doc_id bigint, size bigint, sketch binary, keys binary"))
    shared = bands.groupBy("band").agg(F.count("*").alias("_n")).where("_n > 1")
    buckets = pin(bands.select("band", "doc_id", "size").join(shared, "band").distinct())
    parts = buckets.count() // MEMBERS_PER_PART + 1
    met = buckets.coalesce(parts).groupBy("doc_id").agg(F.sum("_n").alias("met"))
    buckets = pin(buckets.coalesce(parts).drop("_n").join(met, "doc_id").coalesce(parts))
    buckets = buckets.coalesce(parts)
    members = buckets.select("doc_id").distinct()
    sketches = bands.where("sketch IS NOT NULL").select("doc_id", "sketch", "keys")
    sketches = _in_parts(pin(join_measured(sketches, members, ["doc_id"], "left_semi")), MEMBERS_PER_PART)
    edges = copied.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    links, classes, tested = None, None, None
    for order in range(rounds):
        if links is not None:
            classes = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("class"))
        pairs = _paired(buckets, classes, order, parts)
        pairs = pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti")
        pairs = _in_parts(pin(_likely(pairs, sketches).coalesce(parts)), PAIRS_PER_PART)
        found = _in_parts(pin(_verified(pairs, distinct)), EDGES_PER_PART)
        if order and found.isEmpty():
            break
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)
    # Whatever the rounds have left: pairs of a bucket that are in two classes still.
    classes = components(links).select(F.col("node").alias("doc_id"), F.col("root").alias("class"))
    links = links.unionByName(_rest(buckets, classes, sketches, distinct))
    whole = components(edges.unionByName(links))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    found = join_measured(ids, whole.withColumnRenamed("node", "doc_id"), ["doc_id"], "left")
    classed = pin(found.select("doc_id", F.coalesce("root", "doc_id").alias("class_id")))
    sizes = classed.groupBy("class_id").agg(F.count("*").alias("class_size")).where("class_size > 1 AND class_id IS NOT NULL")
    return join_measured(classed, sizes, ["class_id"], "left").select(
        "doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def stage(docs: DataFrame) -> DataFrame:
    """One document of each class: that with the smallest doc_id. Rows without an id are documents of their own, after all others."""
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return without_ids(docs, near_classes(docs).where("doc_id <> class_id"))
    (key,) = fresh(docs, "_key")
    last = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    after = F.lit(0 if last is None else last + 1).cast("long") + F.monotonically_increasing_id()
    named = staged(nameless.withColumn(key, after), "nameless")
    keyed = docs.where("doc_id IS NOT NULL").withColumn(key, F.col("doc_id").cast("long")).unionByName(named)
    classes = near_classes(keyed.select(F.col(key).alias("doc_id"), "text"))
    gone = classes.where("doc_id <> class_id").select(F.col("doc_id").alias(key)).distinct()
    return join_measured(keyed, gone, [key], "left_anti").select(*docs.columns)
