"""Prefix trie of conversations by ROLLUP over positional turn columns.

A turn is known by 128 bits of the SHA-256 of its role and text. A conversation becomes rows of
``WIDTH`` turn columns, a row for each block of as many turns; a row names the node where its block
begins by XOR hashes of the blocks before. ``GROUP BY block, node, ROLLUP(t1 .. t8)`` then groups the
members of every prefix at once, and ``grouping_id`` tells the depth inside the block. A block whose
rollup is complete ends in the node that its successors are keyed by, so a trie of any depth takes
one grouping and no loop.

What sums over subtrees needs no walk either. The smallest member of a node is the smallest member
of every deeper node on its path; the depth where a conversation first is one, its branch depth, tells
all: the turns above it are shared with smaller conversations (and saved), a node's children are the
members that branch off right below or go on, and a leaf is counted with its smallest member. So a
second ROLLUP over the same columns adds up members, and gives subtree sums.

A conversation of any length is numbered in two levels (ranges of the whole table's order, offsets of
the few that cross a range), and its block hashes are chained in two levels, so none meets in one
task. Ids that end in a node are digested as a stream of pieces in order: SHA-256 is sequential, so a
node's digest is one task's work, in constant memory.

Defined results: null turns come first, a null role or text is empty, equal turns of a conversation
are ordered by the SHA-256 of role and text; repeated rows are repeated turns. Rows without a conv_id
belong to no conversation and are left out. An empty table has no nodes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import by_batches, word_count

#: Turns in a block.
WIDTH = 8
#: Blocks whose hashes are chained at once.
CHUNK = 64
#: Text of ids in one piece.
PIECE_BYTES = 1 << 16
#: Conversations are rebuilt from the first one of so many.
FAMILY = 20
HEADS = 4
_T = [f"t{i}" for i in range(1, WIDTH + 1)]
_KEY = ["depth", "kx", "ky"]
_LEVELS = range(WIDTH + 1)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), tid and words of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(named, 256), 1, 32)).alias("tid"),
        word_count(text).alias("words"),
        F.spark_partition_id().alias("_source"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("tid")]
    # Copies of one row are spread by where they came from; their order does not matter.
    ranged = pin(turns.repartitionByRange("conv_id", *order, "_source").withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most one conversation goes on at the start of a range.
    continued = counts.withColumn("_before", F.sum("n").over(earlier)).where("_before > 0").drop("n")
    inside = F.row_number().over(Window.partitionBy("conv_id", "_range").orderBy(*order))
    placed = ranged.withColumn("_nth", inside).join(F.broadcast(continued), ["conv_id", "_range"], "left")
    return placed.select(
        "conv_id", (F.col("_nth") + F.coalesce("_before", F.lit(0))).cast("long").alias("pos"), "tid", "words"
    )


def conversation_sizes(turns: DataFrame) -> DataFrame:
    """conv_id and size, its number of turns."""
    return turns.groupBy("conv_id").agg(F.count("*").alias("size"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and sizes of conversations that begin like their family's first one.

    The first ``crc32(id) % 4`` turns come from the family's first conversation, the rest are the
    conversation's own after as many.
    """
    turns = pin(turns)
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = conversation_sizes(turns).select(
        F.col("conv_id").alias("_conv"),
        base.alias("_base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("_head"),
        F.col("size").alias("_own"),
    )
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    there = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.count("*").alias("_there"))
    taken = F.least("_head", F.coalesce("_there", F.lit(0)))
    plan = pin(
        own.join(there, "_base", "left").select(
            "_conv", "_base", "_head", taken.alias("_taken"),
            (taken + F.greatest(F.col("_own") - F.col("_head"), F.lit(0))).alias("size"),
        )
    )
    kept = turns.withColumnRenamed("conv_id", "_conv").join(plan, "_conv").where("pos > _head")
    kept = kept.select(F.col("_conv").alias("conv_id"), (F.col("pos") - F.col("_head") + F.col("_taken")).alias("pos"), "tid", "words")
    lent = heads.withColumnRenamed("conv_id", "_base").join(plan, "_base").where("pos <= _taken")
    lent = lent.select(F.col("_conv").alias("conv_id"), "pos", "tid", "words")
    return kept.unionByName(lent), plan.select(F.col("_conv").alias("conv_id"), "size")


def _chained(seed: int, level: Column, columns: list[Column]) -> Column:
    """The part of a node's name that its block's turns give; absent turns don't count."""
    return F.xxhash64(F.lit(seed), "block", level.cast("int"), *columns)


def blocks(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row per conversation and block: turn columns, words before each, size, and the node (px, py) it begins at."""
    slot = (F.col("pos") - 1) % WIDTH
    at = lambda i, c: F.when(slot == i, F.col(c))
    filled = turns.groupBy("conv_id", F.expr(f"(pos - 1) div {WIDTH}").alias("block")).agg(
        *(F.max(at(i, "tid")).alias(t) for i, t in enumerate(_T)),
        *(F.coalesce(F.max(at(i, "words")), F.lit(0)).alias(f"_w{i}") for i in range(WIDTH)),
    )
    # Conversations without a turn are members of the root.
    bare = sizes.where("size = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"),
        *(F.lit(None).cast("binary").alias(t) for t in _T), *(F.lit(0).cast("long").alias(f"_w{i}") for i in range(WIDTH)),
    )
    rows = filled.unionByName(bare)
    full = [F.col(t) for t in _T]
    words = sum((F.col(f"_w{i}") for i in range(WIDTH)), F.lit(0))
    hashed = pin(
        rows.withColumns({
            "_chunk": F.expr(f"block div {CHUNK}"),
            "_x": _chained(1, F.lit(WIDTH), full), "_y": _chained(2, F.lit(WIDTH), full), "_w": words,
        })
    )
    folds = {"x": F.bit_xor("_x"), "y": F.bit_xor("_y"), "w": F.sum("_w")}
    chunks = hashed.groupBy("conv_id", "_chunk").agg(*(f.alias(f"_{k}") for k, f in folds.items()))
    over = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = chunks.select("conv_id", "_chunk", *(f.over(over).alias(f"_b{k}") for k, f in folds.items())).where("_chunk > 0")
    within = Window.partitionBy("conv_id", "_chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    local = hashed.withColumns({f"_l{k}": F.coalesce(f.over(within), zero) for k, f in folds.items()})
    # Only conversations of over WIDTH * CHUNK turns have an entry.
    joined = join_measured(local, based, ["conv_id", "_chunk"], "left")
    far = {k: F.coalesce(f"_b{k}", zero) for k in folds}
    before = [F.col("_lw") + far["w"]]
    for i in range(WIDTH - 1):
        before.append(before[-1] + F.col(f"_w{i}"))
    return joined.join(sizes, "conv_id").select(
        "conv_id", "block", "size", *_T,
        F.col("_lx").bitwiseXOR(far["x"]).alias("px"), F.col("_ly").bitwiseXOR(far["y"]).alias("py"),
        *(b.cast("long").alias(f"b{i}") for i, b in enumerate(before, 1)),
        (before[-1] + F.col(f"_w{WIDTH - 1}")).alias("until"),
    )


def _named(level: Column) -> tuple[Column, Column]:
    """The name of the node so many turns into a row's block."""
    columns = [F.when(level >= i, F.col(t)) for i, t in enumerate(_T, 1)]
    part = lambda seed: F.when(level > 0, _chained(seed, level, columns)).otherwise(F.lit(0).cast("long"))
    return F.col("px").bitwiseXOR(part(1)), F.col("py").bitwiseXOR(part(2))


def _rollup(rows: DataFrame, aggregates: dict[str, str]) -> DataFrame:
    """One row per node: block, px, py, turn columns, level in the block, depth and the aggregates."""
    turns = ", ".join(_T)
    listed = ", ".join(f"{expression} AS {name}" for name, expression in aggregates.items())
    grouped = rows.sparkSession.sql(
        f"SELECT block, px, py, {turns}, CAST({WIDTH} - bit_count(grouping_id()) AS INT) AS level, {listed} "
        f"FROM {{rows}} GROUP BY block, px, py, ROLLUP({turns})",
        rows=rows,
    )
    # The top of a block is the end of the one before, and groups of absent turns are no nodes.
    is_node = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(
        F.element_at(F.array(*_T), F.greatest("level", F.lit(1))).isNotNull()
    )
    return grouped.where(is_node).withColumn("depth", F.col("block") * WIDTH + F.col("level"))


def _at_level(names: list[str]) -> Column:
    return F.element_at(F.array(*names), F.col("level") + 1)


def branches(rows: DataFrame) -> DataFrame:
    """conv_id, branch (depth of the first node it is the smallest member of), shared (words above) and ends_leaf."""
    before = {f"v{i}": f"max(b{max(i, 1)})" for i in _LEVELS}
    nodes = _rollup(rows, {"conv_id": "min(conv_id)", "longest": "max(size)"} | before)
    # Words above the root: none, as above its children.
    return nodes.groupBy("conv_id").agg(
        F.min("depth").alias("branch"),
        F.min_by(_at_level([*before]), "depth").alias("shared"),
        F.max((F.col("longest") == F.col("depth")).cast("int")).alias("ends_leaf"),
    )


def _ends(rows: DataFrame) -> DataFrame:
    """conv_id, its words, and the node that it ends in."""
    last = rows.where(F.col("block") == F.expr(f"greatest(size - 1, 0) div {WIDTH}"))
    kx, ky = _named(F.col("size") - F.col("block") * WIDTH)
    return last.select("conv_id", F.col("size").alias("depth"), kx.alias("kx"), ky.alias("ky"), F.col("until").alias("words"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of a node that follow each other, joined by commas."""
    node, first, ids, size = None, None, [], 0
    out: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        kinds = (pa.int64(),) * 4 + (pa.string(),)
        columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]
        out.clear()
        return pa.record_batch(columns, names=[*_KEY, "first", "ids"])

    held = 0
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (key != node or size >= PIECE_BYTES):
                out.append((*node, first, ",".join(ids)))
                held += size
                ids, size = [], 0
                if len(out) >= 4096 or held >= 1 << 22:
                    yield flushed()
                    held = 0
            if not ids:
                node, first = key, conv
            ids.append(str(conv))
            size += len(ids[-1]) + 1
    if ids:
        out.append((*node, first, ",".join(ids)))
    if out:
        yield flushed()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node; a node's pieces arrive in order and pass through."""
    node, digest = None, None
    for batch in batches:
        out = []
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in [*_KEY, "ids"])):
            if key != node:
                if digest is not None:
                    out.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield _digest_batch(out)
    if digest is not None:
        yield _digest_batch([(*node, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(),) * 3 + (pa.string(),)
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=[*_KEY, "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """The digest of each node's ending conv_ids in order."""
    narrow = ends.select(*_KEY, "conv_id")
    ordered = narrow.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    pieces = by_batches(ordered, _pieces, "depth bigint, kx bigint, ky bigint, first bigint, ids string")
    dealt = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first")
    return by_batches(dealt, _digests, "depth bigint, kx bigint, ky bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row per node of the conversations' trie.

    ``turns`` has conv_id, pos (1, 2, ... without gaps), tid and words, ``sizes`` conv_id and size
    of every conversation, those without turns included.
    """
    rows = pin(blocks(turns, sizes))
    ends = pin(_ends(rows))
    told = ends.join(branches(rows), "conv_id", "left").select(
        "conv_id",
        F.coalesce("branch", F.col("depth") + 1).alias("branch"),
        F.coalesce("shared", "words").alias("shared"),
        F.coalesce("ends_leaf", F.lit(0)).cast("long").alias("ends_leaf"),
    )
    depth = [f"(block * {WIDTH} + {i})" for i in _LEVELS]
    kids = {f"k{i}": f"count_if(branch <= {d} + 1 AND size > {d})" for i, d in enumerate(depth)}
    # What a member shares from here down.
    saved = {
        f"s{i}": f"coalesce(sum(shared - {f'b{i}' if i else '0'}) FILTER (WHERE branch > {d}), 0)" for i, d in enumerate(depth)
    }
    nodes = _rollup(
        rows.join(told, "conv_id"),
        {"conv_id": "min(conv_id)", "n_convs": "count(*)", "n_leaves": "sum(ends_leaf)"} | kids | saved,
    )
    (kx, ky), (ux, uy) = _named(F.col("level")), _named(F.col("level") - 1)
    tree = pin(
        nodes.select(
            "conv_id", "depth", kx.alias("kx"), ky.alias("ky"), ux.alias("_ux"), uy.alias("_uy"), "n_convs", "n_leaves",
            _at_level([*kids]).alias("n_children"), _at_level([*saved]).alias("saved_tokens"),
        )
    )
    above = tree.select((F.col("depth") + 1).alias("depth"), F.col("kx").alias("_ux"), F.col("ky").alias("_uy"), F.col("conv_id").alias("parent_conv_id"))
    known = tree.join(above, ["depth", "_ux", "_uy"], "left").join(ends_digests(ends), _KEY, "left")
    return known.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def plain_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are."""
    turns = pin(turn_rows(conversations))
    return prefix_trie(turns, conversation_sizes(turns))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return prefix_trie(*rebuilt(turn_rows(conversations)))


def oracle() -> str:
    return r"""
    WITH o AS (
      SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
               sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
      FROM conversations WHERE conv_id IS NOT NULL),
    h AS (SELECT c, CAST(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(s)), lambda i: ascii(s[i + 1])::BIGINT)),
            lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)),
              lambda b, k: CASE WHEN b % 2 = 1 THEN xor(b // 2, 3988292384) ELSE b // 2 END)) AS BIGINT) AS z
          FROM (SELECT DISTINCT c, c::VARCHAR AS s FROM o)),
    g AS (SELECT c, (4294967295 - z) % 4 AS h FROM h),
    a AS (SELECT g.c, o.r, o.t, o.p AS k FROM g JOIN o ON o.c = g.c - g.c % 20 WHERE o.p <= g.h
          UNION ALL SELECT g.c, o.r, o.t, 1000000 + o.p FROM g JOIN o ON o.c = g.c WHERE o.p > g.h),
    l AS (SELECT g.c, coalesce(list({'r': a.r, 't': a.t} ORDER BY a.k) FILTER (WHERE a.k IS NOT NULL), []) AS l
          FROM g LEFT JOIN a ON a.c = g.c GROUP BY g.c),
    e AS (SELECT c, d, l[1:d] AS x, len(l) = d AS fin FROM l, range(0, 1000) r(d) WHERE d <= len(l)),
    n AS (SELECT x, d, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE fin), '')) AS s,
            CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(x[d].t, '[^\x20\x09-\x0D]+')) END AS w
          FROM e GROUP BY x, d),
    k AS (SELECT x[1:d - 1] AS u, d - 1 AS ud, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1, 2),
    f AS (SELECT n.*, coalesce(k.kids, 0) AS kids FROM n LEFT JOIN k ON k.u = n.x AND k.ud = n.d),
    m AS (SELECT f.x[1:r.d] AS x, r.d AS d, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum(f.w) AS w
          FROM f, range(0, 1000) r(d) WHERE r.d <= f.d GROUP BY 1, 2)
    SELECT f.c AS conv_id, f.d AS depth, p.c AS parent_conv_id, f.n_convs, f.kids AS n_children, m.leaves AS n_leaves,
           CAST(m.w AS BIGINT) AS saved_tokens, f.s AS ends_sha256
    FROM f JOIN m ON m.x = f.x AND m.d = f.d LEFT JOIN n p ON p.x = f.x[1:f.d - 1] AND p.d = f.d - 1 AND f.d > 0"""
