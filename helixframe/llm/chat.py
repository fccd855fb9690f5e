"""Chat formatting: conversations logged turn by turn are collapsed to the maximal ones and rendered.

A log that is written after every turn holds each conversation many times, as ever longer
snapshots. A rolling hash over turn prefixes gives every prefix of every conversation a value (two
64-bit hashes of position, role and text, summed exactly, and the number of rows). A conversation
whose whole value is a proper prefix value of any other one is dropped by an anti join; of equal
conversations the smallest conv_id stays. What is left is rendered.

Running sums have two levels, blocks of turns and turns inside a block, and a long conversation is
rendered in parts, so that one with a third of all rows does not meet in one group. All of it is
DataFrame operations.

Defined results: a null turn comes after all others, a null role reads ``unknown``, a null text is
empty; a null conv_id is a conversation of its own and the last choice among equals. Rows with the
same turn belong together: a prefix ends after all of them, and they are rendered in the order of
role and text; repeated rows are rendered repeatedly. Texts cannot forge turn marks: ``<|`` is
written ``< |``. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import pin

HASH_BLOCK = 64
PART_TURNS = 256
LAST = (1 << 63) - 1


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(LAST)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, the value (h1, h2, n) of each turn prefix, and the whole value (t1, t2, tn)."""
    seeded = lambda seed: F.xxhash64(F.lit(seed), "turn", "role", "text").cast("decimal(20,0)")
    block = F.expr(f"turn div {HASH_BLOCK}")
    rows = pin(turns.select("conv_id", "turn", block.alias("_block"), seeded(1).alias("a"), seeded(2).alias("b")))
    sums = [F.sum("a").cast("decimal(38,0)"), F.sum("b").cast("decimal(38,0)"), F.count("*")]
    blocks = rows.groupBy("conv_id", "_block").agg(*(s.alias(n) for s, n in zip(sums, "xyn")))
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    based = blocks.select(
        F.col("conv_id").alias("_c"), F.col("_block").alias("_b"),
        *(F.coalesce(F.sum(c).over(before).cast("decimal(38,0)"), zero).alias(f"_base{c}") for c in "xyn"),
        *(F.sum(c).over(whole).cast("decimal(38,0)").alias(t) for c, t in zip("xyn", ("t1", "t2", "tn"))),
    )
    inside = Window.partitionBy("conv_id", "_block").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # Ties share a value; one row for each turn is enough.
    within = rows.groupBy("conv_id", "_block", "turn").agg(
        *(s.alias(n) for s, n in zip([F.sum("a"), F.sum("b"), F.count("*")], "abm"))
    ).select(
        "conv_id", "_block",
        *(F.sum(c).over(inside).cast("decimal(38,0)").alias(c) for c in "abm"),
    )
    joined = within.join(
        based, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b"))
    )
    return joined.select(
        "conv_id",
        *((F.col(f"_base{x}") + F.col(c)).cast("decimal(38,0)").alias(h) for x, c, h in zip("xyn", "abm", ("h1", "h2", "n"))),
        "t1", "t2", "tn",
    )


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id of the conversations that no other one continues, one of equal ones."""
    values = pin(prefix_hashes(_turns(conversations)))
    whole = values.where("n = tn").select("conv_id", "t1", "t2", "tn")
    chosen = whole.groupBy("t1", "t2", "tn").agg(F.min("conv_id").alias("conv_id"))
    prefixes = values.where("n < tn").select(F.col("h1").alias("t1"), F.col("h2").alias("t2"), F.col("n").alias("tn")).distinct()
    return chosen.join(prefixes, ["t1", "t2", "tn"], "left_anti").select("conv_id")


def rendered(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns and text of the maximal conversations."""
    keep = maximal(conversations).withColumnRenamed("conv_id", "_keep")
    turns = _turns(conversations).join(keep, F.col("conv_id").eqNullSafe(F.col("_keep")), "left_semi")
    parts = turns.groupBy("conv_id", F.expr(f"turn div {part_turns}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    )
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    marked = F.transform(
        "_turns", lambda x: F.concat(F.lit("<|"), safe(x["role"]), F.lit("|>\n"), safe(x["text"]), F.lit("<|end|>\n"))
    )
    return parts.select(
        "conv_id", "part", F.size("_turns").cast("long").alias("n_turns"), F.array_join(marked, "").alias("text")
    )


def oracle() -> str:
    return f"""
    WITH r AS (SELECT conv_id, coalesce(turn, {LAST}) AS k, coalesce(role, 'unknown') AS role, coalesce(text, '') AS t
               FROM conversations),
    c AS (SELECT conv_id, list({{'k': k, 'role': role, 't': t}} ORDER BY k, role, t) AS l FROM r GROUP BY conv_id),
    u AS (SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l),
    m AS (SELECT conv_id FROM u x WHERE NOT EXISTS (
            SELECT 1 FROM c y WHERE y.l[1] = x.l[1] AND len(y.l) > len(x.l) AND y.l[1:len(x.l)] = x.l
              AND y.l[len(x.l) + 1].k > x.l[len(x.l)].k))
    SELECT r.conv_id, k // {PART_TURNS} AS part, count(*) AS n_turns,
           string_agg('<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(t, '<|', '< |')
                      || '<|end|>' || chr(10), '' ORDER BY k, role, t) AS text
    FROM r JOIN m ON r.conv_id IS NOT DISTINCT FROM m.conv_id GROUP BY r.conv_id, part"""
