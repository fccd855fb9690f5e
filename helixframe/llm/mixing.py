"""Mixing sources to target weights: a time-varying curriculum.

Every source has a weight schedule over training time, a piecewise linear curve. Its integral,
scaled to the source's target, is the source's cumulative demand for words. Documents of a source
stand in a fixed hashed order; each taken pass over a document starts at a cumulative offset, and
inverting the demand at that offset gives the moment the document is due. The words that all
sources together have demanded until then are its training position, by which documents are
range-sorted.

Offsets within a source come from two levels of running sums, over 4096 slices of the hash and
inside a slice, so that a source with a third of all rows is spread over 4096 groups. Sources
themselves are a catalogue of one row each.

Defined results: a null text has size 0, a null source is a source of its own and comes last, a
document of size 0 takes 0 words. Repeated rows are documents of their own: each gets its own
offset. Rows are ordered by a hash of id and text, so null or repeated ids are spread like others. An
empty table gives an empty result; a text is counted whole, however long. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import join_measured
from ..session import pin
from .common import fresh, text_of, word_count

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
#: Knots (time, relative weight) per weight class: early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
Schedule = Sequence[tuple[float, float]]


def hashed_order() -> Column:
    """What orders the documents of a source, and names a row: ids that many rows share, or lack, are told apart by text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.md5(text_of())))


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hashed order; the only step that reads texts."""
    return docs.select("doc_id", "source", word_count(text_of()).alias("size"), hashed_order().alias("_order"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_PASSES) -> DataFrame:
    """One row per source: source_size, weight class and target.

    Targets share the total by weight; none exceeds ``cap`` times its source, and what a capped
    source leaves goes to the others by weight. With sources ordered by cap per weight the capped
    ones are a prefix, and the common level is the largest of the levels that follow from capping
    the first k.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sources.withColumn(
        "class",
        (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights),
    )
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), F.col("class") + 1)
    whole = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    capped = ranked.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * cap)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    rest = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = capped.withColumn("_level", left.cast("double") / rest)
    target = F.least(F.col("_cap").cast("double"), F.col("weight") * F.max("_level").over(whole))
    return levels.withColumn("target", target).select("source", "source_size", "class", "target")


def _segments(schedule: Schedule) -> list[tuple[float, float, float, float, float]]:
    """(t0, t1, share before t0, weight at t0, slope), scaled so that the integral over time is 1."""
    total = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    done, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((t0, t1, done, w0 / total, (w1 - w0) / (t1 - t0) / total))
        done += (t1 - t0) * (w0 + w1) / 2 / total
    return out


def _share_until(t: Column, schedule: Schedule) -> Column:
    """The integral of the schedule up to time t."""
    value = F.lit(0.0)
    for t0, _, done, w0, slope in _segments(schedule):
        x = t - F.lit(t0)
        value = F.when(x >= 0, F.lit(done) + x * F.lit(w0) + x * x * F.lit(slope / 2)).otherwise(value)
    return value


def _time_of(share: Column, schedule: Schedule) -> Column:
    """The time at which the integral reaches a share: its inverse, a root per segment."""
    value = F.lit(0.0)
    for t0, _, done, w0, slope in _segments(schedule):
        y = share - F.lit(done)
        root = 2 * y / (F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * y, F.lit(0.0))))
        value = F.when(y >= 0, F.lit(t0) + root).otherwise(value)
    return value


def curriculum(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    schedules: Sequence[Schedule] = SCHEDULES,
    passes: int = MAX_PASSES,
) -> DataFrame:
    """One row per document: source, size, source_size, target, taken, ``positions`` and ``order_key``.

    ``positions`` has the training position, in words, of each pass that the mix takes. A pass is
    taken when its middle lies below the target, so a source misses its target by at most half a
    document.
    """
    sizes = pin(measure(docs))
    targets = pin(source_targets(sizes, weights, passes))
    slice_ = F.substring("_order", 1, 3)
    sums = sizes.groupBy("source", slice_.alias("_slice")).agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # One row per source and slice, with all that its documents need to know of the source.
    totals = [F.sum(F.when(F.col("class") == i, F.col("target")).otherwise(0.0)).over(Window.partitionBy()) for i in range(len(weights))]
    known = targets.select("*", *(t.alias(f"_total{i}") for i, t in enumerate(totals)))
    based = sums.select(
        F.col("source").alias("_s"), "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    ).join(known.withColumnRenamed("source", "_s2"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    inside = (
        Window.partitionBy("source", "_slice").orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sizes.withColumn("_slice", slice_).withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # A join key that is never null, so that the null source meets itself.
    key = lambda c: F.concat(F.when(c.isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(c, F.lit("")), F.lit(" "), F.col("_slice"))
    based = based.withColumn("_key", key(F.col("_s"))).drop("_s", "_slice")
    joined = join_measured(placed.withColumn("_key", key(F.col("source"))), based, ["_key"])

    def position(i: int) -> Column:
        start = F.col("source_size") * i + F.col("_base") + F.col("_in")
        taken = (F.col("size") > 0) & ((2 * start + F.col("size")).cast("double") <= 2 * F.col("target"))
        share = start.cast("double") / F.col("target")
        due = F.lit(None).cast("double")
        for k, schedule in enumerate(schedules):
            due = F.when(F.col("class") == k, _time_of(share, schedule)).otherwise(due)
        demanded = lambda t: sum((F.col(f"_total{k}") * _share_until(t, s) for k, s in enumerate(schedules)), F.lit(0.0))
        return F.when(taken, F.transform(F.array(due), demanded)[0])

    positions = F.filter(F.array(*(position(i) for i in range(passes))), lambda p: p.isNotNull())
    return joined.withColumn("positions", positions).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.size("positions") * F.col("size")).cast("long").alias("taken"), "positions",
        F.col("_order").alias("order_key"),
    )


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per taken pass, range-sorted by training position."""
    due = pin(mixed.select("*", F.posexplode("positions").alias("pass", "position")).drop("positions"))
    return due.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def report(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the position of its first pass, documents never taken last."""
    first = curriculum(docs).select(
        "doc_id", "size", "source_size", "target", "taken",
        F.floor(F.get("positions", F.lit(0))).cast("long").alias("first_position"),
    )
    order = (F.col("first_position").asc_nulls_last(), F.col("doc_id"))
    return pin(first).repartitionByRange(*order).sortWithinPartitions(*order)


def stage(docs: DataFrame) -> DataFrame:
    """The rows of documents as the mix takes them, a document once per pass, in training order.

    Rows are known by the hash of id and text; where rows share both, the passes are dealt out among
    them in turn.
    """
    key, turn, copies, position, positions = fresh(docs, "_key", "_turn", "_copies", "_position", "_positions")
    due = curriculum(docs).select(F.col("order_key").alias(key), F.explode("positions").alias(position))
    due = due.groupBy(key).agg(F.sort_array(F.collect_list(position)).alias(positions))
    keyed = docs.withColumn(key, hashed_order())
    once = {turn: F.lit(0), copies: F.lit(1)}
    rows = keyed.withColumns(once)
    repeated = pin(keyed.groupBy(key).count().where("count > 1").select(key))
    if not repeated.isEmpty():
        alike = Window.partitionBy(key)
        # The same order whenever a task runs again; rows that are equal in all columns may change places.
        fields = [F.col(f"`{name}`") for name, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
        dealt = {turn: F.row_number().over(alike.orderBy(F.xxhash64(*fields))) - 1, copies: F.count("*").over(alike).cast("int")}
        shared = join_measured(keyed, repeated, [key], "left_semi").withColumns(dealt)
        rows = join_measured(keyed, repeated, [key], "left_anti").withColumns(once).unionByName(shared)
    own = F.filter(positions, lambda p, i: i % F.col(copies) == F.col(turn))
    taken = rows.join(due, key).withColumn(position, F.explode(own))
    ordered = taken.repartitionByRange(position, key).sortWithinPartitions(position, key)
    return ordered.select(*docs.columns)


def oracle() -> str:
    """The report in DuckDB's SQL, for the default weights and schedules."""
    segments = [_segments(s)[0] for s in SCHEDULES]

    def by_class(values: list[str]) -> str:
        return "CASE class " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"

    w0 = by_class([f"{s[3]!r}::DOUBLE" for s in segments])
    slope = by_class([f"{s[4]!r}::DOUBLE" for s in segments])
    demand = " + ".join(
        f"total{i} * (t * {s[3]!r}::DOUBLE + t * t * {s[4] / 2!r}::DOUBLE)" for i, s in enumerate(segments)
    )
    return f"""
    WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
               md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS o FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
    r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS class FROM s),
    c AS (SELECT *, class + 1 AS weight, 3 * source_size AS cap FROM r),
    l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE
                 / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
          FROM c WINDOW f AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, source_size, class, least(cap::DOUBLE, weight * max(level) OVER ()) AS target FROM l),
    n AS (SELECT *, sum(CASE WHEN class = 0 THEN target ELSE 0 END) OVER () AS total0,
                 sum(CASE WHEN class = 1 THEN target ELSE 0 END) OVER () AS total1,
                 sum(CASE WHEN class = 2 THEN target ELSE 0 END) OVER () AS total2 FROM t),
    p AS (SELECT doc_id, size, source_size, target, class, total0, total1, total2,
            coalesce(sum(size) OVER (PARTITION BY z.source ORDER BY o, doc_id, size
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
          FROM z JOIN n ON z.source IS NOT DISTINCT FROM n.source),
    k AS (SELECT *, (CASE WHEN size > 0 AND 2 * start + size <= 2 * target THEN 1 ELSE 0 END
                   + CASE WHEN size > 0 AND 2 * (start + source_size) + size <= 2 * target THEN 1 ELSE 0 END
                   + CASE WHEN size > 0 AND 2 * (start + 2 * source_size) + size <= 2 * target THEN 1 ELSE 0 END) AS passes,
                 start::DOUBLE / nullif(target, 0) AS y, {w0} AS w0, {slope} AS slope FROM p),
    q AS (SELECT *, 2 * y / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y, 0.0))) AS t FROM k)
    SELECT doc_id, size, source_size, target, (passes * size)::BIGINT AS taken,
           CASE WHEN passes > 0 THEN floor({demand})::BIGINT END AS first_position FROM q""".replace("\\\\", "\\")
