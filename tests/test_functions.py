"""Column functions against plain Python."""

import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from helixframe.functions import alleles, bits, coords, noise, numbers, sql, text


def one(spark, ddl, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def trimmed(ref, allele):
    while len(ref) > 1 and len(allele) > 1 and ref[-1] == allele[-1]:
        ref, allele = ref[:-1], allele[:-1]
    return ref, allele


BASES = st.text(alphabet="AC", min_size=1, max_size=6)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(BASES, BASES, st.text(alphabet="ACGT", max_size=40)), min_size=200, max_size=300))
def test_minimize_equals_the_loop(spark, drawn):
    pairs = [(r + tail, a + tail) for r, a, tail in drawn]
    sql.register(spark)
    pair = alleles.minimize(F.col("r"), F.col("a"))
    got = one(spark, "r string, a string", pairs, pair["ref"], pair["allele"], F.expr("minimize(r, a)"))
    assert got == [(*trimmed(r, a), ",".join(trimmed(r, a))) for r, a in pairs]


def test_minimize_long_alleles(spark):
    pairs = [("G" + "AC" * 5000, "T" + "AC" * 5000), ("A" * 8000, "A" * 5000), ("AC" * 4000, "CC" * 3000)]
    pair = alleles.minimize(F.col("r"), F.col("a"))
    got = one(spark, "r string, a string", pairs, pair["ref"], pair["allele"])
    assert got == [trimmed(r, a) for r, a in pairs]


def test_minimize_null_and_empty(spark):
    pairs = [(None, "A"), ("A", None), (None, None), ("", "AA"), ("AA", "")]
    pair = alleles.minimize(F.col("r"), F.col("a"))
    got = one(spark, "r string, a string", pairs, pair["ref"], pair["allele"])
    assert got == [(None, None)] * 3 + [("", "AA"), ("AA", "")]


def test_list_items(spark):
    row = [("1|22|333", "a,b")]
    got = one(
        spark, "p string, c string", row,
        alleles.pipe_item(F.col("p"), 1), alleles.pipe_item(F.col("p"), 3), alleles.pipe_item(F.col("p"), 4),
        alleles.comma_item(F.col("c"), 2), alleles.comma_item(F.col("c"), 3),
    )
    assert got == [("1", "333", None, "b", None)]


def test_encode_location(spark):
    contigs = ["chr1", "chrX", "chrY", "chrM", "chr1_random", "7", "chrx", None]
    got = one(
        spark, "c string", [(c,) for c in contigs],
        coords.encode_location(F.col("c"), F.lit(5)), coords.encode_location(F.col("c"), F.lit(5), mito=True),
    )
    unit = 10**12
    assert got == [
        (unit + 5, unit + 5), (23 * unit + 5, 23 * unit + 5), (24 * unit + 5, 24 * unit + 5),
        (None, 25 * unit + 5), (None, None), (None, None), (None, 23 * unit + 5), (None, None),
    ]


def test_decode_undoes_encode(spark):
    contigs = [f"chr{n}" for n in (*range(1, 23), "X", "Y", "M")]
    rows = [(c, 248_956_422 - i) for i, c in enumerate(contigs)]
    spot = coords.decode_location(coords.encode_location(F.col("c"), F.col("p"), mito=True))
    assert one(spark, "c string, p bigint", rows, spot["contig"], spot["pos"]) == rows


def test_sql_location_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT encode_location('chrX', 7) AS e, decode_location(25000000000009) AS d").first()
    assert row.e == 23 * 10**12 + 7 and tuple(row.d) == ("chrM", 9)


def test_text_to_numbers(spark):
    texts = ["57", "57.9", "-3.", " 5 ", "x", "", None, "99999999999999999999", "1e3", "3600.00"]
    got = one(
        spark, "t string", [(t,) for t in texts],
        numbers.lenient_long(F.col("t")), numbers.parse_long(F.col("t")), numbers.parse_double(F.col("t")),
    )
    assert got == [
        (57, 57, 57.0), (57, None, 57.9), (-3, None, -3.0), (5, 5, 5.0), (None, None, 5.0), (None, None, 5.0),
        (None, None, 5.0), (None, None, 1e20), (None, None, 1000.0), (3600, None, 3600.0),
    ]


def test_half_even_and_clamp(spark):
    rows = [(0.5,), (1.5,), (2.5,), (-0.5,), (2.4,)]
    got = one(spark, "x double", rows, numbers.half_even(F.col("x")), numbers.clamp(F.col("x").cast("bigint"), 1, 2))
    assert got == [(0, 1), (2, 1), (2, 2), (0, 1), (2, 2)]


def test_bitmaps(spark):
    offsets = [0, 1, 49, 50, 73, 99]
    low = sum(1 << o for o in offsets if o < 50)
    high = sum(1 << (o - 50) for o in offsets if o >= 50)
    got = one(
        spark, "l bigint, h bigint", [(low, high), (0, 0)],
        bits.set_offsets(F.col("l"), F.col("h")), bits.bit_text(F.col("l"), F.col("h")),
    )
    assert got[0] == (offsets, f"{high:050b}{low:050b}") and got[1][0] == []


def test_pathogenic_text(spark):
    labels = [["Pathogenic"], ["Pathogenic", "benign"], ["Likely_pathogenic", "Benign"], None, [], ["other", None]]
    got = one(spark, "c array<string>", [(c,) for c in labels], text.is_pathogenic(F.col("c")))
    assert [g[0] for g in got] == [True, False, True, False, False, False]


def test_noise_does_not_depend_on_partitions(spark):
    rule = noise.hash_noise(7)
    rows = spark.range(20_000).select((F.col("id") % 9).alias("sample_id"), F.col("id").alias("draw_no"))
    made = [
        {r.draw_no: (r.u, r.z) for r in rows.repartition(n).select("draw_no", rule("u").alias("u"), noise.normal(rule, "z").alias("z")).collect()}
        for n in (1, 13)
    ]
    assert made[0] == made[1]
    uniform = [u for u, _ in made[0].values()]
    normal = [z for _, z in made[0].values()]
    assert 0 <= min(uniform) and max(uniform) < 1 and abs(sum(uniform) / 20_000 - 0.5) < 0.02
    spread = math.sqrt(sum(z * z for z in normal) / 20_000)
    assert abs(sum(normal) / 20_000) < 0.05 and abs(spread - 1) < 0.05


def test_sql_functions_on_long_and_odd_input(spark):
    sql.register(spark)
    tail = "ACGT" * 4000
    rows = spark.createDataFrame([("G" + tail, "T" + tail), (tail, tail), ("A", "CA"), ("CTT", "CT"), (None, "A")], "r string, a string")
    pairs = [r.p for r in rows.selectExpr("minimize(r, a) AS p").collect()]
    assert pairs == ["G,T", "A,A", "A,CA", "CT,C", None]
    odd = spark.sql("SELECT encode_location('chr99999999999', 1) AS big, encode_location('chr2_alt', 1) AS alt").first()
    assert (odd.big, odd.alt) == (None, None)
