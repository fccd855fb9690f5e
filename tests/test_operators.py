"""Operators on small tables, the reference behaviour written out by hand."""

from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import accumulate
import random

import pytest
from pyspark.sql import functions as F

from helixframe.constants import SINGLE_ALT_GENOTYPES, TWO_ALT_GENOTYPES
from helixframe.operators import annotate, cohort, expand, joins, model, weights
from helixframe.schemas import ALT_ALLELE, CONDENSED, RAW_VARIANTS, SAMPLE_INFO, VAT

SF = "/root/testdata/sf0.001"


def raw(spark, *rows):
    return spark.createDataFrame(rows, RAW_VARIANTS)


def call(gt, alt="CT,C", mq="0|3600|2400", qual="57|31", ad="10,12,3"):
    return (10**12 + 5, 7, "CTT", alt, gt, 40, mq, "|0.4|0.1", qual, None, "1,2|3,4", ad)


@pytest.mark.parametrize("gt", SINGLE_ALT_GENOTYPES)
def test_single_codes_give_allele_one(spark, gt):
    rows = expand.expand_alt_alleles(raw(spark, call(gt))).collect()
    assert [(r.allele_pos, r.ref, r.allele, r.raw_mq, r.qual, r.ref_ad, r.ad) for r in rows] == [
        (1, "CT", "C", 3600, 57, 10, 12)
    ]


@pytest.mark.parametrize("gt", TWO_ALT_GENOTYPES)
def test_double_codes_give_both_alleles(spark, gt):
    rows = expand.expand_alt_alleles(raw(spark, call(gt))).orderBy("allele_pos").collect()
    assert [(r.allele_pos, r.ref, r.allele, r.raw_mq, r.qual, r.ref_ad, r.ad) for r in rows] == [
        (1, "CT", "C", 3600, 57, 10, 12), (2, "CTT", "C", 2400, 31, 10, 3)
    ]


def test_other_codes_vanish(spark):
    calls = [call(gt) for gt in ("0/0", "./.", "2/2", "1/3", "0", None)]
    assert expand.expand_alt_alleles(raw(spark, *calls)).count() == 0


def test_short_lists_and_bad_numbers_give_null(spark):
    calls = raw(spark, call("1/2", alt="C", mq="0|n/a", qual="x", ad="10"), call("0/1", mq="0|3600.00", qual="57.9"))
    rows = expand.expand_alt_alleles(calls).orderBy("call_GT", "allele_pos").collect()
    assert [(r.allele, r.raw_mq, r.qual, r.ref_ad, r.ad) for r in rows] == [
        ("C", None, 57, 10, 12), ("C", None, None, 10, None), (None, None, None, 10, None)
    ]


def test_expand_schema_and_union_of_batches(spark):
    from helixframe.plans import fixtures as fx

    calls = fx.raw_variants(spark, SF)
    whole = expand.expand_alt_alleles(calls)
    united = expand.all_calls([expand.expand_alt_alleles(calls.where(F.col("call_GQ") % 3 == i)) for i in range(3)])
    assert [(f.name, f.dataType) for f in whole.schema] == [(f.name, f.dataType) for f in ALT_ALLELE]
    assert whole.exceptAll(united).isEmpty() and united.exceptAll(whole).isEmpty()


def test_cast_long_reads_text_and_leaves_numbers(spark):
    rows = spark.createDataFrame([("57.9", 8), (" 12 ", None), ("n/a", 9), (None, 1)], "qual string, ad int")
    made = expand.cast_long(rows, ("qual", "ad"))
    assert made.dtypes == [("qual", "bigint"), ("ad", "bigint")]
    assert [tuple(r) for r in made.collect()] == [(57, 8), (12, None), (None, 9), (None, 1)]


def aa(spark, rows):
    return spark.createDataFrame(rows, "location bigint, ref string, allele string, sample_id bigint")


def lists(df):
    return {tuple(r)[:3]: sorted(r.sample_ids) for r in df.collect()}


def skewed_calls():
    random.seed(5)
    hot = [(500, "A", "G", random.randint(1, 300)) for _ in range(4000)]
    rest = [(random.randint(1, 400), "A", random.choice("CGT"), random.randint(1, 300)) for _ in range(6000)]
    return hot + rest + [(7, "A", "C", None)]


def test_condense_keeps_repeats_and_skips_null_ids(spark):
    rows = skewed_calls()
    expected = defaultdict(list)
    for *key, sample in rows:
        expected[tuple(key)] += [] if sample is None else [sample]
    expected = {k: sorted(v) for k, v in expected.items()}
    assert lists(cohort.condense(aa(spark, rows))) == expected
    assert lists(cohort.condense(aa(spark, rows), one_call_per_sample=True)) == expected


def test_blocks_hold_the_same_calls_within_their_width(spark):
    rows = skewed_calls()
    blocks = cohort.condense_blocks(aa(spark, rows), width=50).collect()
    assert max(len(b.carriers) for b in blocks) <= 50
    found = Counter()
    for b in blocks:
        for sample, calls in b.carriers:
            assert sample // 50 == b.sample_block
            found[(b.location, b.ref, b.allele, sample)] += calls
    assert found == Counter(r for r in rows if r[3] is not None)


@pytest.mark.parametrize("bound", [joins.MAX_BROADCAST_BYTES, 0])
def test_merging_halves_gives_the_whole_as_sets(spark, bound):
    rows = [r for r in skewed_calls() if r[3] is not None]
    whole = {k: sorted(set(v)) for k, v in lists(cohort.condense(aa(spark, rows))).items()}
    master, new = cohort.holdout(aa(spark, rows), 20)
    for merged in (
        cohort.merge_condensed(cohort.condense(master), cohort.condense(new)),
        cohort.merge_small_batch(cohort.condense(master), cohort.condense(new), max_bytes=bound),
    ):
        assert {k: sorted(set(v)) for k, v in lists(merged).items()} == whole
    assert cohort.with_sample(merged, 3).count() == sum(3 in v for v in whole.values())


@pytest.mark.parametrize("width", [1, 2, 10, 10**6])
def test_merging_blocks_keeps_every_call(spark, width):
    rows = [r for r in skewed_calls() if r[3] is not None] + [(9, "A", None, 4), (9, "A", None, 4), (9, "A", None, 250)]
    master, new = cohort.holdout(aa(spark, rows), 20)
    # Some samples have calls on both sides.
    both = new.unionByName(master.where("sample_id % 5 = 0"))
    merged = cohort.merge_blocks(*(cohort.condense_blocks(half, width=width) for half in (master, both)))
    found = Counter()
    for b in merged.collect():
        for sample, calls in b.carriers:
            assert sample // width == b.sample_block and (b.location, b.ref, b.allele, sample) not in found
            found[(b.location, b.ref, b.allele, sample)] = calls
    lowest = sorted({r[3] for r in rows})[:20]
    expected = Counter(rows)
    expected.update(r for r in rows if r[3] % 5 == 0 and r[3] not in lowest)
    assert found == expected


def test_merges_match_missing_alleles(spark):
    master = spark.createDataFrame([(1, "A", None, [1]), (2, None, None, [5])], CONDENSED)
    new = spark.createDataFrame([(1, "A", None, [2]), (2, None, None, [5]), (3, "A", None, [9])], CONDENSED)
    expected = {(1, "A", None): [1, 2], (2, None, None): [5], (3, "A", None): [9]}
    assert lists(cohort.merge_condensed(master, new)) == expected
    assert lists(cohort.merge_small_batch(master, new)) == expected


def test_merge_unites_lists_of_known_variants_only(spark):
    master = spark.createDataFrame([(1, "A", "C", [1, 1, 2]), (2, "A", "C", [5, 5])], CONDENSED)
    new = spark.createDataFrame([(1, "A", "C", [2, 3, 3]), (3, "A", "C", [9, 9])], CONDENSED)
    expected = {(1, "A", "C"): [1, 2, 3], (2, "A", "C"): [5, 5], (3, "A", "C"): [9, 9]}
    assert lists(cohort.merge_condensed(master, new)) == expected
    assert lists(cohort.merge_small_batch(master, new)) == expected


def test_range_is_open(spark):
    rows = aa(spark, [(n, "A", "C", 1) for n in (10, 11, 19, 20)])
    assert cohort.count_in_range(rows, 10, 20).first().n == 2


def test_holdout_takes_the_lowest_ids(spark):
    master, new = cohort.holdout(aa(spark, [(1, "A", "C", s) for s in (9, 4, 4, 6)]), 2)
    assert sorted(r.sample_id for r in new.collect()) == [4, 4, 6]
    assert [r.sample_id for r in master.collect()] == [9]


def annotation(spark):
    row = ("v", "chrX", 10, "A", "G", True, "GCK", ["Pathogenic"], ["stop_gained"], 1)
    other = ("w", "chrM", 10, "A", "G", True, "GCK", ["Pathogenic"], ["stop_gained"], 1)
    return spark.createDataFrame([row, row, other, (*row[:5], None, *row[6:])], VAT)


def calls_at_x(spark):
    base = dict(location=23 * 10**12 + 10, ref="A", allele="G")
    quality = [(1, 20, 10, 11), (2, 19, 10, 11), (3, 20, 10, 10), (4, 20, None, 50), (5, 99, 90, 90)]
    rows = [(base["location"], s, "A", "G", 1, "0/1", gq, None, None, None, 1, None, None, "", r, a) for s, gq, r, a in quality]
    return spark.createDataFrame(rows, ALT_ALLELE)


@pytest.mark.parametrize("bound", [joins.MAX_BROADCAST_BYTES, 0])
def test_carriers(spark, bound):
    variants = annotate.distinct_variants(annotate.canonical(annotation(spark)))
    assert variants.count() == 2
    info = spark.createDataFrame(
        [(1, "one", None, False), (5, "five", None, None), (2, "two", "2024", False)], SAMPLE_INFO
    )
    found = annotate.carriers(variants, annotate.good_calls(calls_at_x(spark)), max_bytes=bound)
    assert sorted(r.sample_id for r in found.collect()) == [1, 5]
    named = annotate.carriers(
        variants, annotate.good_calls(calls_at_x(spark)), annotate.active_samples(info), bound
    )
    assert [r.sample_name for r in named.collect()] == ["one"]


def test_small_side_is_broadcast_only_below_the_bound(spark, capsys):
    large = spark.range(1000).withColumnRenamed("id", "k").repartition(4)
    small = spark.range(10).select(F.col("id").alias("k"), F.lit("x").alias("t"))
    for bound, expected in ((joins.MAX_BROADCAST_BYTES, True), (0, False)):
        joined = joins.join_measured(large, small, ["k"], max_bytes=bound)
        assert joined.count() == 10
        capsys.readouterr()
        joined.explain("extended")
        assert ("strategy=broadcast" in capsys.readouterr().out) == expected


def test_running_weight_over_blocks_and_contigs(spark):
    random.seed(2)
    spots = sorted({c * 10**12 + random.randrange(0, 5_000_000, 100) for c in (1, 2, 23) for _ in range(300)})
    bins = [(s, random.choice([0, 1, 7, 5000])) for s in spots]
    got = weights.cumulative_weight(spark.createDataFrame(bins, "location bigint, weight bigint").repartition(7))
    kept = [b for b in bins if b[1]]
    expected = list(zip([k[0] for k in kept], accumulate(k[1] for k in kept)))
    assert sorted((r.location, r.cw) for r in got.collect()) == expected


@pytest.mark.parametrize("send", [True, False])
def test_nearest_bucket_equals_bisection(spark, send):
    random.seed(4)
    sizes = [random.choice([1, 2, 3, 40]) for _ in range(500)] + [9000] + [1] * 300
    bins = [(10**12 + 100 * i, w) for i, w in enumerate(sizes)]
    table = spark.createDataFrame(bins, "location bigint, weight bigint")
    ends, total = list(accumulate(sizes)), sum(sizes)
    draws = spark.range(1, total + 3).select(F.col("id").alias("u"))
    got = weights.nearest_bucket(
        draws, weights.cumulative_weight(table), weights.cell_width(table), broadcast_bins=send
    )
    expected = [(u, bins[bisect_left(ends, u)][0]) for u in range(1, total + 1)]
    assert sorted((r.u, r.bucket) for r in got.collect()) == expected


def test_model_of_one_pass_equals_separate_tables(spark):
    from helixframe.plans import fixtures as fx

    calls = fx.alt_allele(spark, SF)
    bins = model.model_bins(calls)
    for joint, single in (
        (model.bin_weights(bins), model.model_weights(calls)),
        (model.bin_bitmaps(bins), model.model_bitmaps(calls)),
        (model.bin_spikes(bins), model.model_spikes(calls)),
    ):
        assert sorted(map(tuple, joint.collect())) == sorted(map(tuple, single.collect()))


def test_neighbouring_slices_hold_every_bin_a_draw_can_meet(spark):
    random.seed(6)
    bins = [(10**12 + 100 * i, random.choice([1, 5, 300])) for i in range(60)]
    cdf = weights.cumulative_weight(spark.createDataFrame(bins, "location bigint, weight bigint"))
    total = sum(w for _, w in bins)
    rows = {r.location: (r.cw - r.weight, r.cw) for r in cdf.collect()}
    for start, end in ((0.0, 0.2), (0.2, 0.55), (0.55, 1.0)):
        kept = {r.location for r in weights.overlapping_slice(cdf, start, end, total).collect()}
        draws = range(int(start * total) + 1, int(end * total - 1e-9) + 2)
        needed = {k for k, (low, high) in rows.items() if any(low < u <= high for u in draws)}
        assert needed <= kept and len(kept) <= len(needed) + 1
