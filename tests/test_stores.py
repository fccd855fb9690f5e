"""Bitmaps, postings, bucketed tables, Z-order layout and the model's states, against plain Python and by their plans."""

import random
import re
from collections import Counter, defaultdict
from statistics import mean, stdev

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from helixframe.constants import VARIANT_KEYS
from helixframe.functions import sql
from helixframe.functions.noise import hash_noise
from helixframe.operators import alias, annotate, bitmaps, joins, model, model_state, packed, postings, terms
from helixframe.plans import fixtures as fx
from helixframe.schemas import ALT_ALLELE
from helixframe.sources import buckets, quarantine, tables, zorder
from helixframe.streaming import ingest

SF = "/root/testdata/sf0.001"
CALLS = "location bigint, ref string, allele string, sample_id bigint"


def calls_of(spark, rows):
    return spark.createDataFrame(rows, CALLS)


def carriers(rows):
    found = defaultdict(set)
    for *variant, sample in rows:
        if sample is not None:
            found[tuple(variant)].add(sample)
    return dict(found)


def decoded(blocks, width):
    rows = bitmaps.carrier_lists(blocks, width).collect()
    assert all(len(set(r.sample_ids)) == len(r.sample_ids) for r in rows)
    return {tuple(r)[:3]: set(r.sample_ids) for r in rows}


def random_calls(seed, n=800):
    rng = random.Random(seed)
    variants = [(rng.choice([5, 7, 10**12, None]), rng.choice(["A", "AC"]), rng.choice(["C", "T", None])) for _ in range(12)]
    return [(*rng.choice(variants), rng.choice([rng.randrange(300), 63, 64, 127, 128, 4095, 10**9 + 1, -1, -64, None])) for _ in range(n)]


# Carrier bitmaps


@pytest.mark.parametrize("width", [64, 128, bitmaps.BLOCK_SAMPLES])
def test_bitmaps_hold_the_carriers(spark, width):
    rows = random_calls(width)
    blocks = bitmaps.condense_bitmap(calls_of(spark, rows), width)
    assert decoded(blocks, width) == carriers(rows)
    assert {tuple(r)[:3]: r.carriers for r in bitmaps.carrier_total(blocks).collect()} == {k: len(v) for k, v in carriers(rows).items()}
    for sample in (63, 64, -1, -64, 10**9 + 1, 4095, 299, 12345):
        held = {tuple(r) for r in bitmaps.bitmap_with_sample(blocks, sample, width).collect()}
        assert held == {k for k, v in carriers(rows).items() if sample in v}


@pytest.mark.parametrize("max_bytes", [0, 10**9])
def test_bitmaps_merge_by_or(spark, max_bytes):
    first, second = random_calls(1, 300), random_calls(2, 300)
    sides = [bitmaps.condense_bitmap(calls_of(spark, rows), 64) for rows in (first, second)]
    expected = carriers(first + second)
    assert decoded(bitmaps.merge_bitmap(*sides), 64) == expected
    merged = bitmaps.merge_bitmap_batch(*sides, max_bytes=max_bytes)
    assert decoded(merged, 64) == expected and merged.dtypes == sides[0].dtypes
    assert merged.groupBy(*bitmaps.BLOCK_KEYS).count().where("count > 1").isEmpty()
    assert decoded(bitmaps.merge_bitmap(merged, sides[0]), 64) == expected


def test_a_hot_variant_stays_in_bounded_rows(spark):
    """Half a million carriers: a block's row is bounded, and nothing but words of 64 ids is gathered."""
    ids = spark.range(500_000).select(F.lit(5).cast("long").alias("location"), F.lit("A").alias("ref"), F.lit("C").alias("allele"), F.col("id").alias("sample_id"))
    blocks = bitmaps.condense_bitmap(ids)
    sizes = blocks.select(F.size("words").alias("n")).collect()
    assert len(sizes) == 16 and max(r.n for r in sizes) == 512
    assert bitmaps.carrier_total(blocks).first().carriers == 500_000
    assert joins.measured_bytes(blocks) < 500_000


def test_block_width_is_a_power_of_two(spark):
    with pytest.raises(ValueError):
        bitmaps.condense_bitmap(calls_of(spark, []), 100)


# Postings


def test_postings(spark, scratch):
    rows = [r for r in random_calls(3)]
    index = postings.postings(calls_of(spark, rows), window=4)
    asked = {(s, k[0], k[1], k[2]) for k, v in carriers(rows).items() for s in v if k[0] is not None}
    assert sum(r.n for r in index.collect()) == len(asked)
    assert all(r.n == len(r.offsets) and r.offsets == sorted(r.offsets) and max(r.offsets) < 4 for r in index.collect())
    for sample in (63, 64, -1, 10**9 + 1, 77):
        found = {tuple(r) for r in postings.variants_of(index, sample, 4).collect()}
        assert found == {k[1:] for k in asked if k[0] == sample}
        near = {tuple(r) for r in postings.variants_in_range(index, sample, 4, 8, 4).collect()}
        assert near == {k for k in found if 4 < k[0] < 8}
    both = {tuple(r) for r in postings.shared_variants(index, 63, 64, 4).collect()}
    assert both == {k[1:] for k in asked if k[0] == 63} & {k[1:] for k in asked if k[0] == 64}


def test_a_samples_postings_are_read_alone(spark, scratch, capsys):
    """The plan reads the index only, filtered in the scan, and its files part the samples."""
    calls = fx.alt_allele(spark, SF)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    postings.write_postings(calls, scratch)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    postings.write_postings(calls.where("sample_id = 7"), scratch, mode="append")
    index = postings.read_postings(spark, scratch)
    found = postings.variants_of(index, 7)
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(sample_id,7)" in plan and len(set(re.findall(r"\(\d+\) Scan parquet", plan))) == 1 and scratch.split("/")[-1] in plan
    assert found.count() == calls.where("sample_id = 7").select(*VARIANT_KEYS).distinct().count() > 0
    boxes = zorder.box_of_files(spark, scratch, ["sample_id"]).collect()
    assert sum(r.min_sample_id <= 41 <= r.max_sample_id for r in boxes) < len(boxes) / 2


# Bucketed tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_shuffles_nothing_below(spark):
    vat = buckets.write_bucketed(annotate.located(fx.vat(spark, SF)), f"vat_{id(spark)}_a", VARIANT_KEYS, 8)
    calls = buckets.write_bucketed(fx.alt_allele(spark, SF), f"calls_{id(spark)}_a", VARIANT_KEYS, 8)
    assert vat.name in [t.name for t in spark.catalog.listTables()]
    variants = annotate.pathogenic(annotate.canonical(spark.table(vat.name))).select(*VARIANT_KEYS).distinct()
    joined = buckets.bucketed_join(spark, variants, calls, vat)
    even = plan_of(spark.table(calls.name).join(variants.hint("merge"), list(VARIANT_KEYS)))
    assert "SortMergeJoin" in even and "Exchange" not in even and "SelectedBucketsCount: 8 out of 8" in even
    expected = fx.alt_allele(spark, SF).join(annotate.located(annotate.pathogenic(annotate.canonical(fx.vat(spark, SF)))).select(*VARIANT_KEYS).distinct(), list(VARIANT_KEYS))
    ours, theirs = joined.select(*ALT_ALLELE.names), expected.select(*ALT_ALLELE.names)
    assert ours.exceptAll(theirs).isEmpty() and theirs.exceptAll(ours).isEmpty() and ours.count() > 0
    other = buckets.BucketedTable(vat.name, vat.hot_name, vat.keys, 4)
    with pytest.raises(ValueError):
        buckets.bucketed_join(spark, variants, calls, other)


def test_hot_keys_have_a_table_of_their_own(spark):
    rows = [(5, "A", "C", i) for i in range(3000)] + [(5, "A", None, i) for i in range(3000)]
    rows += [(i, "A", "C", 1) for i in range(6, 5000)]
    stored = buckets.write_bucketed(calls_of(spark, rows), f"hot_{id(spark)}", VARIANT_KEYS, 32)
    assert spark.table(stored.hot_name).count() == 6000 and stored.has_hot(spark)
    assert Counter(tuple(r) for r in stored.rows(spark).collect()) == Counter(rows)
    asked = calls_of(spark, [(5, "A", "C", 0), (9, "A", "C", 0), (10**6, "A", "C", 0)]).drop("sample_id")
    found = buckets.bucketed_join(spark, asked, stored)
    assert found.count() == 3001 and set(found.columns) == {*VARIANT_KEYS, "sample_id"}
    per_file = spark.table(stored.name).groupBy(F.input_file_name()).count().collect()
    assert len(per_file) == 32 and max(r["count"] for r in per_file) < 400


# Z-order


def test_ranks_and_keys(spark):
    values = [None, -5, 0, 3, 3, 3, 9, 100]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    bounds = [0, 3, 50]
    ranks = [r.r for r in df.select(zorder.rank_of(F.col("v"), bounds).alias("r")).collect()]
    assert ranks == [0, 0, 1, 2, 2, 2, 2, 3]
    pairs = [(x, y) for x in range(8) for y in range(8)]
    keyed = spark.createDataFrame(pairs, "x int, y int").select("x", "y", zorder.z_key([F.col("x"), F.col("y")], 3).alias("z")).collect()
    by_hand = lambda x, y: sum(((x >> b & 1) << 2 * b + 1) | ((y >> b & 1) << 2 * b) for b in range(3))
    assert all(r.z == by_hand(r.x, r.y) for r in keyed)
    with pytest.raises(ValueError):
        zorder.z_key([F.lit(1)] * 8, 8)


def test_both_filters_skip_files(spark, scratch):
    """A range and a sample each meet under a third of the files, where a plain clustering reads all for a sample."""
    calls = fx.alt_allele(spark, "/root/testdata/sf0.01").select(*ALT_ALLELE.names)
    spread = calls.withColumn("sample_id", F.pmod(F.xxhash64("location", "call_AD", "call_GQ", "as_raw_mq"), F.lit(5000)))
    spread.write.parquet(f"{scratch}/plain")
    laid = zorder.compact_z_ordered(spark, f"{scratch}/plain", f"{scratch}/z", ("location", "sample_id"), files=64)
    assert laid.count() == calls.count()
    boxes = zorder.box_of_files(spark, f"{scratch}/z", ["location", "sample_id"]).collect()
    assert len(boxes) >= 48
    middle = sorted(r.min_location for r in boxes)[len(boxes) // 2]
    in_range = sum(r.min_location < middle + 500 and r.max_location > middle for r in boxes)
    of_sample = sum(r.min_sample_id <= 1234 <= r.max_sample_id for r in boxes)
    assert in_range < len(boxes) / 3 and of_sample < len(boxes) / 3
    tables.write_clustered(spark.read.parquet(f"{scratch}/plain"), f"{scratch}/one", files=64)
    one = zorder.box_of_files(spark, f"{scratch}/one", ["sample_id"]).collect()
    assert sum(r.min_sample_id <= 1234 <= r.max_sample_id for r in one) > len(one) * 0.9


def test_z_order_spreads_copies_and_nulls(spark, scratch):
    rows = [(None, "A", "C", None)] * 500 + [(5, "A", "C", 1)] * 2000 + [(i, "A", "C", i % 50) for i in range(1000)]
    zorder.write_z_ordered(calls_of(spark, rows).repartition(8), scratch, ("location", "sample_id", "allele"), files=16, bits=4)
    assert Counter(tuple(r) for r in spark.read.parquet(scratch).collect()) == Counter(rows)
    assert max(r.n for r in zorder.box_of_files(spark, scratch, ["location"]).collect()) < 1000
    assert zorder.range_bounds(calls_of(spark, []), ["location"]) == {"location": []}
    empty = scratch + "-none"
    zorder.write_z_ordered(calls_of(spark, []), empty, ("location",), files=4)
    assert spark.read.schema(CALLS).parquet(empty).count() == 0


# Model states


def test_states_of_batches_are_the_state_of_all(spark, scratch):
    rng = random.Random(6)
    blank = {f.name: None for f in ALT_ALLELE.fields}
    rows = []
    for i in range(600):
        value = lambda: rng.choice([None, rng.randrange(100), 10**9 + rng.randrange(3)])
        rows.append(blank | {"location": rng.choice([rng.randrange(300), 10_000 + rng.randrange(50), 20_005]), "allele": rng.choice("ACG"),
                             "sample_id": i % 40, "qual": value(), "ref_ad": value(), "ad": None, "call_GQ": value()})
    schema = StructType([StructField(f.name, f.dataType) for f in ALT_ALLELE.fields])
    calls = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    for version, part in enumerate((F.col("sample_id") < 10, F.col("sample_id").between(10, 11), F.col("sample_id") > 11)):
        model_state.update_state(calls.where(part), scratch, version)
        model_state.update_state(calls.where(part), scratch, version)  # run again
    state = model_state.read_state(spark, scratch, 2)
    rebuilt = model_state.state_of(calls)
    assert sorted(state.alleles.collect()) == sorted(rebuilt.alleles.collect())
    as_set = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert as_set(model_state.state_bins(state)) == as_set(model.model_bins(calls))
    by_bin = defaultdict(list)
    for r in rows:
        by_bin[r["location"] // 10_000 * 10_000].append(r)
    for r in model_state.state_stats(state).collect():
        own = by_bin.pop(r.location_bin)
        assert r.entries == len(own)
        for name, column in model.METRICS.items():
            values = [x[column] for x in own if x[column] is not None]
            assert r[f"avg_{name}"] == (pytest.approx(mean(values), rel=1e-12) if values else None)
            assert r[f"stddev_{name}"] == (pytest.approx(stdev(values), rel=1e-9) if len(values) > 1 else None)
    assert not by_bin
    nothing = model_state.state_of(calls.limit(0))
    assert model_state.merge_states(nothing, rebuilt).metrics.count() == rebuilt.metrics.count()


# Measured broadcasts


def test_measured_bytes_of_every_type(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    ways = {
        "binary": F.col("t").cast("binary"),
        "struct": F.struct(F.struct("t")),
        "map": F.create_map(F.lit("k"), "t"),
        "array": F.array(F.struct("t")),
        "map of arrays": F.create_map("t", F.array(F.lit(1))),
    }
    for name, column in ways.items():
        n = joins.measured_bytes(wide.select(column.alias("v")))
        assert 1_000_000 <= n < 1_100_000, name
    assert joins.measured_bytes(wide.select(F.lit(None).cast("binary").alias("v"), F.lit(None).cast("array<string>").alias("a"))) < 10_000
    assert joins.measured_bytes(wide.select(F.parse_json(F.lit("[1]")).alias("v"))) == float("inf")
    assert joins.measured_bytes(wide.limit(0)) == 0


def test_a_wide_binary_side_is_not_broadcast(spark):
    large = spark.range(1000).withColumn("k", F.col("id") % 10)
    small = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).cast("binary").alias("b"))
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for bound, node in ((5_000, "SortMergeJoin"), (50_000, "BroadcastHashJoin")):
            joined = joins.join_measured(large, small, ["k"], max_bytes=bound)
            assert node in plan_of(joined) and joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)


# Term masks


def test_masks(spark):
    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(130)] + ["Pathogenic", "Likely_pathogenic", "benign", "Likely_benign", "Benign"]
    lists = [None, []] + [rng.sample(vocabulary, rng.randint(1, 6)) + rng.choice([[], [None]]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, c array<string>")
    dictionary = terms.term_dictionary(df, "c")
    assert dictionary == sorted({t for x in lists for t in x or [] if t})
    masked = terms.with_masks(df, "c", dictionary, "m").drop("c")
    assert terms.mask_names("m", dictionary) == ["m_0", "m_1", "m_2"] == masked.columns[1:]
    for asked in (["t1"], ["t5", "t129", "no such"], [], vocabulary):
        found = {r.id for r in masked.where(terms.has_any("m", dictionary, asked)).collect()}
        assert found == {i for i, x in enumerate(lists) if x and set(asked) & set(x)}
    found = {r.id for r in masked.where(terms.labelled_pathogenic("m", dictionary)).collect()}
    joined = {i: ".".join(t for t in x or [] if t) for i, x in enumerate(lists)}
    assert found == {i for i, t in joined.items() if "athogenic" in t and "benign" not in t}


def test_a_later_load_keeps_earlier_masks(spark):
    first = spark.createDataFrame([(["b", "a"],)], "c array<string>")
    later = spark.createDataFrame([(["a", "0"],), (["c", "c", "0"],)], "c array<string>")
    dictionary = terms.term_dictionary(first, "c")
    assert {(r.term, r.n) for r in terms.unknown_terms(later, "c", dictionary).collect()} == {("0", 2), ("c", 1)}
    wider = terms.term_dictionary(later, "c", dictionary)
    assert wider == ["a", "b", "0", "c"]
    assert terms.with_masks(first, "c", dictionary, "m").first().m_0 == terms.with_masks(first, "c", wider, "m").first().m_0


def test_masked_question_reads_one_column(spark, capsys, scratch):
    rows = fx.vat(spark, SF)
    dictionary = terms.term_dictionary(rows, "consequence")
    terms.with_masks(rows, "consequence", dictionary, "m").write.parquet(scratch)
    asked = spark.read.parquet(scratch).where(terms.has_any("m", dictionary, ["stop_gained"])).select("vid")
    asked.explain("formatted")
    plan = capsys.readouterr().out
    assert "ReadSchema: struct<vid:string,m_0:bigint>" in plan


def test_a_text_column_is_no_vocabulary(spark):
    with pytest.raises(ValueError):
        terms.term_dictionary(spark.range(5000).select(F.array(F.col("id").cast("string")).alias("c")), "c")


# Checked loads


def test_rejected_rows_keep_their_content(spark, tmp_path):
    header = "\t".join(ALT_ALLELE.names)
    good = ["5", "7", "A", "C", "1", "0/1", "30", "", "", "", "57.9", "", "", "1,2", "1", "2"]
    change = lambda **values: "\t".join(values.get(n, g) for n, g in zip(ALT_ALLELE.names, good))
    lines = [
        change(), change(location="x1"), change(sample_id=""), change(qual="n/a", ad="-"), "5\t7\tA", change() + "\tmore", "",
        change(raw_mq="12x"), change(allele="\"a\tb\""), change(location=" "),
    ]
    (tmp_path / "a.tsv").write_text("\n".join([header, *lines[:5]]) + "\n")
    (tmp_path / "b.tsv").write_text("\n".join([header, *lines[5:]]) + "\n")
    load = quarantine.checked_load(spark, f"file://{tmp_path}")
    assert load.loaded.schema.names == ALT_ALLELE.names
    assert sorted((r.location, r.sample_id, r.allele, r.qual) for r in load.loaded.collect()) == [(5, 7, "C", 57), (5, 7, "a\tb", 57)]
    rejected = {(r.file.rpartition("/")[2], tuple(r.reasons)): r.record for r in load.rejected.collect()}
    assert set(rejected) == {
        ("a.tsv", ("location: not a number",)), ("a.tsv", ("sample_id: missing",)),
        ("a.tsv", ("qual: not a number", "ad: not a number")), ("a.tsv", ("line: number of fields",)),
        ("b.tsv", ("line: number of fields",)), ("b.tsv", ("raw_mq: not a number",)), ("b.tsv", ("location: missing",)),
    }
    assert rejected["a.tsv", ("line: number of fields",)] == "5\t7\tA"
    assert '"location":"x1"' in rejected["a.tsv", ("location: not a number",)]
    counts = {r.rows: r.n for r in quarantine.account(load).collect()}
    assert counts == {"loaded": 2, "rejected": 7, "read": 9}  # an empty line is no row
    assert {(r.file.rpartition("/")[2], r.rejected) for r in quarantine.rejected_files(load).collect()} == {("a.tsv", 4), ("b.tsv", 3)}
    table = f"{tmp_path}/quarantine"
    quarantine.quarantine(load, table)
    quarantine.quarantine(load, table)
    assert spark.read.parquet(table).count() == 14


def test_a_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("location\tref\n1\tA\n")
    with pytest.raises(ValueError, match="sample_id"):
        quarantine.checked_load(spark, f"file://{tmp_path}")


# Table functions


def test_table_functions_push_their_filters(spark, capsys, scratch):
    fx.alt_allele(spark, SF).write.parquet(f"{scratch}/calls")
    fx.vat(spark, SF).write.parquet(f"{scratch}/vat")
    spark.read.parquet(f"{scratch}/calls").createOrReplaceTempView("stored_calls")
    spark.read.parquet(f"{scratch}/vat").createOrReplaceTempView("stored_vat")
    sql.register_questions(spark, "stored_calls", "stored_vat", ["INS", "GCK", "it's"], prefix="s_")
    pushed = {
        "s_calls_in_range(5, 9)": ["GreaterThan(location,5)", "LessThan(location,9)"],
        "s_variants_of_gene('INS')": ["EqualTo(gene_symbol,INS)"],
        "s_pathogenic_carriers(20, 20)": ["GreaterThanOrEqual(call_GQ,20)", "In(gene_symbol"],
    }
    for call, filters in pushed.items():
        spark.sql(f"SELECT * FROM {call}").explain("formatted")
        plan = capsys.readouterr().out
        assert all(f in plan for f in filters), plan
    # A function is a table: it joins and filters further.
    narrow = spark.sql("SELECT count(*) AS n FROM s_calls_in_range(0, 1000000000000000) WHERE sample_id = 7").first().n
    assert narrow == fx.alt_allele(spark, SF).where("sample_id = 7").count()


# Alias tables


def test_alias_slots_hold_exact_shares(spark):
    rng = random.Random(12)
    rows = [(g, i, rng.choice([0, 1, 1, 2, 50, 10**9])) for g in range(6) for i in rng.sample(range(1000), [1, 2, 3, 40, 200, 7][g])]
    rows += [(7, i, 5) for i in range(20)] + [(8, 0, 0), (9, 0, None)]
    slots = alias.alias_table(spark.createDataFrame(rows, "g int, i int, w bigint"), "g", "i", "w").collect()
    held, per_group = Counter(), defaultdict(list)
    for r in slots:
        assert 0 < r.threshold <= r.total
        held[r.g, r.i] += r.threshold
        held[r.g, r.other] += r.total - r.threshold
        per_group[r.g].append(r.slot)
    weights_ = {(g, i): w for g, i, w in rows if w}
    n = Counter(g for g, _ in weights_)
    assert held == {(g, i): w * n[g] for (g, i), w in weights_.items()}
    assert all(sorted(s) == list(range(n[g])) for g, s in per_group.items()) and set(per_group) == set(n)


def test_alias_draws_follow_the_weights(spark):
    rng = random.Random(13)
    bins = {b * 100 + 10**12 * (b % 3): rng.choice([1, 2, 30, 400]) for b in range(60)}
    tables_ = alias.block_tables(spark.createDataFrame(list(bins.items()), "location bigint, weight bigint"), 2_000)
    draws = 40_000
    rule = hash_noise(5, "id")
    found = alias.alias_draw(spark.range(draws), tables_, (rule("a"), rule("b")), (rule("c"), rule("d")))
    counts = {r.bucket: r["count"] for r in found.groupBy("bucket").count().collect()}
    total = sum(bins.values())
    assert sum(counts.values()) == draws and set(counts) <= set(bins)
    for b, w in bins.items():
        p = w / total
        assert abs(counts.get(b, 0) - draws * p) <= 4 * (draws * p * (1 - p)) ** 0.5 + 1


# Packed genome


def test_packed_genome(spark):
    rng = random.Random(14)
    texts = ["", "A", "acgtn", "NNNNN", "ACGTRYNNacgtNnTTg" * 9, "".join(rng.choices("ACGTacgtN", k=1000)), "T" * 32, "t" * 33, "G" * 64, None]
    chunks = spark.createDataFrame([(i * 10_000, t) for i, t in enumerate(texts)], "location bigint, bases string")
    made = packed.packed_genome(chunks)
    assert {r.location: r.bases for r in packed.unpacked_genome(made).collect()} == {i * 10_000: t for i, t in enumerate(texts)}
    asked = [(i * 10_000 + o,) for i, t in enumerate(texts) for o in range(len(t or "") + 2)]
    found = {r.location: r.ref_base for r in packed.packed_base_lookup(spark.createDataFrame(asked, "location bigint"), made).collect()}
    assert found == {i * 10_000 + o: (t[o] if o < len(t) else None) if t is not None else None for i, t in enumerate(texts) for o in range(len(t or "") + 2)}


def test_a_packed_chunk_takes_a_quarter(spark):
    rng = random.Random(15)
    chunks = spark.createDataFrame([(i, "".join(rng.choices("ACGT", k=10_000))) for i in range(5)], "location bigint, bases string")
    assert joins.measured_bytes(packed.packed_genome(chunks)) < 0.26 * joins.measured_bytes(chunks)


# Repeated deliveries


def test_a_repeated_file_rewrites_nothing(spark, scratch):
    """A sample's file that comes again under another name, after a restart, is known by its calls."""
    source, store = f"{scratch}/arriving", f"{scratch}/store"
    calls = fx.alt_allele(spark, SF)
    ingest.create_store(bitmaps.condense_bitmap(calls.where("sample_id < 5")), store)
    run = lambda: ingest.ingest_stream(spark, source, store, repeats_within="10 days").awaitTermination()
    calls.where("sample_id BETWEEN 5 AND 8").coalesce(1).write.mode("append").parquet(source)
    run()
    first = sorted(map(str, ingest.read_bitmaps(spark, store).collect()))
    wrote = lambda: {r.number for r in spark.read.parquet(f"{store}/commits/{ingest._newest(spark, store, None):08d}").collect()}
    assert wrote() == {0, 1} or wrote() == {1}
    before = wrote()
    calls.where("sample_id BETWEEN 5 AND 8").coalesce(1).write.mode("append").parquet(source)
    run()
    assert ingest._newest(spark, store, None) > 1 and wrote() == before
    assert sorted(map(str, ingest.read_bitmaps(spark, store).collect())) == first
    calls.where("sample_id = 9").coalesce(1).write.mode("append").parquet(source)
    run()
    assert wrote() > before or wrote() != before
    expected = carriers([(r.location, r.ref, r.allele, r.sample_id) for r in calls.where("sample_id < 10").collect()])
    assert {tuple(r)[:3]: set(r.sample_ids) for r in ingest.read_store(spark, store).collect()} == expected


def test_the_newest_commit_alone_is_opened(spark, scratch):
    empty = calls_of(spark, [])
    ingest.create_store(bitmaps.condense_bitmap(calls_of(spark, [(5, "A", "C", 1)])), scratch)
    for number in range(1, 4):
        ingest.merge_batch(empty, scratch, number)
    assert ingest._newest(spark, scratch, None) == 3 and ingest._newest(spark, scratch, 1) == 1
    # Damage an older commit: readers of the newest do not notice.
    spark.createDataFrame([("x",)], "commit string").write.mode("overwrite").parquet(f"{scratch}/commits/00000001")
    assert ingest.read_store(spark, scratch).collect()[0].sample_ids == [1]
    with pytest.raises(ValueError):
        ingest.read_store(spark, scratch, upto=-1)
