"""Generator, streaming and registry."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.constants import ALLOWED_BASES, STATS_BIN
from helixframe.functions.noise import modular_noise
from helixframe.operators import cohort
from helixframe.plans import catalog, fixtures as fx, ml, questions, synth
from helixframe.schemas import ALT_ALLELE, BITMAPS, SPIKES, STAT_METRICS, WEIGHTS
from helixframe.streaming import ingest
from check import open_oracle, oracle_bag, spark_bag, type_gaps

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
START = 10**12 + 10_000


def small_model(spark, spike_share):
    """Bins 0 and 1 of one block, bin 2 without a bitmap, and a bin in a block without metrics."""
    weights = [(START, 50), (START + 100, 30), (START + 200, 20), (START + 50_000, 10)]
    bitmaps = [(START, 1, 1 << 3, 0), (START + 100, 1, 0, 1 << 7), (START + 50_000, 1, 1, 0)]
    spikes = [(START + 100, START + 120, "TT", spike_share)]
    stats = [(START - START % STATS_BIN, 9, *[10.0, 0.0] * 4)]
    names = "location_bin bigint, entries bigint, " + ", ".join(f"{m} double" for m in STAT_METRICS)
    make = spark.createDataFrame
    model = synth.Model(make(weights, WEIGHTS), make(stats, names), make(bitmaps, BITMAPS), make(spikes, SPIKES))
    blocks = make([(START,), (START + 50_000,)], "location bigint")
    return model, fx.genome(blocks)


def test_generated_rows_follow_the_model(spark):
    model, genome = small_model(spark, 1.0)
    draws = synth.draw_rows(spark, samples=3, draws=2000)
    rows = synth.generate(draws, model, genome, seed=11).orderBy("sample_id").collect()
    known = {START + 3, START + 157}
    unit = fx.GENOME_UNIT
    for sample in (1, 2, 3):
        mine = [r for r in rows if r.sample_id == sample]
        # Past the warm-up, 80 of 110 draws fall into a bin with metrics and known offsets.
        assert 1350 < len(mine) < 1600
        # All but the warm-up falls on known offsets or on the dominant variant.
        loose = [r for r in mine if r.location not in known and r.location != START + 120]
        assert 0 < len(loose) <= 100
        spiked = [r for r in mine if r.allele == "TT"]
        assert spiked and {r.location for r in spiked} == {START + 120}
        assert not [r for r in mine if START + 100 <= r.location < START + 200 and r.allele != "TT"]
    for r in rows:
        assert r.ref == unit[r.location % 100].upper() and r.location < START + 50_000
        assert r.allele == "TT" or (r.ref.lower() in ALLOWED_BASES and r.allele != r.ref)
        assert (r.qual, r.ref_ad, r.ad, r.call_GQ, r.call_AD) == (10, 10, 10, 10, "10,10")
        assert (r.allele_pos, r.call_GT, r.raw_mq, r.as_sb_table) == (1, "0/1", None, None)


def test_warmup_counts_accepted_rows(spark):
    """The first 100 accepted rows fall anywhere: replayed draw by draw in Python."""
    model, genome = small_model(spark, 0.0)
    rule = modular_noise(synth.NOISE_TAGS)
    draws = synth.draw_rows(spark, samples=2, draws=900)
    placed = synth.place_draws(draws, model, genome, rule).where("metrics IS NOT NULL")
    expected = []
    for sample in (1, 2):
        accepted = 0
        for d in placed.where(F.col("sample_id") == sample).orderBy("draw_no").collect():
            offset, base = (d.offset_any, d.base_any) if accepted < 100 else (d.offset_known, d.base_known)
            if base in ALLOWED_BASES:
                expected.append((sample, d.bucket + offset))
                accepted += 1
    got = synth.generate(draws, model, genome, rule).select("sample_id", "location").collect()
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("warmup", [1, 100, 1200])
def test_warmup_of_any_length(spark, monkeypatch, warmup):
    """The rank of the last warm-up draw, over several blocks of draw numbers."""
    monkeypatch.setattr(synth, "WARMUP_BLOCK", 256)
    random.seed(9)
    rows = [(s, d * 3, random.random() < 0.7) for s, n in ((1, 2500), (2, 900), (3, 40)) for d in range(n)]
    made = spark.createDataFrame(rows, "sample_id bigint, draw_no bigint, ok boolean").select(
        "sample_id", "draw_no", F.lit(False).alias("spiked"), F.lit(None).cast("string").alias("spike_base"),
        F.when(F.col("ok"), "a").otherwise("n").alias("base_any"),
    )
    expected = {}
    for sample in (1, 2, 3):
        accepted = [d for s, d, ok in rows if s == sample and ok]
        if len(accepted) >= warmup:
            expected[sample] = accepted[warmup - 1]
    assert {r.sample_id: r.warmup_end for r in synth.warmup_ends(made, warmup).collect()} == expected


@pytest.mark.parametrize("times", [1, 7, 15, 16, 40])
def test_warmup_ranks_rows_only_where_draws_repeat_often(spark, monkeypatch, times):
    """Draws below zero, at word and block ends; no row is pinned, nor ranked unless its draw comes too often."""
    numbers = [-300, -257, -256, -1, 0, 63, 64, 127, 128, 191, 192, 255, 256, 5000, 2**40]
    rows = [(1, n) for n in numbers] * times + [(None, 1), (2, None), (2, 3)]
    made = spark.createDataFrame(rows, "sample_id bigint, draw_no bigint").select(
        "*", F.lit(True).alias("spiked"), F.lit("a").alias("spike_base"), F.lit(None).cast("string").alias("base_any")
    )
    joined, pinned, join, pin = [], [], synth.join_measured, synth.pin
    monkeypatch.setattr(synth, "join_measured", lambda large, small, *a: joined.append(small.count()) or join(large, small, *a))
    monkeypatch.setattr(synth, "pin", lambda df: pinned.append(pin(df)) or pinned[-1])
    for warmup in (1, 2, 4, 7, 12, 15, 15 * times):
        expected = sorted(numbers * times)[warmup - 1]
        assert {r.sample_id: r.warmup_end for r in synth.warmup_ends(made, warmup).collect()}[1] == expected
    assert bool(joined) == (times > 7)
    assert max(df.count() for df in pinned) <= 3


def test_generator_gives_the_same_sample_in_any_partitioning(spark):
    model, genome = small_model(spark, 0.5)
    draws = synth.draw_rows(spark, samples=2, draws=500)
    first, second = (synth.generate(draws.repartition(n), model, genome, seed=3) for n in (1, 9))
    assert first.count() > 0 and first.exceptAll(second).isEmpty() and second.exceptAll(first).isEmpty()


def test_draws_too_many_to_broadcast_bins_are_not_sorted(spark):
    model, genome = small_model(spark, 0.3)
    draws, rule = synth.draw_rows(spark, samples=3, draws=400), modular_noise(synth.NOISE_TAGS)
    small, large = (synth.place_draws(draws, model, genome, rule, max_bytes=n) for n in (1 << 30, 0))
    assert large.count() > 0 and small.exceptAll(large).isEmpty() and large.exceptAll(small).isEmpty()
    assert "SortMergeJoin" not in large._jdf.queryExecution().executedPlan().toString()


def test_calls_of_a_hot_bin_are_not_joined_by_one_task(spark):
    found = catalog.queries()["gen_random"](spark, "/root/testdata/sf0.001")
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "_bin" in line and "Join" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert found.where("NOT (in_bins AND bounded AND same_again)").isEmpty()


def test_metrics_are_clamped(spark):
    model, genome = small_model(spark, 0.0)
    wild = model.stats.withColumns({c: F.lit(200.0 if c.startswith("stddev") else 0.0) for c in STAT_METRICS})
    rows = synth.generate(synth.draw_rows(spark, 1, 1500), model._replace(stats=wild), genome, seed=2)
    low = rows.agg(F.min("qual"), F.min("ref_ad"), F.min("ad"), F.min("call_GQ"), F.max("call_GQ")).first()
    assert tuple(low) == (0, 1, 1, 1, 100)


def test_ingest_is_idempotent_and_resumes(spark, scratch):
    random.seed(8)
    rows = [(random.randint(1, 50), "A", random.choice("CG"), s) for s in range(1, 31) for _ in range(10)]
    plain = spark.createDataFrame(rows, "location bigint, ref string, allele string, sample_id bigint")
    calls = plain.select(*(F.col(f.name) if f.name in plain.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ALT_ALLELE))
    old, new = cohort.holdout(calls, 10)
    store, arriving = f"{scratch}/store", f"{scratch}/arriving"
    ingest.create_store(cohort.condense(new), store)
    expected = {tuple(r)[:3]: set(r.sample_ids) for r in cohort.condense(calls).collect()}

    def state():
        return {tuple(r)[:3]: set(r.sample_ids) for r in ingest.read_store(spark, store).collect()}

    for samples in ((11, 20), (21, 30)):
        old.where(F.col("sample_id").between(*samples)).write.mode("append").parquet(arriving)
        ingest.ingest_stream(spark, arriving, store, files_per_batch=2).awaitTermination()
    assert state() == expected
    numbers = [r.number for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{store}/commits").collect()]
    last = max(numbers)
    earlier = ingest.read_store(spark, store, upto=last - 1)
    replay = old.where(F.col("sample_id").between(21, 30))
    ingest.merge_batch(replay, store, last)
    assert state() == expected and earlier.count() > 0


def test_a_batch_rewrites_only_the_blocks_it_touches(spark, scratch):
    def calls(*rows):
        frame = spark.createDataFrame(rows, "location bigint, ref string, allele string, sample_id bigint")
        return frame

    a, b, c = 5, 2 * ingest.BLOCK_BASES + 7, 9 * ingest.BLOCK_BASES
    ingest.create_store(cohort.condense(calls((a, "A", "C", 1), (b, "A", "C", 1), (c, "G", None, 1), (None, "A", "C", 1))), scratch)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")

    def listing():
        return {(r.path, r.modificationTime) for r in files.load(f"{scratch}/data").select("path", "modificationTime").collect()}

    before = listing()
    ingest.merge_batch(calls((b, "A", "C", 2), (c, "G", None, 1), (c, "G", "T", 3)), scratch, 1)
    assert before < listing() and len(listing() - before) == 2
    state = {tuple(r)[:3]: sorted(r.sample_ids) for r in ingest.read_store(spark, scratch).collect()}
    assert state == {(a, "A", "C"): [1], (b, "A", "C"): [1, 2], (c, "G", None): [1], (c, "G", "T"): [3], (None, "A", "C"): [1]}
    assert ingest.read_store(spark, scratch, upto=0).count() == 4
    ingest.merge_batch(calls().limit(0), scratch, 2)
    assert ingest.read_store(spark, scratch).count() == 5
    assert ingest.removable_paths(spark, scratch, 0) == []
    assert [p.rpartition("/")[2] for p in ingest.removable_paths(spark, scratch, 2)] == ["block=2", "block=9"]


def test_stored_tables_are_filtered_in_the_scan(spark, capsys):
    for name, pushed in (("range_count_stored", "GreaterThan(location"), ("gene_filter_stored", "In(gene_symbol")):
        capsys.readouterr()
        catalog.queries()[name](spark, SF).explain("formatted")
        plan = capsys.readouterr().out
        assert pushed in plan and "REPARTITION" not in plan


def test_questions_take_table_names(spark):
    fx.alt_allele(spark, SF).createOrReplaceTempView("some_calls")
    n = questions.ask(spark, "count_rows", calls="some_calls").first().n
    assert n == questions.ask(spark, "rows_in_range", calls="some_calls", low=0, high=10**15).count()


def test_index_of_many_texts(spark):
    """Far more texts than a driver-side index takes, a third of the rows one of them."""
    ids = spark.range(0, 300_000, 1, 12)
    rows = ids.select(F.when(F.col("id") % 3 == 0, "T").otherwise(F.concat(F.lit("A"), F.col("id").cast("string"))).alias("alt"))
    index = ml.alphabetical_index(rows, "alt", "n").collect()
    assert [r.n for r in sorted(index, key=lambda r: r.alt)] == [float(i) for i in range(200_001)]
    made = ml.assemble_features(rows.select("alt", F.lit("A").alias("ref"), F.lit(5).alias("location")))
    assert made.where("alt = 'T' AND alt_index = 200000 AND ref_index = 0").count() == 100_000


@pytest.fixture(scope="module")
def oracle():
    return open_oracle(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_statement(spark, oracle, name):
    df = catalog.queries()[name](spark, SF)
    statement = entry.oracle_sql()[name]
    columns, rows = spark_bag(df)
    assert (columns, rows) == oracle_bag(oracle, statement) and rows
    assert type_gaps(df, oracle, statement) == []


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    statement = entry.oracle_sql()["variant_allele_join"]
    columns, rows = spark_bag(entry.entry(spark))
    assert rows and (columns, rows) == oracle_bag(open_oracle(SF), statement)
