"""Round trips through files, and what clustering does to them."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.plans import fixtures as fx
from helixframe.schemas import ALT_ALLELE, BITMAPS, SPIKES, WEIGHTS
from helixframe.sources import fasta, tables, text

SF = "/root/testdata/sf0.001"


def chunks_of(contigs, chunk, base):
    found = {}
    for name, bases in contigs.items():
        padded = "N" * base + bases
        for start in range(0, len(padded), chunk):
            found[(name, start)] = padded[start : start + chunk]
    return found


def write_lines(spark, path, lines):
    one_file = spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    one_file.write.text(path)


@pytest.fixture
def tiny_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for key, value in old.items():
        spark.conf.set(key, value)


@pytest.mark.parametrize("base", [0, 1])
def test_fasta_over_many_splits(spark, scratch, tiny_splits, base):
    random.seed(1)
    contigs = {
        "chr1": "".join(random.choices("ACGTN", k=1234)),
        "chrX": "".join(random.choices("acgt", k=7)),
        "chr2": "".join(random.choices("ACGT", k=660)),
        "chr1_random": "ACGT",
    }
    lines = []
    for name, bases in contigs.items():
        lines.append(f">{name}  some text > more\r")
        lines += [bases[i : i + 60] for i in range(0, len(bases), 60)] + [""]
    write_lines(spark, scratch, lines)
    assert spark.read.text(scratch).rdd.getNumPartitions() > 10
    got = fasta.scan_fasta(spark, scratch, chunk=100, position_base=base).collect()
    assert {(r.contig, r.chunk_start): r.bases for r in got} == chunks_of(contigs, 100, base)
    assert len(got) == len(chunks_of(contigs, 100, base))


def test_fasta_with_a_contig_on_one_line(spark, scratch):
    contigs = {"chrY": "ACGT" * 800, "chr3": "T"}
    write_lines(spark, scratch, [">chrY", contigs["chrY"], ">chr3", "T"])
    chunks = fasta.scan_fasta(spark, scratch, chunk=1000)
    assert {(r.contig, r.chunk_start): r.bases for r in chunks.collect()} == chunks_of(contigs, 1000, 1)
    starts = sorted(r.location for r in fasta.located(chunks).collect())
    assert starts == [3 * 10**12, *(24 * 10**12 + 1000 * i for i in range(4))]


def test_clustered_files_cover_disjoint_ranges(spark, scratch):
    calls = fx.alt_allele(spark, SF)
    tables.write_clustered(calls, scratch, then_by=("ref", "allele"), files=6)
    ranges = (
        spark.read.parquet(scratch)
        .groupBy("_metadata.file_path")
        .agg(F.min("location").alias("low"), F.max("location").alias("high"))
        .orderBy("low")
        .collect()
    )
    assert len(ranges) == 6
    assert all(a.high <= b.low for a, b in zip(ranges, ranges[1:]))
    back = tables.scan_dir(spark, scratch, ALT_ALLELE)
    assert back.exceptAll(calls).isEmpty() and calls.exceptAll(back).isEmpty()


def test_clustering_splits_copies_of_one_row(spark, scratch):
    copies = spark.range(0, 8000, 1, 8).select(F.lit(5).alias("location"))
    tables.write_clustered(copies, scratch, files=8)
    sizes = spark.read.parquet(scratch).groupBy("_metadata.file_path").count().collect()
    assert len(sizes) == 8 and sum(s["count"] for s in sizes) == 8000


def test_range_filter_reaches_the_scan(spark, scratch, capsys):
    tables.write_clustered(fx.alt_allele(spark, SF), scratch)
    from helixframe.operators.cohort import count_in_range

    count_in_range(tables.scan_dir(spark, scratch, ALT_ALLELE), 1, 2).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(location,1), LessThan(location,2)" in plan
    assert "ReadSchema: struct<location:bigint>" in plan


def test_compact_leaves_the_source_alone(spark, scratch):
    tables.write_dir(spark.range(100).select(F.col("id").alias("location")).repartition(20), f"{scratch}/a")
    merged = tables.compact(spark, f"{scratch}/a", f"{scratch}/b", files=2)
    assert merged.count() == 100 == spark.read.parquet(f"{scratch}/a").count()
    assert tables.file_manifest(spark, f"{scratch}/b").count() == 2
    assert tables.file_manifest(spark, f"{scratch}/a").where("size > 0").count() == 20


def test_sample_tsv_round_trip(spark, scratch):
    calls = fx.alt_allele(spark, SF)
    text.write_sample_tsv(calls, scratch)
    loaded = text.load_samples(spark, scratch, spark.createDataFrame([], ALT_ALLELE))
    assert loaded.schema.names == ALT_ALLELE.names
    assert loaded.exceptAll(calls).isEmpty() and calls.exceptAll(loaded).isEmpty()
    folders = tables.file_manifest(spark, scratch).select(F.element_at(F.split("path", "/"), -2)).distinct()
    assert folders.count() == calls.select("sample_id").distinct().count()
    with pytest.raises(ValueError):
        text.load_samples(spark, scratch, calls)


def test_model_csv(spark, scratch):
    weights = spark.createDataFrame([(100, 5), (200, 0)], WEIGHTS)
    text.write_model_csv(weights, f"{scratch}/w")
    assert sorted(map(tuple, text.read_weights(spark, f"{scratch}/w").collect())) == [(100, 5), (200, 0)]
    assert tables.file_manifest(spark, f"{scratch}/w").where(~F.col("name").endswith(".csv.gz")).isEmpty()

    spikes = spark.createDataFrame([(100, 101, "A", 0.5), (200, None, None, None)], SPIKES)
    text.write_model_csv(spikes, f"{scratch}/s")
    assert [tuple(r) for r in text.read_spikes(spark, f"{scratch}/s").collect()] == [(100, 101, "A", 0.5)]

    bitmaps = spark.createDataFrame([(100, 3, None, 6), (200, 1, 1, None)], BITMAPS)
    text.write_model_csv(bitmaps, f"{scratch}/b")
    assert sorted(map(tuple, text.read_bitmaps(spark, f"{scratch}/b").collect())) == [(100, 3, 0, 6), (200, 1, 1, 0)]


def test_unreadable_stats_become_five(spark, scratch):
    line = "0,1,22.5,NULL,3,,4,x,50,1.5"
    header = "location_bin,entries,avg_qual,stddev_qual,avg_refad,stddev_refad,avg_ad,stddev_ad,avg_gq,stddev_gq"
    write_lines(spark, scratch, [header, line])
    assert tuple(text.read_bucket_stats(spark, scratch).first()) == (0, 1, 22.5, 5.0, 3.0, 5.0, 4.0, 5.0, 50.0, 1.5)


def test_replace_table(spark, scratch):
    name = "helixframe_replace_test"
    for n in (3, 5):
        tables.replace_table(spark.range(n), name, scratch)
        assert tables.scan_table(spark, name).count() == n
    broken = spark.range(9).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    with pytest.raises(Exception):
        tables.replace_table(broken, name, scratch)
    assert tables.scan_table(spark, name).count() == 5
    tables.replace_table(spark.range(2).select("id", F.lit("x").alias("more")), name, scratch)
    assert tables.scan_table(spark, name).columns == ["id", "more"]


def test_a_failed_replacement_brings_the_old_table_back(spark, scratch, monkeypatch):
    """Other columns, and the catalog refuses the new table: the name still has the old rows."""
    name = "helixframe_kept_test"
    tables.replace_table(spark.range(4), name, scratch)
    catalog_type = type(spark.catalog)
    monkeypatch.setattr(catalog_type, "createTable", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("refused")))
    with pytest.raises(RuntimeError, match="refused"):
        tables.replace_table(spark.range(2).select("id", F.lit("x").alias("more")), name, scratch)
    monkeypatch.undo()
    assert spark.table(name).columns == ["id"] and spark.table(name).count() == 4
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith(name + "_")]


def test_paths_with_quotes(spark, scratch):
    name = "helixframe_quote_test"
    for n in (1, 2):
        tables.replace_table(spark.range(n), name, f"{scratch}/it's")
    assert spark.table(name).count() == 2


def test_compact_points_the_table_to_the_new_files(spark, scratch):
    rows = spark.range(1000).select(F.col("id").alias("location"))
    name = "helixframe_compact_test"
    tables.write_table(rows.repartition(20), name, f"{scratch}/a")
    again = tables.compact(spark, f"{scratch}/a", f"{scratch}/b", files=2, name=name)
    assert again.count() == 1000 and len(spark.table(name).inputFiles()) == 2


def test_columns_are_found_by_name(spark, scratch):
    write_lines(spark, f"{scratch}/a", ["b\ta\tc", "2\t1\t3"])
    assert [tuple(r) for r in text.read_tsv(spark, f"{scratch}/a", ("a", "b")).collect()] == [("1", "2")]
    with pytest.raises(ValueError):
        text.read_tsv(spark, f"{scratch}/a", ("a", "d"))
    write_lines(spark, f"{scratch}/two/x", ["a\tb", "1\t2"])
    write_lines(spark, f"{scratch}/two/y", ["b\ta", "2\t1"])
    with pytest.raises(Exception):
        text.read_tsv(spark, f"{scratch}/two", ("a", "b")).collect()
    write_lines(spark, f"{scratch}/w", ["weight,location", "7,100"])
    assert [tuple(r) for r in text.read_weights(spark, f"{scratch}/w").collect()] == [(100, 7)]


def test_load_takes_malformed_numbers(spark, scratch):
    columns = list(ALT_ALLELE.names)
    values = {"location": "1000000000001", "sample_id": "7", "qual": "57.9", "ad": "n/a", "call_GQ": "", "ref": "A"}
    write_lines(spark, scratch, ["\t".join(reversed(columns)), "\t".join(values.get(c, "") for c in reversed(columns))])
    row = text.load_samples(spark, scratch, spark.createDataFrame([], ALT_ALLELE)).first()
    assert (row.location, row.sample_id, row.qual, row.ad, row.call_GQ, row.ref) == (1000000000001, 7, 57, None, None, "A")
