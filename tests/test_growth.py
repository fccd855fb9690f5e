"""What a task reads stays bounded: parts grow with the rows, and work is not repeated for every file or interval."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from helixframe import session
from helixframe.constants import VARIANT_KEYS
from helixframe.operators import bitmaps, packed
from helixframe.plans import catalog, fixtures as fx
from helixframe.sources import buckets, quarantine, text, zorder

SF = "/root/testdata/sf0.001"


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_PART", 400)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_dealt_by_their_number(spark, scratch, small_parts):
    lines = fx.order_lines(spark, SF)
    assert lines.rdd.getNumPartitions() == -(-lines.count() // 400) > 8
    spark.range(2000).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id AS l_partkey").repartition(2).write.parquet(f"{scratch}/lineitem.parquet")
    assert fx.order_lines(spark, scratch).rdd.getNumPartitions() == 8
    assert fx.order_lines(spark, scratch).count() == 2000


def test_files_and_buckets_grow_with_the_rows(spark, scratch, small_parts, monkeypatch):
    assert len(catalog.queries()["scan_parquet_dir"](spark, SF).inputFiles()) > 5
    rows = spark.range(5000).selectExpr("id % 900 AS location", "id % 70 AS sample_id")
    zorder.write_z_ordered(rows, scratch, ("location", "sample_id"), files=2)
    laid = zorder.box_of_files(spark, scratch, ["location"]).collect()
    assert len(laid) > 8 and max(r.n for r in laid) < 1000 and sum(r.n for r in laid) == 5000
    dealt, write = [], buckets.write_bucketed
    monkeypatch.setattr(buckets, "write_bucketed", lambda df, name, keys, n, **k: dealt.append(n) or write(df, name, keys, n, **k))
    calls = fx.alt_allele(spark, SF)
    found = catalog.queries()["variant_allele_join_bucketed"](spark, SF)
    assert sorted(found.collect()) == sorted(catalog.queries()["variant_allele_join"](spark, SF).collect())
    monkeypatch.setattr(session, "ROWS_PER_PART", 90)
    stored = catalog.queries()["bucketed_rows"](spark, SF)
    assert Counter(stored.select(*VARIANT_KEYS).collect()) == Counter(calls.select(*VARIANT_KEYS).collect())
    n = calls.count()
    assert dealt == [-(-n // 400), -(-n // 400), -(-n // 90)] and dealt[0] > 8 and dealt[2] > 64


def test_packed_lookup_meets_no_list_of_intervals(spark):
    texts = ["ACGTnnNN--acgtACGT" * 7, "A" * 31 + "n" + "c" * 32 + "éxA", "", "a", None, "N" * 70, "\U0001f600ac\U0001f600T" * 20]
    chunks = spark.createDataFrame([(i * 10_000, t) for i, t in enumerate(texts)], "location bigint, bases string")
    made = packed.packed_genome(chunks)
    asked = spark.createDataFrame([(i * 10_000 + o,) for i in range(7) for o in range(130)], "location bigint")
    looked = packed.packed_base_lookup(asked, made)
    got = {r.location: r.ref_base for r in looked.collect()}
    for i, t in enumerate(texts):
        assert [got[i * 10_000 + o] for o in range(130)] == [*(t or "")[:130], *[None] * (130 - len((t or "")[:130]))]
    assert "lambda" not in _plan(looked)
    back = {r.location: r.bases for r in packed.unpacked_genome(made).collect()}
    assert back == {i * 10_000: t for i, t in enumerate(texts)}


def test_words_are_taken_apart_by_bytes(spark):
    ids = [0, 7, 8, 63, 64, 127, 32_767, 32_768, -1, -64, -65, -32_769]
    calls = spark.createDataFrame([(5, "A", "C", i) for i in ids], "location bigint, ref string, allele string, sample_id bigint")
    rows = bitmaps.carrier_rows(bitmaps.condense_bitmap(calls))
    assert sorted(r.sample_id for r in rows.collect()) == sorted(ids)
    assert "63" not in _plan(rows).split("Generate", 1)[1].split("Aggregate", 1)[0]


@pytest.mark.parametrize("read", [text.read_tsv, quarantine.read_permissive])
def test_sample_folders_are_listed_once(spark, scratch, monkeypatch, read):
    text.write_sample_tsv(fx.alt_allele(spark, SF), f"{scratch}/samples")
    kind, asked = type(spark.read), []
    csv = kind.csv
    monkeypatch.setattr(kind, "csv", lambda self, path, *a, **b: asked.append(path) or csv(self, path, *a, **b))
    rows = read(spark, f"{scratch}/samples")
    assert asked.count(f"{scratch}/samples") == 1 and len(asked) == 2
    assert rows.count() == fx.alt_allele(spark, SF).count()


@pytest.mark.parametrize("read", [text.read_tsv, quarantine.read_permissive])
def test_another_header_is_read_by_its_names(spark, scratch, read):
    lines = spark.createDataFrame([("b\tmore\ta\n1\t2\t3\n",)], "value string").coalesce(1)
    for folder in ("plain", "with space [x]"):
        lines.write.text(f"{scratch}/{folder}")
    assert [(r.a, r.b) for r in read(spark, f"{scratch}/plain", ("a", "b")).collect()] == [("3", "1")]
    with pytest.raises(ValueError):
        read(spark, f"{scratch}/plain", ("a", "c"))
    spark.createDataFrame([], "value string").write.text(f"{scratch}/none/x")
    lines.write.text(f"{scratch}/none/y")
    assert read(spark, f"{scratch}/none", ("b", "more", "a")).count() == 1
