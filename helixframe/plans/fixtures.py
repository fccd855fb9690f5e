"""Stand-ins for variant tables, derived from the order, part and customer tables.

The SQL text is the same on every engine; ``{name}`` marks an input table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..constants import ALT_ALLELE_COLUMNS, STATS_BIN
from ..functions.numbers import floor_to
from ..operators.expand import expand_alt_alleles
from ..session import parts_for

# A seventh of the lines call one variant; neighbouring parts of a contig lie 7 bases apart; some
# second alternates are missing; some qualities and depths are decimals or no numbers; some samples
# have many calls of a variant, and their number grows with the orders.
RAW_VARIANTS_SQL = """
SELECT
 (k % 25 + 1) * 1000000000000 + 10000 + CAST(floor(k / 25) AS BIGINT) * 7 AS location,
 CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 97 + 1 ELSE CAST(floor(l_orderkey / 200) AS BIGINT) + 1 END AS sample_id,
 CASE k % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'CTT' WHEN 2 THEN 'GATA' WHEN 3 THEN 'T' WHEN 4 THEN 'AC' ELSE 'G' END AS ref,
 CASE WHEN k % 30 = 3 THEN 'C' ELSE CASE k % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'CT,C' WHEN 2 THEN 'GTA,GATATA' WHEN 3 THEN 'C,A' WHEN 4 THEN 'GC,AT' ELSE 'T' END END AS alt,
 CASE WHEN k % 6 IN (0,5) THEN
   CASE l_linenumber % 5 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' WHEN 2 THEN '0|1' WHEN 3 THEN '0/0' ELSE './.' END
 ELSE CASE l_linenumber % 7 WHEN 0 THEN '0/1' WHEN 1 THEN '1/2' WHEN 2 THEN '2|1' WHEN 3 THEN '1|1' WHEN 4 THEN '0/2'
   WHEN 5 THEN '0/0' ELSE '1|2' END END AS call_GT,
 CAST(l_quantity AS BIGINT) AS call_GQ,
 CASE WHEN l_linenumber = 3 THEN '0|n/a|n/a' ELSE '0|' || CAST(3600 + l_orderkey % 50 AS STRING) || '|'
   || CAST(2400 + l_orderkey % 30 AS STRING) END AS as_raw_mq,
 CASE WHEN l_linenumber = 2 THEN NULL ELSE '|0.' || CAST(l_orderkey % 10 AS STRING) || '|0.1' END AS as_raw_mqranksum,
 CASE l_linenumber WHEN 6 THEN '57.9' WHEN 5 THEN 'n/a' ELSE CAST(30 + l_orderkey % 70 AS STRING) END || '|' || CAST(20 + l_orderkey % 40 AS STRING) AS as_qualapprox,
 CAST(NULL AS STRING) AS as_raw_readposranksum,
 '1,2|3,4|5,6' AS as_sb_table,
 CASE WHEN l_orderkey % 40 = 1 THEN '.' ELSE CAST(l_suppkey % 30 AS STRING) END || ',' || CAST(CAST(l_quantity AS BIGINT) % 25 AS STRING) || ','
   || CAST(l_orderkey % 20 AS STRING) AS call_AD
FROM (SELECT *, CASE WHEN l_orderkey % 7 = 0 THEN 31 ELSE l_partkey END AS k FROM {lineitem}) lines
"""

# Three annotation rows per part: two equal ones and one of another transcript.
VAT_SQL = """
SELECT contig || '-' || CAST(position AS STRING) || '-' || ref_allele || '-' || alt_allele AS vid, p.* FROM (SELECT
 CASE p_partkey % 25 + 1 WHEN 23 THEN 'chrX' WHEN 24 THEN 'chrY' WHEN 25 THEN 'chrM'
   ELSE 'chr' || CAST(p_partkey % 25 + 1 AS STRING) END AS contig,
 10000 + CAST(floor(p_partkey / 25) AS BIGINT) * 7 AS position,
 CASE p_partkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'CT' WHEN 2 THEN 'GA' WHEN 3 THEN 'T' WHEN 4 THEN 'A' ELSE 'G' END AS ref_allele,
 CASE p_partkey % 6 WHEN 0 THEN 'G' WHEN 1 THEN 'C' WHEN 2 THEN 'G' WHEN 3 THEN 'C' WHEN 4 THEN 'G' ELSE 'T' END AS alt_allele,
 is_canonical_transcript,
 CASE p_partkey % 17 WHEN 0 THEN 'ABCC8' WHEN 1 THEN 'GCK' WHEN 2 THEN 'HNF1A' WHEN 3 THEN 'INS' WHEN 4 THEN 'BRCA1'
   WHEN 5 THEN NULL ELSE 'OTHER' || CAST(p_partkey % 17 AS STRING) END AS gene_symbol,
 split(CASE p_size % 5 WHEN 0 THEN 'Pathogenic' WHEN 1 THEN 'Likely_pathogenic;Benign'
   WHEN 2 THEN 'Pathogenic;Likely_benign' WHEN 3 THEN 'benign' ELSE NULL END, ';') AS clinvar_classification,
 split(CASE p_size % 3 WHEN 0 THEN 'stop_gained;splice_region_variant' WHEN 1 THEN 'missense_variant'
   ELSE 'synonymous_variant' END, ';') AS consequence,
 CAST(p_size AS BIGINT) AS gvs_all_sc
 FROM {part_transcripts}) p
"""

SAMPLE_INFO_SQL = """
SELECT c_custkey + 1 AS sample_id, c_name AS sample_name,
 CASE WHEN c_custkey % 11 = 0 THEN '2024-01-01' END AS withdrawn,
 CASE WHEN c_custkey % 13 = 0 THEN true WHEN c_custkey % 17 = 0 THEN NULL ELSE false END AS is_control
FROM {customer}
"""

# One draw per order line.
DRAWS_SQL = """
SELECT CAST(floor(l_orderkey / 200) AS BIGINT) + 1 AS sample_id, l_orderkey * 8 + l_linenumber AS draw_no FROM {lineitem}
"""

# Every 100 bases of the stand-in genome, with masked (lower-case) and unknown (N) bases.
GENOME_UNIT = (
    "ACGTTGCAACgattacagatCCGGNATCGAttgacctgaaACGTNCGTAC"
    "ggatccttaaTGCATGCATGcagtcagtncAATTCCGGATcatgcatgca"
)

# FASTA records made of part rows: a contig per part, its bases repeat with the part's key.
FASTA_SQL = """
SELECT 'p' || CAST(p_partkey AS STRING) AS contig,
 repeat(substr('ACGTTGCAACGATTACANNCCGGTATCGA', CAST(p_partkey % 20 + 1 AS INT), 7), CAST(p_partkey % 90 + 1 AS INT)) AS bases
FROM {part}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines (an action that counts rows by the files' footers).

    A file of this test data is one row group, so one task: a single one is dealt out, and so are files
    that make tasks of too many lines.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = parts_for(lines.count())
    if len(lines.inputFiles()) > 1 and lines.rdd.getNumPartitions() >= parts:
        return lines
    parts = max(parts, spark.sparkContext.defaultParallelism)
    return lines.repartition(parts, "l_orderkey", "l_linenumber", "l_partkey")


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(RAW_VARIANTS_SQL, lineitem=order_lines(spark, sf_dir))


def alt_allele(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_alt_alleles(raw_variants(spark, sf_dir))


def vat(spark: SparkSession, sf_dir: str) -> DataFrame:
    transcripts = F.explode(F.array(F.lit(True), F.lit(True), F.lit(False)))
    parts = table(spark, sf_dir, "part").withColumn("is_canonical_transcript", transcripts)
    return spark.sql(VAT_SQL, part_transcripts=parts)


def sample_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SAMPLE_INFO_SQL, customer=table(spark, sf_dir, "customer"))


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DRAWS_SQL, lineitem=order_lines(spark, sf_dir))


def genome(blocks: DataFrame, key: str = "location") -> DataFrame:
    """Located chunks for every 10,000-base block that the table names or has a location in."""
    starts = blocks.select(floor_to(F.col(key), STATS_BIN).alias("location")).distinct()
    # The starts are few bytes, so adaptive execution would make the bases of all of them in one task.
    starts = starts.repartition(blocks.sparkSession.sparkContext.defaultParallelism, "location")
    return starts.withColumn("bases", F.repeat(F.lit(GENOME_UNIT), STATS_BIN // len(GENOME_UNIT)))


def delivered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample's file as one text with its header, by ``sample``; of some samples all lines are faulty."""
    calls = alt_allele(spark, sf_dir).select(*(F.col(c).cast("string") for c in ALT_ALLELE_COLUMNS))
    fault = F.col("sample_id").cast("int") % 10
    changed = {
        "location": F.when(fault == 3, F.lit("")).otherwise(F.col("location")),
        "qual": F.when(fault == 5, F.lit("high")).otherwise(F.col("qual")),
        "ad": F.when(fault == 5, F.lit("1.2.3")).otherwise(F.col("ad")),
    }
    fields = [F.coalesce(changed.get(c, F.col(c)), F.lit("")) for c in ALT_ALLELE_COLUMNS]
    line = F.concat_ws("\t", *fields)
    line = F.when(fault == 7, F.concat_ws("\t", *fields[:-1])).when(fault == 8, F.concat(line, F.lit("\tmore"))).otherwise(line)
    lines = calls.select(F.col("sample_id").alias("sample"), line.alias("line"))
    whole = lines.groupBy("sample").agg(F.array_join(F.collect_list("line"), "\n").alias("lines"))
    return whole.select("sample", F.concat(F.lit("\t".join(ALT_ALLELE_COLUMNS) + "\n"), "lines").alias("value"))


def fasta_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FASTA_SQL, part=table(spark, sf_dir, "part"))
