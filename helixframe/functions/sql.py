"""The same functions and questions under names for SQL users."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from ..constants import BENIGN_TEXT, CONTIG_FACTOR, MODY_GENES, PATHOGENIC_TEXT
from ..schemas import ALT_ALLELE

# The longest shared suffix by binary search, as in alleles.shared_suffix: equality of the last i
# bases is monotone in i. One base stays on both sides.
_CUT = """aggregate(
  transform(sequence(30, 0, -1), b -> shiftleft(1, b)), 0,
  (found, step) -> if(found + step < least(length(ref), length(allele))
    AND right(ref, found + step) = right(allele, found + step), found + step, found))"""

_DEFINITIONS = (
    f"""CREATE OR REPLACE TEMPORARY FUNCTION minimize(ref STRING, allele STRING) RETURNS STRING
       RETURN transform(array({_CUT}), cut -> concat(left(ref, length(ref) - cut), ',',
         left(allele, length(allele) - cut)))[0]""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION encode_location(contig STRING, pos BIGINT)
       RETURNS BIGINT RETURN try_add(try_multiply(CASE try_element_at(split(contig, 'r'), 2)
         WHEN 'X' THEN 23 WHEN 'Y' THEN 24
         ELSE try_cast(try_element_at(split(contig, 'r'), 2) AS BIGINT) END, {CONTIG_FACTOR}), pos)""",
    f"""CREATE OR REPLACE TEMPORARY FUNCTION decode_location(loc BIGINT)
       RETURNS STRUCT<contig: STRING, pos: BIGINT> RETURN named_struct('contig',
         concat('chr', CASE loc div {CONTIG_FACTOR} WHEN 23 THEN 'X' WHEN 24 THEN 'Y'
           WHEN 25 THEN 'M' ELSE CAST(loc div {CONTIG_FACTOR} AS STRING) END),
         'pos', loc % {CONTIG_FACTOR})""",
)


def register(spark: SparkSession) -> None:
    """Define minimize, encode_location and decode_location in this session."""
    for text in _DEFINITIONS:
        spark.sql(text)


_CALLS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ALT_ALLELE.fields)
_VARIANTS = "vid string, contig string, position bigint, ref_allele string, alt_allele string, gvs_all_sc bigint"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_questions(spark: SparkSession, calls: str, vat: str, genes: Iterable[str] = MODY_GENES, prefix: str = "") -> None:
    """Define the range, gene and cohort questions as table functions over named tables or views.

    * ``calls_in_range(low, high)``: calls with ``low < location < high``
    * ``variants_of_gene(gene)``: distinct variants of a gene's canonical transcript
    * ``pathogenic_carriers(min_gq, min_depth)``: samples with a well-supported pathogenic variant in the genes

    They are inlined where they are called, so filters reach the scans. ``prefix`` is put before the
    names, for several sets of tables in one session.
    """
    register(spark)
    calls, vat = (".".join(f"`{part}`" for part in name.split(".")) for name in (calls, vat))
    text = "concat_ws('.', clinvar_classification)"
    listed = ", ".join(map(_quoted, genes))
    bodies = {
        "calls_in_range(low BIGINT, high BIGINT)": (
            _CALLS,
            f"SELECT {', '.join(ALT_ALLELE.names)} FROM {calls} WHERE location > low AND location < high",
        ),
        "variants_of_gene(gene STRING)": (
            _VARIANTS,
            f"""SELECT DISTINCT vid, contig, position, ref_allele, alt_allele, gvs_all_sc FROM {vat}
                WHERE is_canonical_transcript AND gene_symbol = gene""",
        ),
        "pathogenic_carriers(min_gq BIGINT, min_depth BIGINT)": (
            "sample_id bigint",
            f"""SELECT DISTINCT c.sample_id FROM {calls} c JOIN (
                  SELECT DISTINCT encode_location(contig, position) AS location, ref_allele, alt_allele FROM {vat}
                  WHERE is_canonical_transcript AND {text} LIKE '%{PATHOGENIC_TEXT}%' AND {text} NOT LIKE '%{BENIGN_TEXT}%'
                    AND gene_symbol IN ({listed})) v
                ON c.location = v.location AND c.ref = v.ref_allele AND c.allele = v.alt_allele
                WHERE c.call_GQ >= min_gq AND c.ref_ad + c.ad > min_depth""",
        ),
    }
    for signature, (columns, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{signature} RETURNS TABLE ({columns}) RETURN {body}")
