"""DuckDB SQL with the expected result of every deterministic query."""

from __future__ import annotations

import math

from . import fixtures as fx


# Spelled out here once more, so that a wrong value in the package does not pass on both sides.
SINGLE_ALT_GENOTYPES = ("0/1", "1/0", "1/1", "0|1", "1|0", "1|1", "0/2", "0|2", "2/0", "2|0", "1", "2")
TWO_ALT_GENOTYPES = ("1/2", "1|2", "2/1", "2|1")
ALT_ALLELE_COLUMNS = (
    "location", "sample_id", "ref", "allele", "allele_pos", "call_GT", "call_GQ", "as_raw_mq", "raw_mq", "as_raw_mqranksum",
    "qual", "as_raw_readposranksum", "as_sb_table", "call_AD", "ref_ad", "ad",
)
NOISE_TAGS = (
    "bin", "spike", "offset_any", "offset_known", "snp", "qual_radius", "qual_angle", "refad_radius", "refad_angle",
    "ad_radius", "ad_angle", "gq_radius", "gq_angle", "block_slot", "block_item", "bin_slot", "bin_item",
)
MODY_GENES = (
    "ABCC8", "APPL1", "BLK", "CEL", "GCK", "HNF1A", "HNF1B", "HNF4A", "INS", "KCNJ11",
    "KLF11", "NEUROD1", "PAX4", "PDX1",
)


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RAW = fx.RAW_VARIANTS_SQL.replace("{lineitem}", "lineitem")
_VAT = fx.VAT_SQL.replace(
    "{part_transcripts}",
    "part CROSS JOIN (SELECT true AS is_canonical_transcript UNION ALL SELECT true UNION ALL SELECT false) t",
)
_INFO = fx.SAMPLE_INFO_SQL.replace("{customer}", "customer")
_DRAWS = fx.DRAWS_SQL.replace("{lineitem}", "lineitem")
_FASTA = fx.FASTA_SQL.replace("{part}", "part")

_POSITIONS = f"""
SELECT r.*, t.pos AS pos, split(r.alt, ',')[t.pos] AS a FROM raw r, unnest(
  CASE WHEN call_GT IN {_in(TWO_ALT_GENOTYPES)} THEN [1, 2]
       WHEN call_GT IN {_in(SINGLE_ALT_GENOTYPES)} THEN [1] ELSE [] END) t(pos)"""

_CUT = """CASE WHEN a IS NOT NULL THEN
  len(list_filter(range(1, least(length(ref), length(a))), lambda i: right(ref, i) = right(a, i))) END"""


def _whole(text: str) -> str:
    return f"CAST(trunc(TRY_CAST({text} AS DOUBLE)) AS BIGINT)"


_AA = f"""
SELECT location, sample_id, left(ref, length(ref) - k) AS ref, left(a, length(a) - k) AS allele,
  CAST(pos AS INTEGER) AS allele_pos, call_GT, call_GQ, as_raw_mq,
  TRY_CAST(split(as_raw_mq, '|')[pos + 1] AS BIGINT) AS raw_mq, as_raw_mqranksum,
  {_whole("split(as_qualapprox, '|')[pos]")} AS qual, as_raw_readposranksum, as_sb_table,
  call_AD, {_whole("split(call_AD, ',')[1]")} AS ref_ad,
  {_whole("split(call_AD, ',')[pos + 1]")} AS ad
FROM (SELECT *, {_CUT} AS k FROM (SELECT * FROM positions))"""

_LOCATED = """(CASE split(v.contig, 'r')[2] WHEN 'X' THEN 23 WHEN 'Y' THEN 24
  ELSE TRY_CAST(split(v.contig, 'r')[2] AS BIGINT) END) * 1000000000000 + v.position"""

_CANON = """
SELECT DISTINCT vid, contig, position, ref_allele, alt_allele, gvs_all_sc FROM vat"""
_PATHO = f"""is_canonical_transcript
  AND array_to_string(clinvar_classification, '.') LIKE '%athogenic%'
  AND array_to_string(clinvar_classification, '.') NOT LIKE '%benign%'
  AND gene_symbol IN {_in(MODY_GENES)}"""

_IDS = "array_to_string(list_sort({}), ',') AS sample_ids"
_LIST = "list(sample_id) FILTER (WHERE sample_id IS NOT NULL)"
_COND = f"SELECT location, ref, allele, {_LIST} AS ids FROM {{}} GROUP BY ALL"


def _noise(tag: str) -> str:
    i = NOISE_TAGS.index(tag)
    mixed = f"(draw_no % 1000003) * {7919 + 1217 * i} + sample_id * {104729 + 331 * i}"
    return f"(CAST(({mixed}) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE))"


def _normal(tag: str) -> str:
    radius = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {_noise(tag + '_radius')}))"
    return f"({radius} * cos({2.0 * math.pi!r}::DOUBLE * {_noise(tag + '_angle')}))"


def _metric(tag: str) -> str:
    return f"CAST(round_even(avg_{tag} + {_normal(tag)} * stddev_{tag}, 0) AS BIGINT)"


_STATS_RAW = "SELECT location - location % 10000 AS location_bin, count(*) AS entries, " + ", ".join(
    f"avg({c}) AS avg_{m}, stddev_samp({c}) AS stddev_{m}"
    for m, c in (("qual", "qual"), ("refad", "ref_ad"), ("ad", "ad"), ("gq", "call_GQ"))
) + " FROM aa GROUP BY ALL"
_METRICS = [f"{k}_{m}" for m in ("qual", "refad", "ad", "gq") for k in ("avg", "stddev")]
_STATS = "SELECT location_bin, entries, " + ", ".join(
    f"coalesce({c}, 5.0::DOUBLE) AS {c}" for c in _METRICS
) + " FROM stats_raw"
_STATS_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in _METRICS)

_UNIT = fx.GENOME_UNIT
_BASE = f"substr('{_UNIT}', CAST({{}} % 100 + 1 AS INTEGER), 1)"

# Named parts of the statements; each is put in front of the parts that use it.
_PARTS = {
    "raw": (_RAW, ()),
    "vat": (_VAT, ()),
    "info": (_INFO, ()),
    "draws": (_DRAWS, ()),
    "fasta": (_FASTA, ()),
    "positions": (_POSITIONS, ("raw",)),
    "aa": (_AA, ("positions",)),
    "hold": ("SELECT DISTINCT sample_id FROM aa ORDER BY sample_id LIMIT 2", ("aa",)),
    "old": ("SELECT * FROM aa WHERE sample_id NOT IN (SELECT sample_id FROM hold)", ("hold",)),
    "fresh": ("SELECT * FROM aa WHERE sample_id IN (SELECT sample_id FROM hold)", ("hold",)),
    "cond": (_COND.format("aa"), ("aa",)),
    "cond_old": (_COND.format("old"), ("old",)),
    "cond_new": (_COND.format("fresh"), ("fresh",)),
    "merged": (
        """SELECT location, ref, allele, CASE WHEN max(ids) FILTER (WHERE fresh) IS NULL OR max(ids) FILTER (WHERE NOT fresh) IS NULL
             THEN max(ids) ELSE list_distinct(flatten(list(ids))) END AS ids
           FROM (SELECT *, false AS fresh FROM cond_old UNION ALL SELECT *, true AS fresh FROM cond_new) GROUP BY ALL""",
        ("cond_old", "cond_new"),
    ),
    "v": (_CANON + f" WHERE {_PATHO}", ("vat",)),
    "v_brca": (
        """SELECT DISTINCT vid, contig, position, ref_allele, alt_allele,
           array_to_string(consequence, ', ') AS consequence_str, gvs_all_sc FROM vat
           WHERE is_canonical_transcript AND gene_symbol = 'BRCA1'
             AND list_has_any(consequence, ['stop_gained', 'frameshift_variant'])""",
        ("vat",),
    ),
    "weights": (
        "SELECT location - location % 100 AS location, count(*) AS weight FROM aa GROUP BY ALL",
        ("aa",),
    ),
    "cdf": (
        "SELECT location, weight, CAST(sum(weight) OVER (ORDER BY location) AS BIGINT) AS cw FROM weights",
        ("weights",),
    ),
    "tot": ("SELECT CAST(sum(weight) AS BIGINT) AS total FROM weights", ("weights",)),
    "part_cdf": (
        """SELECT cdf.* FROM cdf, tot
           WHERE CAST(cw AS DOUBLE) / CAST(total AS DOUBLE) BETWEEN 0.25::DOUBLE AND 0.55::DOUBLE""",
        ("cdf", "tot"),
    ),
    "over_cdf": (
        """SELECT cdf.* FROM cdf, tot WHERE CAST(cw AS DOUBLE) > 0.25::DOUBLE * CAST(total AS DOUBLE)
           AND CAST(cw - weight AS DOUBLE) <= 0.55::DOUBLE * CAST(total AS DOUBLE)""",
        ("cdf", "tot"),
    ),
    "stats_raw": (_STATS_RAW, ("aa",)),
    "stats": (_STATS, ("stats_raw",)),
    "bitmaps": (
        """SELECT location - location % 100 AS bin, count(*) AS entries,
           bit_or(CASE WHEN location % 100 < 50 THEN 1::BIGINT << CAST(location % 50 AS INTEGER) ELSE 0 END) AS low_bits,
           bit_or(CASE WHEN location % 100 >= 50 THEN 1::BIGINT << CAST(location % 50 AS INTEGER) ELSE 0 END) AS high_bits,
           list_sort(list_distinct(list(location % 100))) AS known
           FROM aa GROUP BY ALL""",
        ("aa",),
    ),
    "spikes": (
        """SELECT bin, location, allele, CAST(n AS DOUBLE) / CAST(alln AS DOUBLE) AS percentage FROM (
           SELECT *, sum(n) OVER (PARTITION BY bin) AS alln,
             row_number() OVER (PARTITION BY bin ORDER BY n DESC, location, allele DESC) AS r
           FROM (SELECT location - location % 100 AS bin, location, allele, count(*) AS n FROM aa GROUP BY ALL))
           WHERE r = 1""",
        ("aa",),
    ),
    "picked": (
        f"""SELECT d.sample_id, d.draw_no, d.u, c.location AS bucket, c.cw, c.weight
           FROM (SELECT draws.*, least(CAST(floor({_noise('bin')} * total) AS BIGINT) + 1, total) AS u
                 FROM draws, tot) d ASOF JOIN cdf c ON d.u <= c.cw""",
        ("draws", "cdf", "tot"),
    ),
    "sliced": (
        f"""SELECT d.sample_id, d.draw_no, c.location AS bucket
           FROM (SELECT draws.*, least(CAST(floor((0.25::DOUBLE + {_noise('bin')} * {0.55 - 0.25!r}::DOUBLE) * total) AS BIGINT) + 1, total) AS u
                 FROM draws, tot) d ASOF JOIN over_cdf c ON d.u <= c.cw""",
        ("draws", "over_cdf", "tot"),
    ),
}


def _alias(items: str) -> str:
    """Alias tables by range joins over the running sums of lacks and excesses, for rows of g, bin and w."""
    return f"""
WITH i AS ({items}),
s AS (SELECT g, bin, count(*) OVER (PARTITION BY g) AS n, sum(w) OVER (PARTITION BY g) AS total,
        row_number() OVER (PARTITION BY g ORDER BY bin) - 1 AS slot, w FROM i),
o AS (SELECT *, w * n - total AS o FROM s),
r AS (SELECT *, sum(greatest(o, 0)) OVER x AS e, sum(greatest(-o, 0)) OVER x AS d FROM o WINDOW x AS (PARTITION BY g ORDER BY bin))
SELECT g AS block, CAST(slot AS BIGINT) AS slot, bin, CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total,
  CAST(CASE WHEN o > 0 THEN total - coalesce((SELECT min(l.d) FROM r l WHERE l.g = r.g AND l.o <= 0 AND l.d > r.e) - e, 0) ELSE w * n END AS BIGINT) AS threshold,
  coalesce((SELECT min(h.bin) FROM r h WHERE h.g = r.g AND h.o > 0 AND h.e > CASE WHEN r.o > 0 THEN r.e ELSE r.d + r.o END), bin) AS other
FROM r"""


_PARTS["alias_bins"] = (_alias("SELECT location // 1000 AS g, location AS bin, weight AS w FROM weights"), ("weights",))
_PARTS["alias_blocks"] = (
    _alias("SELECT 0 AS g, location // 1000 AS bin, CAST(sum(weight) AS BIGINT) AS w FROM weights GROUP BY ALL"), ("weights",)
)


def _candidates(picked: str) -> str:
    return f"""
SELECT p.sample_id, p.draw_no, p.bucket, s.location AS spike_location, s.allele AS spike_allele,
  coalesce({_noise('spike')} < s.percentage, false) AS spiked,
  CAST(floor({_noise('offset_any')} * 100) AS INTEGER) AS offset_any,
  CAST(b.known[CAST(floor({_noise('offset_known')} * len(b.known)) AS INTEGER) + 1] AS INTEGER) AS offset_known
FROM {picked} p LEFT JOIN spikes s ON s.bin = p.bucket LEFT JOIN bitmaps b ON b.bin = p.bucket"""


def _based(candidates: str) -> str:
    return f"""
SELECT *, lower({_BASE.format('(bucket + offset_any)')}) AS base_any,
  lower({_BASE.format('(bucket + offset_known)')}) AS base_known,
  lower({_BASE.format('spike_location')}) AS base_spike FROM {candidates}"""


def _rows(based: str) -> str:
    return f"""
SELECT d.sample_id, d.draw_no, spiked,
  CASE WHEN spiked THEN spike_location
       WHEN e IS NULL OR d.draw_no <= e THEN bucket + offset_any ELSE bucket + offset_known END AS location,
  CASE WHEN spiked THEN base_spike
       WHEN e IS NULL OR d.draw_no <= e THEN base_any ELSE base_known END AS base,
  spike_allele
FROM {based} d LEFT JOIN (
  SELECT DISTINCT sample_id, draw_no AS e FROM (
    SELECT sample_id, draw_no, row_number() OVER (PARTITION BY sample_id ORDER BY draw_no) AS r
    FROM {based} WHERE spiked OR base_any IN ('g', 'a', 't', 'c')) WHERE r = 100) w USING (sample_id)"""


_ALLELE = f"""CASE WHEN spiked THEN spike_allele ELSE
  CASE CAST(floor({_noise('snp')} * 6) AS INTEGER) + 1
    WHEN 5 THEN translate(base, 'agct', 'ccaa') WHEN 6 THEN translate(base, 'agct', 'ttgg')
    ELSE translate(base, 'agct', 'gatc') END END"""


def _calls(rows: str) -> str:
    return f"""
SELECT location, sample_id, upper(base) AS ref, upper({_ALLELE}) AS allele, 1 AS allele_pos,
  '0/1' AS call_GT, least(greatest({_metric('gq')}, 1), 100) AS call_GQ,
  CAST(NULL AS VARCHAR) AS as_raw_mq, CAST(NULL AS BIGINT) AS raw_mq,
  CAST(NULL AS VARCHAR) AS as_raw_mqranksum, greatest({_metric('qual')}, 0) AS qual,
  CAST(NULL AS VARCHAR) AS as_raw_readposranksum, CAST(NULL AS VARCHAR) AS as_sb_table,
  greatest({_metric('refad')}, 1) || ',' || greatest({_metric('ad')}, 1) AS call_AD,
  greatest({_metric('refad')}, 1) AS ref_ad, greatest({_metric('ad')}, 1) AS ad
FROM {rows} r JOIN stats s ON s.location_bin = r.location - r.location % 10000
WHERE spiked OR base IN ('g', 'a', 't', 'c')"""


_PARTS["candidates"] = (_candidates("picked"), ("picked", "spikes", "bitmaps"))
_PARTS["based"] = (_based("candidates"), ("candidates",))
_PARTS["rows_made"] = (_rows("based"), ("based",))
_PARTS["calls"] = (_calls("rows_made"), ("rows_made", "stats"))
_PARTS["candidates_cut"] = (_candidates("sliced"), ("sliced", "spikes", "bitmaps"))
_PARTS["based_cut"] = (_based("candidates_cut"), ("candidates_cut",))
_PARTS["rows_cut"] = (_rows("based_cut"), ("based_cut",))
_PARTS["calls_cut"] = (_calls("rows_cut"), ("rows_cut", "stats"))
_PARTS["placed_any"] = (
    f"""SELECT p.sample_id, p.draw_no, p.bucket + CAST(floor({_noise('offset_any')} * 100) AS INTEGER) AS location
        FROM picked p""",
    ("picked",),
)


def _sql(body: str, *parts: str) -> str:
    """The body behind the parts it names and all that those need."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _PARTS[name][1]:
            need(other)
        if name not in order:
            order.append(name)

    for part in parts:
        need(part)
    listed = ", ".join(f"{name} AS ({_PARTS[name][0]})" for name in order)
    return f"WITH {listed} {body}" if order else body


_ALL = ", ".join(ALT_ALLELE_COLUMNS)
_RANGE = "location > 1000000010007 AND location < 1000000010200"
_WIDE = "location > 1000000010007 AND location < 1000000010400"
_COND_TEXT = f"location, ref, allele, {_IDS.format('ids')}"
_EXPANDED = _sql(f"SELECT {_ALL} FROM aa", "aa")
_CONDENSED = _sql(f"SELECT {_COND_TEXT} FROM cond", "cond")
_MERGED = _sql(f"SELECT {_COND_TEXT} FROM merged", "merged")
# The distinct carriers of a variant, which know nothing of words or blocks.
_CARRIERS = _sql(
    """SELECT location, ref, allele, array_to_string(list_sort(list(DISTINCT sample_id)), ',') AS sample_ids FROM aa GROUP BY ALL""", "aa"
)
_GENE_COUNTS = _sql("SELECT gene_symbol, count(*) AS n FROM vat GROUP BY ALL", "vat")
_RANGE_COUNT = _sql(f"SELECT count(*) AS n FROM aa WHERE {_RANGE}", "aa")
_VAT_TEXT = """vid, contig, position, ref_allele, alt_allele, is_canonical_transcript, gene_symbol,
 coalesce(array_to_string(clinvar_classification, ';'), '') AS clinvar, array_to_string(consequence, ';') AS consequences, gvs_all_sc"""
_RAW_ALL = "location, sample_id, ref, alt, call_GT, call_GQ, as_raw_mq, as_raw_mqranksum, as_qualapprox, as_raw_readposranksum, as_sb_table, call_AD"
_COHORT = _sql(
    f"""SELECT DISTINCT aa.sample_id FROM v, aa WHERE v.ref_allele = aa.ref AND v.alt_allele = aa.allele
        AND {_LOCATED} = aa.location AND aa.call_GQ >= 20 AND aa.ref_ad + aa.ad > 20""",
    "v", "aa",
)
_BRCA = _sql(
    f"""SELECT aa.sample_id FROM v_brca v, aa WHERE v.ref_allele = aa.ref AND v.alt_allele = aa.allele
        AND {_LOCATED} = aa.location""",
    "v_brca", "aa",
)
_CHUNK_100 = """SELECT contig, CAST(c * 100 AS BIGINT) AS chunk_start,
  substr('N' || bases, CAST(c * 100 + 1 AS BIGINT), 100) AS bases
  FROM fasta, unnest(range(0, (length(bases) // 100) + 1)) t(c)"""


_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def oracle_sql() -> dict[str, str]:
    return {
        # sources and sinks
        "scan_parquet_dir": "SELECT * FROM lineitem",
        "file_manifest": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _TABLES),
        "scan_table": _EXPANDED,
        "scan_tsv": _sql("SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in ALT_ALLELE_COLUMNS) + " FROM aa", "aa"),
        "scan_gzip_csv": _sql("SELECT location, weight FROM weights", "weights"),
        "scan_block_gzip_csv": _sql("SELECT location, weight FROM weights", "weights"),
        "scan_bucket_stats": _sql(f"SELECT location_bin, entries, {_STATS_ROUNDED} FROM stats", "stats"),
        "scan_spikes": _sql("SELECT bin, location, allele, percentage FROM spikes", "spikes"),
        "scan_bitmaps": _sql("SELECT bin, entries, low_bits, high_bits FROM bitmaps", "bitmaps"),
        "scan_fasta": _sql(_CHUNK_100, "fasta"),
        "write_table": _EXPANDED,
        "replace_table": _EXPANDED,
        "write_clustered": _EXPANDED,
        "compact_recluster": _EXPANDED,
        "write_z_ordered": _EXPANDED,
        "z_ordered_sample": _sql(f"SELECT {_ALL} FROM aa WHERE sample_id = 41", "aa"),
        "z_ordered_range": _sql(f"SELECT {_ALL} FROM aa WHERE {_RANGE}", "aa"),
        "z_ordered_annotation": _sql(f"SELECT {_VAT_TEXT} FROM vat WHERE gene_symbol IN {_in(MODY_GENES)}", "vat"),
        "path_roundtrip": _CONDENSED,
        "write_sample_tsv": _EXPANDED,
        # projections, filters, predicates
        "reorder_columns": _sql(f"SELECT {_VAT_TEXT} FROM vat", "vat"),
        "project_columns": _sql(f"SELECT location, {_IDS.format('ids')} FROM cond", "cond"),
        "cast_columns": _sql(
            "SELECT location, sample_id, ref, allele, CAST(allele_pos AS BIGINT) AS allele_pos, call_GQ, qual, ref_ad, ad FROM aa", "aa"
        ),
        "filter_single_alt_gt": _sql(f"SELECT {_RAW_ALL} FROM raw WHERE call_GT IN {_in(SINGLE_ALT_GENOTYPES)}", "raw"),
        "filter_two_alt_gt": _sql(f"SELECT {_RAW_ALL} FROM raw WHERE call_GT IN {_in(TWO_ALT_GENOTYPES)}", "raw"),
        "range_count": _RANGE_COUNT,
        "range_count_condensed": _sql(f"SELECT count(*) AS n FROM cond WHERE {_RANGE}", "cond"),
        "range_count_stored": _RANGE_COUNT,
        "range_count_stored_condensed": _sql(f"SELECT count(*) AS n FROM cond WHERE {_RANGE}", "cond"),
        "gene_filter_stored": _sql(f"SELECT {_VAT_TEXT} FROM vat WHERE gene_symbol IN {_in(MODY_GENES)}", "vat"),
        "range_select": _sql(f"SELECT {_ALL} FROM aa WHERE {_RANGE}", "aa"),
        "range_select_wide": _sql(f"SELECT {_ALL} FROM aa WHERE {_WIDE}", "aa"),
        "range_select_condensed": _sql(f"SELECT {_COND_TEXT} FROM cond WHERE {_RANGE}", "cond"),
        "filter_sample": _sql(f"SELECT {_ALL} FROM aa WHERE sample_id = 41", "aa"),
        "member_of_set": _sql("SELECT location, ref, allele FROM merged WHERE list_contains(ids, 1)", "merged"),
        "member_of_set_indexed": _sql("SELECT DISTINCT location, ref, allele FROM aa WHERE sample_id = 1", "aa"),
        "postings_in_range": _sql(f"SELECT DISTINCT location, ref, allele FROM aa WHERE sample_id = 1 AND {_RANGE}", "aa"),
        "shared_variants": _sql(
            """SELECT location, ref, allele FROM aa WHERE sample_id IN (1, 2) GROUP BY ALL HAVING count(DISTINCT sample_id) = 2""", "aa"
        ),
        "posting_counts": _sql(
            """SELECT sample_id, CAST(sum(n) AS BIGINT) AS variants, count(*) AS windows FROM (
               SELECT sample_id, location // 16384 AS w, count(DISTINCT {'l': location, 'r': ref, 'a': allele}) AS n FROM aa GROUP BY ALL)
               GROUP BY sample_id""", "aa"
        ),
        "canonical_filter": _sql(f"SELECT {_VAT_TEXT} FROM vat WHERE is_canonical_transcript", "vat"),
        "clinvar_filter": _sql(
            f"""SELECT {_VAT_TEXT} FROM vat WHERE array_to_string(clinvar_classification, '.') LIKE '%athogenic%'
                AND array_to_string(clinvar_classification, '.') NOT LIKE '%benign%'""", "vat"
        ),
        "gene_filter": _sql(f"SELECT {_VAT_TEXT} FROM vat WHERE gene_symbol IN {_in(MODY_GENES)}", "vat"),
        "consequence_overlap": _sql(
            f"SELECT {_VAT_TEXT} FROM vat WHERE list_has_any(consequence, ['stop_gained', 'frameshift_variant'])", "vat"
        ),
        "consequence_overlap_masked": _sql(
            f"SELECT {_VAT_TEXT} FROM vat WHERE list_has_any(consequence, ['stop_gained', 'frameshift_variant'])", "vat"
        ),
        "clinvar_filter_masked": _sql(
            f"""SELECT {_VAT_TEXT} FROM vat WHERE array_to_string(clinvar_classification, '.') LIKE '%athogenic%'
                AND array_to_string(clinvar_classification, '.') NOT LIKE '%benign%'""", "vat"
        ),
        "call_quality_filter": _sql(f"SELECT {_ALL} FROM aa WHERE call_GQ >= 20 AND ref_ad + ad > 20", "aa"),
        "sample_status_filter": _sql("SELECT * FROM info WHERE withdrawn IS NULL AND is_control IS FALSE", "info"),
        "empty_check": _sql("SELECT 'alt_allele' AS table_name, (SELECT count(*) FROM aa) = 0 AS is_empty", "aa"),
        # allele expansion
        "minimize_alleles": _sql(
            f"""SELECT location, sample_id, ref, a AS alt_allele, left(ref, length(ref) - {_CUT}) AS min_ref,
                left(a, length(a) - {_CUT}) AS min_allele FROM positions""", "positions"
        ),
        "minimize_text": _sql(
            f"""SELECT location, sample_id, left(ref, length(ref) - {_CUT}) || ',' || left(a, length(a) - {_CUT}) AS pair
                FROM positions""", "positions"
        ),
        "expand_alt_alleles": _EXPANDED,
        "pick_alt": _sql("SELECT location, sample_id, alt, CAST(pos AS INTEGER) AS allele_pos, a AS picked FROM positions", "positions"),
        "pick_raw_mq": _sql(
            """SELECT location, sample_id, as_raw_mq, CAST(pos AS INTEGER) AS allele_pos,
               TRY_CAST(split(as_raw_mq, '|')[pos + 1] AS BIGINT) AS raw_mq FROM positions""", "positions"
        ),
        "pick_qual": _sql(
            f"""SELECT location, sample_id, as_qualapprox, CAST(pos AS INTEGER) AS allele_pos,
               {_whole("split(as_qualapprox, '|')[pos]")} AS qual FROM positions""", "positions"
        ),
        "pick_depths": _sql(
            f"""SELECT location, sample_id, call_AD, {_whole("split(call_AD, ',')[1]")} AS ref_ad,
               {_whole("split(call_AD, ',')[pos + 1]")} AS ad FROM positions""", "positions"
        ),
        "pass_through": _sql(
            """SELECT location, sample_id, call_GT, call_GQ, as_raw_mq, as_raw_mqranksum, as_raw_readposranksum,
               as_sb_table, call_AD FROM aa""", "aa"
        ),
        "calls_per_genotype": _sql("SELECT allele_pos, call_GT, count(*) AS n FROM aa GROUP BY ALL", "aa"),
        # joins
        "variant_allele_join": _COHORT,
        "variant_allele_join_bucketed": _COHORT,
        "bucketed_rows": _EXPANDED,
        "variant_sample_join": _sql(
            f"""SELECT DISTINCT si.sample_name FROM v, aa, info si WHERE v.ref_allele = aa.ref
                AND v.alt_allele = aa.allele AND {_LOCATED} = aa.location AND aa.sample_id = si.sample_id
                AND si.withdrawn IS NULL AND si.is_control IS FALSE AND aa.call_GQ >= 20 AND aa.ref_ad + aa.ad > 20""",
            "v", "aa", "info",
        ),
        "holdout_anti": _sql(f"SELECT {_ALL} FROM old", "old"),
        "holdout_inner": _sql(f"SELECT {_ALL} FROM fresh", "fresh"),
        "exists_subquery": _BRCA,
        "nearest_bucket": _sql("SELECT sample_id, draw_no, u, bucket, cw, weight FROM picked", "picked"),
        "spike_lookup": _sql(
            """SELECT w.location AS bucket, weight, s.location AS spike_location, s.allele AS spike_allele,
               s.percentage AS spike_share FROM weights w LEFT JOIN (SELECT * FROM spikes WHERE percentage >= 0.5) s
               ON s.bin = w.location""", "weights", "spikes"
        ),
        "bitmap_lookup": _sql(
            "SELECT w.location AS bucket, weight, low_bits, high_bits FROM weights w JOIN bitmaps b ON b.bin = w.location",
            "weights", "bitmaps",
        ),
        "bins_without_bitmap": _sql(
            """SELECT location AS bucket, weight FROM weights WHERE location NOT IN
               (SELECT bin FROM bitmaps WHERE high_bits <> 0)""", "weights", "bitmaps"
        ),
        "reference_base_lookup": _sql(
            f"SELECT location, sample_id, allele, {_BASE.format('location')} AS ref_base FROM aa", "aa"
        ),
        "reference_base_lookup_packed": _sql(
            f"SELECT location, sample_id, allele, {_BASE.format('location')} AS ref_base FROM aa", "aa"
        ),
        "stats_lookup": _sql(
            f"SELECT location, sample_id, {_STATS_ROUNDED} FROM aa JOIN stats s ON s.location_bin = aa.location - aa.location % 10000",
            "aa", "stats",
        ),
        "slice_semi": _sql(
            """SELECT bin, entries, low_bits, high_bits FROM bitmaps WHERE bin - bin % 10000 IN
               (SELECT location - location % 10000 FROM part_cdf)""", "bitmaps", "part_cdf"
        ),
        # aggregations
        "condense": _CONDENSED,
        "condense_one_call": _sql(
            f"""SELECT location, ref, allele, array_to_string(list_sort(list(sample_id)), ',') AS sample_ids
                FROM (SELECT DISTINCT location, ref, allele, sample_id FROM aa) GROUP BY ALL""", "aa"
        ),
        "condense_blocks": _sql(
            """SELECT location, ref, allele, sample_id // 10 AS sample_block,
               array_to_string(list_sort(list(sample_id * 1000000 + calls)), ',') AS carriers FROM (
               SELECT location, ref, allele, sample_id, count(*) AS calls FROM aa GROUP BY ALL) GROUP BY ALL""", "aa"
        ),
        "condense_bitmap": _CARRIERS,
        "carrier_total": _sql("SELECT location, ref, allele, count(DISTINCT sample_id) AS carriers FROM aa GROUP BY ALL", "aa"),
        "carrier_counts": _sql("SELECT location, ref, allele, sample_id, count(*) AS calls FROM aa GROUP BY ALL", "aa"),
        "count_rows": _sql("SELECT count(*) AS n FROM aa", "aa"),
        "gene_counts": _GENE_COUNTS,
        "classification_counts": _sql(
            """SELECT coalesce(array_to_string(clinvar_classification, ';'), 'none') AS classification, count(*) AS n
               FROM vat GROUP BY ALL""", "vat"
        ),
        "distinct_variants": _sql(_CANON, "vat"),
        "distinct_variants_with_consequence": _sql("SELECT * FROM v_brca", "v_brca"),
        "distinct_samples": _sql("SELECT DISTINCT sample_id FROM aa", "aa"),
        "total_weight": _sql("SELECT total AS total_weight FROM tot", "tot"),
        # merge, set operations, sort, limit
        "merge_upsert": _MERGED,
        "merge_small_batch": _MERGED,
        # Calls per variant and sample, which know nothing of the merge or of its blocks.
        "merge_blocks": _sql(
            """SELECT location, ref, allele, sample_id // 10 AS sample_block,
               array_to_string(list_sort(list(sample_id * 1000000 + calls)), ',') AS carriers FROM (
               SELECT location, ref, allele, sample_id, count(*) AS calls FROM aa GROUP BY ALL) GROUP BY ALL""", "aa"
        ),
        "merge_bitmap": _CARRIERS,
        "merge_bitmap_batch": _CARRIERS,
        "bitmap_with_sample": _sql("SELECT DISTINCT location, ref, allele FROM aa WHERE sample_id = 1", "aa"),
        "union_all": _EXPANDED,
        "union_positional": _EXPANDED,
        "sample_limit": _sql("SELECT sample_id FROM hold", "hold"),
        "first_row": _sql(
            "SELECT location, ref, allele FROM merged WHERE list_contains(ids, (SELECT min(sample_id) FROM hold))", "merged"
        ),
        # window-shaped
        "cumulative_weight": _sql("SELECT location, weight, cw FROM cdf", "cdf"),
        "weight_slice": _sql("SELECT location, weight, cw FROM part_cdf", "part_cdf"),
        # scalar functions
        "encode_location": _sql(f"SELECT v.contig, v.position, {_LOCATED} AS location FROM vat v", "vat"),
        "encode_location_mito": _sql(
            """SELECT contig, position, (CASE split(lower(contig), 'r')[2] WHEN 'x' THEN 23 WHEN 'y' THEN 24
               WHEN 'm' THEN 25 ELSE TRY_CAST(split(lower(contig), 'r')[2] AS BIGINT) END) * 1000000000000 + position
               AS location FROM vat""", "vat"
        ),
        "decode_location": _sql(
            """SELECT location, 'chr' || CASE location // 1000000000000 WHEN 23 THEN 'X' WHEN 24 THEN 'Y'
               WHEN 25 THEN 'M' ELSE CAST(location // 1000000000000 AS VARCHAR) END AS contig,
               location % 1000000000000 AS pos FROM raw""", "raw"
        ),
        "bitmap_offsets": _sql("SELECT bin, array_to_string(known, ',') AS offsets FROM bitmaps", "bitmaps"),
        "bitmap_text": _sql(
            """SELECT bin, lpad(to_binary(high_bits), 50, '0') || lpad(to_binary(low_bits), 50, '0') AS bits
               FROM bitmaps""", "bitmaps"
        ),
        "round_half_even": "SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2.0::DOUBLE, 0) AS BIGINT) AS rounded FROM lineitem",
        "clamp_values": "SELECT l_orderkey, l_linenumber, least(greatest(CAST(l_quantity AS BIGINT) - 10, 1), 30) AS bounded FROM lineitem",
        "parse_or_default": _sql(
            "SELECT location, sample_id, coalesce(TRY_CAST(split(as_raw_mq, '|')[2] AS DOUBLE), 5.0::DOUBLE) AS parsed FROM raw", "raw"
        ),
        "lenient_cast": """SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS BIGINT) AS whole,
            CAST(NULL AS BIGINT) AS unreadable FROM lineitem""",
        "depth_pair": _sql("SELECT location, sample_id, concat_ws(',', ref_ad, ad) AS pair FROM aa", "aa"),
        "letter_case": _sql("SELECT vid, lower(ref_allele) AS low, upper(contig) AS up FROM vat", "vat"),
        "sql_functions": _sql(
            f"""SELECT location, sample_id, left(ref, length(ref) - {_CUT}) || ',' || left(a, length(a) - {_CUT}) AS pair,
                location % 1000000000000 AS pos FROM positions""", "positions"
        ),
        "sql_range_count": _RANGE_COUNT,
        "sql_range_rows": _sql(f"SELECT {_ALL} FROM aa WHERE {_RANGE}", "aa"),
        "sql_gene_counts": _GENE_COUNTS,
        "sql_cohort": _COHORT,
        "table_function_range": _sql(f"SELECT {_ALL} FROM aa WHERE {_RANGE}", "aa"),
        "table_function_gene": _sql(_CANON + " WHERE is_canonical_transcript AND gene_symbol = 'BRCA1'", "vat"),
        "table_function_cohort": _COHORT,
        # generator model and steps
        "model_weights": _sql("SELECT location, weight FROM weights", "weights"),
        "model_stats": _sql(f"SELECT location_bin, entries, {_STATS_ROUNDED} FROM stats_raw", "stats_raw"),
        "model_bitmaps": _sql("SELECT bin, entries, low_bits, high_bits FROM bitmaps", "bitmaps"),
        "model_spikes": _sql("SELECT bin, location, allele, percentage FROM spikes", "spikes"),
        "model_bins": _sql(
            """SELECT b.bin, b.entries, low_bits, high_bits, location, allele, percentage
               FROM bitmaps b JOIN spikes s ON s.bin = b.bin""", "bitmaps", "spikes"
        ),
        "model_bins_updated": _sql(
            """SELECT b.bin, b.entries, low_bits, high_bits, location, allele, percentage
               FROM bitmaps b JOIN spikes s ON s.bin = b.bin""", "bitmaps", "spikes"
        ),
        "model_stats_updated": _sql(f"SELECT location_bin, entries, {_STATS_ROUNDED} FROM stats_raw", "stats_raw"),
        "gen_draws": _sql("SELECT sample_id, count(*) AS draws, count(*) AS last_draw FROM draws GROUP BY ALL", "draws"),
        "gen_pick_bin": _sql("SELECT sample_id, draw_no, bucket FROM picked", "picked"),
        "alias_tables": _sql("SELECT block, slot, bin, threshold, other, n, total FROM alias_bins", "alias_bins"),
        "alias_shares": _sql(
            """SELECT location AS bin, CAST(weight * count(*) OVER (PARTITION BY location // 1000) AS BIGINT) AS held FROM weights""", "weights"
        ),
        "gen_pick_bin_alias": _sql(
            f"""SELECT sample_id, draw_no, CASE WHEN floor({_noise('bin_item')} * b.total) < b.threshold THEN b.bin ELSE b.other END AS bucket
                FROM (SELECT d.*, CASE WHEN floor({_noise('block_item')} * t.total) < t.threshold THEN t.bin ELSE t.other END AS block
                      FROM draws d JOIN alias_blocks t ON t.slot = least(floor({_noise('block_slot')} * t.n), t.n - 1)) r
                JOIN alias_bins b ON b.block = r.block AND b.slot = least(floor({_noise('bin_slot')} * b.n), b.n - 1)""",
            "draws", "alias_blocks", "alias_bins",
        ),
        "gen_spike": _sql("SELECT sample_id, draw_no, bucket, spiked, spike_location, spike_allele FROM candidates", "candidates"),
        "gen_offset": _sql("SELECT sample_id, draw_no, bucket, offset_any, offset_known FROM candidates", "candidates"),
        "gen_snp": _sql(
            f"""SELECT sample_id, draw_no, location, base, {_ALLELE} AS allele FROM (SELECT *, false AS spiked,
                CAST(NULL AS VARCHAR) AS spike_allele, lower({_BASE.format('location')}) AS base FROM placed_any)
                WHERE base IN ('g', 'a', 't', 'c')""", "placed_any"
        ),
        "gen_valid_base": _sql(
            f"""SELECT base IN ('g', 'a', 't', 'c') AS allowed, base, count(*) AS n FROM (
                SELECT lower({_BASE.format('location')}) AS base FROM placed_any) GROUP BY ALL""", "placed_any"
        ),
        "gen_metrics": _sql(
            f"""SELECT sample_id, draw_no, {_metric('qual')} AS qual, {_metric('refad')} AS ref_ad, {_metric('ad')} AS ad,
                {_metric('gq')} AS gq FROM placed_any r JOIN stats s ON s.location_bin = r.location - r.location % 10000""",
            "placed_any", "stats",
        ),
        "gen_clamp": _sql(
            f"""SELECT sample_id, draw_no, greatest({_metric('qual')}, 0) AS qual, greatest({_metric('refad')}, 1) AS ref_ad,
                greatest({_metric('ad')}, 1) AS ad, least(greatest({_metric('gq')}, 1), 100) AS gq
                FROM placed_any r JOIN stats s ON s.location_bin = r.location - r.location % 10000""",
            "placed_any", "stats",
        ),
        "gen_row": _sql(f"SELECT {_ALL} FROM calls", "calls"),
        "gen_row_updated_model": _sql("SELECT location, sample_id, ref, allele, allele_pos, call_GT FROM calls", "calls"),
        "gen_load": _sql(f"SELECT {_ALL} FROM calls", "calls"),
        "load_checked": _sql(f"SELECT {_ALL} FROM aa WHERE sample_id % 10 NOT IN (3, 5, 7, 8)", "aa"),
        "load_rejected": _sql(
            """SELECT reason, count(*) AS n FROM (SELECT unnest(CASE sample_id % 10 WHEN 3 THEN ['location: missing']
                 WHEN 5 THEN ['qual: not a number', 'ad: not a number'] ELSE ['line: number of fields'] END) AS reason
               FROM aa WHERE sample_id % 10 IN (3, 5, 7, 8)) GROUP BY ALL""", "aa"
        ),
        "load_account": _sql(
            """SELECT 'read' AS rows, count(*) AS n FROM aa
               UNION ALL SELECT 'loaded', count(*) FROM aa WHERE sample_id % 10 NOT IN (3, 5, 7, 8)
               UNION ALL SELECT 'rejected', count(*) FROM aa WHERE sample_id % 10 IN (3, 5, 7, 8)""", "aa"
        ),
        "gen_slice": _sql(f"SELECT {_ALL} FROM calls_cut", "calls_cut"),
        "gen_random": _sql(
            "SELECT DISTINCT sample_id, true AS in_bins, true AS bounded, true AS same_again FROM draws", "draws"
        ),
        "fit_gbt": _sql("SELECT count(*) AS n, count(DISTINCT alt) AS labels, true AS better_than_the_mean FROM raw", "raw"),
        # learning and streaming
        "assemble_features": _sql(
            """SELECT location, sample_id, CAST(dense_rank() OVER (ORDER BY ref) - 1 AS DOUBLE) AS ref_index,
               CAST(dense_rank() OVER (ORDER BY alt) - 1 AS DOUBLE) AS alt_index,
               CAST(location AS DOUBLE) AS location_feature FROM raw""", "raw"
        ),
        "ingest_stream_repeats": _sql(
            f"SELECT location, ref, allele, {_IDS.format('list_distinct(ids)')} FROM cond", "cond"
        ),
        "ingest_stream": _sql(
            f"SELECT location, ref, allele, {_IDS.format('list_distinct(ids)')} FROM cond", "cond"
        ),
    }
