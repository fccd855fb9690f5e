"""Fixed values that decide results. Nothing here is computed."""

# -- Fixed values: genotype codes -------------------------------------------------------------
# Codes that yield the first alternate allele only.
SINGLE_ALT_GENOTYPES = (
    "0/1", "1/0", "1/1", "0|1", "1|0", "1|1", "0/2", "0|2", "2/0", "2|0", "1", "2",
)
# Codes that yield the first and the second alternate allele.
TWO_ALT_GENOTYPES = ("1/2", "1|2", "2/1", "2|1")

# -- Fixed values: location encoding ----------------------------------------------------------
CONTIG_FACTOR = 1_000_000_000_000
CONTIG_X = 23
CONTIG_Y = 24
CONTIG_M = 25

# -- Fixed values: bin widths of the sample generator, in bases -------------------------------
WEIGHT_BIN = 100
STATS_BIN = 10_000
BITMAP_WORD = 50

# -- Fixed values: annotation questions -------------------------------------------------------
MODY_GENES = (
    "ABCC8", "APPL1", "BLK", "CEL", "GCK", "HNF1A", "HNF1B", "HNF4A", "INS", "KCNJ11",
    "KLF11", "NEUROD1", "PAX4", "PDX1",
)
PATHOGENIC_TEXT = "athogenic"
BENIGN_TEXT = "benign"
MIN_CALL_GQ = 20
MIN_DEPTH = 20

# -- Fixed values: base changes of the sample generator ---------------------------------------
TRANSITIONS = {"a": "g", "g": "a", "c": "t", "t": "c"}
TRANSVERSIONS_1 = {"a": "c", "g": "c", "c": "a", "t": "a"}
TRANSVERSIONS_2 = {"a": "t", "g": "t", "c": "g", "t": "g"}
ALLOWED_BASES = ("g", "a", "t", "c")
FAKE_GENOTYPE = "0/1"
MISSING_STAT = 5.0
WARMUP_ROWS = 100
MAX_GQ = 100
DEFAULT_SAMPLES = 99
DEFAULT_DRAWS = 5_359_999

# -- Fixed values: column order of the expanded table -----------------------------------------
ALT_ALLELE_COLUMNS = (
    "location", "sample_id", "ref", "allele", "allele_pos", "call_GT", "call_GQ", "as_raw_mq",
    "raw_mq", "as_raw_mqranksum", "qual", "as_raw_readposranksum", "as_sb_table", "call_AD",
    "ref_ad", "ad",
)
LONG_COLUMNS = ("location", "sample_id", "allele_pos", "call_GQ", "qual", "ref_ad", "ad")
VARIANT_KEYS = ("location", "ref", "allele")
