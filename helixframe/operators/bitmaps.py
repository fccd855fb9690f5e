"""Carriers of a variant as bitmaps over sample ids.

Bits are set in 64-bit words by ``bit_or`` per variant and word, which is combined map-side and
needs no list, however many carriers a variant has. Stored are blocks: a row per variant and
``BLOCK_SAMPLES`` sample ids with a map from word number to word, empty words left out. A rare variant
takes a few bytes, a hot one at most ``BLOCK_SAMPLES`` / 64 words a row, and a merge is an OR of two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import VARIANT_KEYS
from ..session import pin
from .joins import MAX_BROADCAST_BYTES, measured_bytes

WORD_BITS = 64
BLOCK_SAMPLES = 32_768
_WORD_SHIFT = WORD_BITS.bit_length() - 1
BLOCK_KEYS = [*VARIANT_KEYS, "sample_block"]
BITMAP_BLOCKS = "location bigint, ref string, allele string, sample_block bigint, words map<int, bigint>"


def _word(sample_id: Column) -> Column:
    """Word number of a sample; shifts, so that negative ids have words of their own."""
    return F.shiftright(sample_id, _WORD_SHIFT)


def _bit(sample_id: Column) -> Column:
    position = sample_id.bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _words_per_block(block_samples: int) -> int:
    if block_samples < WORD_BITS or block_samples & (block_samples - 1):
        raise ValueError("a block holds a power of two of samples, 64 at least")
    return block_samples // WORD_BITS


def carrier_words(alt_allele: DataFrame) -> DataFrame:
    """One row per variant and word of 64 sample ids: word number and bits. NULL ids are left out."""
    known = alt_allele.where(F.col("sample_id").isNotNull())
    return known.groupBy(*VARIANT_KEYS, _word(F.col("sample_id")).alias("word")).agg(
        F.bit_or(_bit(F.col("sample_id"))).alias("bits")
    )


def _blocks_of(words: DataFrame, block_samples: int) -> DataFrame:
    per_block = _words_per_block(block_samples)
    shift = per_block.bit_length() - 1
    inside = F.col("word").bitwiseAND(F.lit(per_block - 1)).cast("int")
    # At most ``per_block`` entries meet in a row.
    entries = F.map_from_entries(F.collect_list(F.struct(inside, "bits")))
    keyed = words.withColumn("sample_block", F.shiftright("word", shift))
    return keyed.groupBy(*BLOCK_KEYS).agg(entries.alias("words"))


def condense_bitmap(alt_allele: DataFrame, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """One row per variant and block of sample ids, with the block's bitmap.

    A variant whose calls all lack a sample has no row; repeated calls set one bit.
    """
    return _blocks_of(carrier_words(alt_allele), block_samples)


def _ored(a: Column, b: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    either = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, zero).bitwiseOR(F.coalesce(y, zero)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(either)


def _theirs(df: DataFrame, *columns: Column) -> tuple[DataFrame, Column, dict[str, str]]:
    """A side with its keys renamed, the null-safe equality with ours, and the names."""
    names = {k: f"_{k}" for k in BLOCK_KEYS}
    same = F.lit(True)
    for key, name in names.items():
        same = same & F.col(key).eqNullSafe(F.col(name))
    return df.select(*(F.col(k).alias(n) for k, n in names.items()), *columns), same, names


def merge_bitmap(master: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two tables of one block width: blocks of both are united by OR, others are kept."""
    ours = master.select(*BLOCK_KEYS, F.col("words").alias("_old"))
    theirs, same, names = _theirs(new, F.col("words").alias("_new"))
    joined = ours.join(theirs, same, "full_outer")
    return joined.select(
        *(F.coalesce(k, n).alias(k) for k, n in names.items()), _ored(F.col("_old"), F.col("_new")).alias("words")
    )


def merge_bitmap_batch(master: DataFrame, new: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``merge_bitmap`` for a batch that is small as a rule (an action on the batch).

    Below the bound the master is not shuffled: its rows are updated in place, and the batch's
    blocks that met none are added.
    """
    batch = pin(new.select(*BLOCK_KEYS, "words"))
    if measured_bytes(batch) > max_bytes:
        return merge_bitmap(master, batch)
    ours = master.select(*BLOCK_KEYS, F.col("words").alias("_old"))
    theirs, same, names = _theirs(batch, F.col("words").alias("_new"))
    updated = ours.join(F.broadcast(theirs), same, "left").select(*BLOCK_KEYS, _ored(F.col("_old"), F.col("_new")).alias("words"))
    wanted, same, _ = _theirs(batch)
    # No more keys match than the batch has.
    met = master.select(*BLOCK_KEYS).join(F.broadcast(wanted), same, "left_semi")
    matched, same, _ = _theirs(met)
    return updated.unionByName(batch.join(F.broadcast(matched), same, "left_anti"))


def carrier_total(bitmaps: DataFrame) -> DataFrame:
    """Carriers per variant, counted in the words."""
    bits = F.aggregate(F.map_values("words"), F.lit(0).cast("bigint"), lambda n, w: n + F.bit_count(w))
    return bitmaps.groupBy(*VARIANT_KEYS).agg(F.sum(bits).alias("carriers"))


def bitmap_with_sample(bitmaps: DataFrame, sample_id: int, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """Variants that a sample carries; the block number reaches the scan."""
    word = sample_id >> _WORD_SHIFT
    per_block = _words_per_block(block_samples)
    bits = F.try_element_at("words", F.lit(word & (per_block - 1)))
    held = F.getbit(bits, F.lit(sample_id & (WORD_BITS - 1))) == 1
    return bitmaps.where((F.col("sample_block") == sample_id // block_samples) & held).select(*VARIANT_KEYS)


def carrier_rows(bitmaps: DataFrame, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """One row per variant and carrier: the bitmaps taken apart again, without gathering anything.

    Words are taken apart by bytes first: a word with one carrier makes 16 rows on the way, not 64.
    """
    others = [c for c in bitmaps.columns if c not in ("words", "sample_block")]
    words = bitmaps.select(*others, "sample_block", F.explode("words").alias("_word", "_bits"))
    numbers = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    bytes_ = words.select(*others, "sample_block", "_word", "_bits", numbers(WORD_BITS // 8).alias("_byte"))
    held = F.call_function("shiftright", F.col("_bits"), F.col("_byte") * 8).bitwiseAND(F.lit(255).cast("bigint"))
    start = F.col("sample_block") * block_samples + F.col("_word") * WORD_BITS + F.col("_byte") * 8
    bytes_ = bytes_.select(*others, held.alias("_held"), start.alias("_start")).where("_held <> 0")
    spread = bytes_.select("*", numbers(8).alias("_bit")).where(F.getbit("_held", F.col("_bit")) == 1)
    return spread.select(*others, (F.col("_start") + F.col("_bit")).alias("sample_id"))


def carrier_lists(bitmaps: DataFrame, block_samples: int = BLOCK_SAMPLES) -> DataFrame:
    """The condensed table with distinct ids, for readers that want whole lists."""
    rows = carrier_rows(bitmaps.select(*BLOCK_KEYS, "words"), block_samples)
    return rows.groupBy(*VARIANT_KEYS).agg(F.collect_list("sample_id").alias("sample_ids"))
