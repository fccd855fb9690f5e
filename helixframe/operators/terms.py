"""Lists of terms as bit sets: a dictionary gives each term a bit, a row keeps one mask column per 63 terms.

Overlap with a question's terms, and the pathogenic label, are then tests of whole numbers; the lists
are not read. The dictionary belongs to the stored table: a list that is loaded later may only use its
terms, others are found by ``unknown_terms`` and added at the end, which leaves earlier masks right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import BENIGN_TEXT, PATHOGENIC_TEXT

#: Bits of a mask; the sign stays free.
MASK_BITS = 63
#: Annotation vocabularies have some dozens of terms; a dictionary above this is something else.
MAX_TERMS = 4_096


def term_dictionary(df: DataFrame, column: str, known: Sequence[str] = ()) -> list[str]:
    """The terms of a list column in a fixed order, those already known first (an action)."""
    terms = df.select(F.explode(column).alias("term")).where("term IS NOT NULL").distinct()
    found = [r.term for r in terms.limit(MAX_TERMS + 1).collect()]
    if len(found) > MAX_TERMS:
        raise ValueError(f"{column} has more than {MAX_TERMS} terms; it is no vocabulary")
    return [*known, *sorted(set(found) - set(known))]


def unknown_terms(df: DataFrame, column: str, dictionary: Sequence[str]) -> DataFrame:
    """Terms that the dictionary lacks, with the rows that have them."""
    terms = df.select(F.explode(F.array_distinct(column)).alias("term")).where("term IS NOT NULL")
    return terms.where(~F.col("term").isin(*dictionary)).groupBy("term").agg(F.count("*").alias("n"))


def mask_names(name: str, dictionary: Sequence[str]) -> list[str]:
    """The mask columns of a dictionary; never none."""
    return [f"{name}_{i}" for i in range(max(1, -(-len(dictionary) // MASK_BITS)))]


def _masks(dictionary: Sequence[str], wanted: Callable[[str], bool]) -> list[int]:
    masks = [0] * max(1, -(-len(dictionary) // MASK_BITS))
    for i, term in enumerate(dictionary):
        if wanted(term):
            masks[i // MASK_BITS] |= 1 << i % MASK_BITS
    return masks


def with_masks(df: DataFrame, column: str, dictionary: Sequence[str], name: str) -> DataFrame:
    """Add the masks of a list column; a NULL list has NULL masks, terms outside the dictionary have no bit."""
    added = {}
    for i, mask in enumerate(mask_names(name, dictionary)):
        own = dictionary[i * MASK_BITS : (i + 1) * MASK_BITS]
        bits = [F.when(F.array_contains(column, F.lit(t)), F.lit(1 << b)).otherwise(F.lit(0)).cast("bigint") for b, t in enumerate(own)]
        total = F.lit(0).cast("bigint")
        for bit in bits:
            total = total.bitwiseOR(bit)
        added[mask] = F.when(F.col(column).isNotNull(), total)
    return df.withColumns(added)


def _meets(name: str, dictionary: Sequence[str], masks: list[int]) -> Column:
    met = F.lit(False)
    for column, mask in zip(mask_names(name, dictionary), masks):
        if mask:
            met = met | (F.col(column).bitwiseAND(F.lit(mask)) != 0)
    return met


def has_any(name: str, dictionary: Sequence[str], terms: Iterable[str]) -> Column:
    """Whether a row has one of the terms."""
    asked = set(terms)
    return _meets(name, dictionary, _masks(dictionary, lambda t: t in asked))


def labelled_pathogenic(name: str, dictionary: Sequence[str]) -> Column:
    """Whether a term says pathogenic and none says benign; the dictionary is searched once, not each row."""
    bad = _meets(name, dictionary, _masks(dictionary, lambda t: PATHOGENIC_TEXT in t))
    good = _meets(name, dictionary, _masks(dictionary, lambda t: BENIGN_TEXT in t))
    return bad & ~good
