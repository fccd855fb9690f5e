"""Text and array predicates of the annotation table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..constants import BENIGN_TEXT, PATHOGENIC_TEXT


def joined(items: Column, separator: str) -> Column:
    """Array of text as one text; NULL elements are left out and a NULL array is empty."""
    return F.concat_ws(separator, items)


def is_pathogenic(classification: Column) -> Column:
    """Some label says pathogenic and no label says benign; letter case matters."""
    text = joined(classification, ".")
    return text.contains(PATHOGENIC_TEXT) & ~text.contains(BENIGN_TEXT)


def shares_term(items: Column, terms: Iterable[str]) -> Column:
    """The array holds at least one of the terms."""
    return F.arrays_overlap(items, F.array(*(F.lit(t) for t in terms)))


def depth_pair(ref_depth: Column, allele_depth: Column) -> Column:
    """The two depths as ``ref,allele`` text."""
    return F.concat_ws(",", ref_depth.cast("string"), allele_depth.cast("string"))
