"""Allele text: picking alternates and dropping the bases that ref and allele end with."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


# Suffixes up to this length are compared one by one in generated code.
_SHORT = 8


def shared_suffix(ref: Column, allele: Column) -> Column:
    """How many trailing bases to drop so that one base is left on both sides at least.

    Most alleles differ in their last bases or are a base long, and are settled by the first
    comparisons. Longer suffixes are found by binary search, as equality of the last i bases is
    monotone in i: a pair of long alleles costs log2(length) comparisons.
    """
    longest = F.least(F.length(ref), F.length(allele)) - 1

    def ends_at(i: int) -> Column:
        return (longest == i) | (F.right(ref, F.lit(i + 1)) != F.right(allele, F.lit(i + 1)))

    # least() skips NULL, so a missing side is told apart first.
    missing = ref.isNull() | allele.isNull()
    result = F.when(missing, F.lit(None).cast("int")).when((longest < 1) | ends_at(0), F.lit(0))
    for i in range(1, _SHORT):
        result = result.when(ends_at(i), F.lit(i))
    return result.otherwise(_searched_suffix(ref, allele, longest))


def _searched_suffix(ref: Column, allele: Column, longest: Column) -> Column:
    top_bit = F.length(F.bin(longest)) - 1
    steps = F.transform(
        F.sequence(top_bit, F.lit(0), F.lit(-1)),
        lambda b: F.call_function("shiftleft", F.lit(1), b),
    )

    def widen(found: Column, step: Column) -> Column:
        wider = found + step
        fits = (wider <= longest) & (F.right(ref, wider) == F.right(allele, wider))
        return F.when(fits, wider).otherwise(found)

    return F.aggregate(steps, F.lit(0), widen)


def drop_suffix(text: Column, cut: Column) -> Column:
    """The text without its last ``cut`` characters."""
    return F.left(text, F.length(text) - cut)


def minimize(ref: Column, allele: Column) -> Column:
    """Struct of ref and allele without their shared suffix; NULL fields if either is NULL."""
    cut = shared_suffix(ref, allele)
    return F.struct(
        drop_suffix(ref, cut).alias("ref"), drop_suffix(allele, cut).alias("allele")
    )


def minimize_text(ref: Column, allele: Column) -> Column:
    """``minimize`` as one ``ref,allele`` text."""
    pair = minimize(ref, allele)
    return F.concat(pair["ref"], F.lit(","), pair["allele"])


def comma_item(text: Column, pos: Column | int) -> Column:
    """Element of a comma list, counted from 1; NULL out of range."""
    return F.try_element_at(F.split(text, ","), _index(pos))


def pipe_item(text: Column, pos: Column | int) -> Column:
    """Element of a pipe list, counted from 1; NULL out of range."""
    return F.try_element_at(F.split(text, r"\|"), _index(pos))


def _index(pos: Column | int) -> Column:
    return pos if isinstance(pos, Column) else F.lit(pos)
