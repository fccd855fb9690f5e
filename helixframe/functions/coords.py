"""A genomic position as one whole number: contig number * 10^12 + position."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import CONTIG_FACTOR, CONTIG_M, CONTIG_X, CONTIG_Y
from .numbers import int_div, parse_long


def contig_number(contig: Column, mito: bool = False) -> Column:
    """Number of a contig such as ``chr7`` or ``chrX``; NULL when it has none.

    ``mito`` ignores letter case and also accepts M.
    """
    tag = F.try_element_at(F.split(F.lower(contig) if mito else contig, "r"), F.lit(2))
    named = {"X": CONTIG_X, "Y": CONTIG_Y}
    if mito:
        named = {"x": CONTIG_X, "y": CONTIG_Y, "m": CONTIG_M}
    number = F.lit(None).cast("bigint")
    for letter, value in named.items():
        number = F.when(tag == letter, F.lit(value).cast("bigint")).otherwise(number)
    return F.coalesce(number, parse_long(tag))


def encode_location(contig: Column, position: Column, mito: bool = False) -> Column:
    """Location of a position; NULL when the contig has no number."""
    base = F.try_multiply(contig_number(contig, mito), F.lit(CONTIG_FACTOR))
    return F.try_add(base, position.cast("bigint"))


def decode_location(location: Column) -> Column:
    """Struct of contig name and position."""
    number = int_div(location, CONTIG_FACTOR)
    name = (
        F.when(number == CONTIG_X, "X")
        .when(number == CONTIG_Y, "Y")
        .when(number == CONTIG_M, "M")
        .otherwise(number.cast("string"))
    )
    return F.struct(
        F.concat(F.lit("chr"), name).alias("contig"),
        (location % F.lit(CONTIG_FACTOR)).alias("pos"),
    )
