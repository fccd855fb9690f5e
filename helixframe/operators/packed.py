"""A reference genome with two bits a base.

A chunk is a list of 64-bit words of 32 bases each. What two bits can't say stands beside them as
intervals: masked (lower-case) bases, and runs of a letter that is no base, such as N. A chunk takes a
quarter of its text, and a base is a shift away from its word. For lookups the intervals are laid out
by word once per chunk, so that a row looks at one word and never at a list of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..constants import STATS_BIN
from ..functions.numbers import floor_to, int_div
from .joins import join_measured

BASES = "ACGT"
WORD_BASES = 32


def _runs(text: Column, pattern: str, wanted) -> Column:
    """Start, stop and letter of the runs that a pattern with two branches parts a text into, if wanted."""
    pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    empty = F.lit(None).cast("struct<at:int,found:array<struct<start:int,stop:int,letter:string>>>")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int,letter:string>>").alias("found"))

    def add(so_far: Column, piece: Column) -> Column:
        stop = so_far["at"] + F.length(piece)
        run = F.struct(so_far["at"].alias("start"), stop.alias("stop"), F.substring(piece, 1, 1).alias("letter"))
        found = F.when(wanted(piece), F.concat(so_far["found"], F.array(run))).otherwise(so_far["found"])
        return F.struct(stop.alias("at"), found.alias("found"))

    return F.when(text.isNotNull(), F.aggregate(pieces, begin, add)["found"]).otherwise(empty["found"])


def packed_genome(chunks: DataFrame) -> DataFrame:
    """Pack the column ``bases`` of chunks; other columns stay.

    Adds length, words, masked (start and stop of lower-case runs, from 0) and unknown (with the letter).
    """
    text = F.col("bases")
    upper = F.upper(text)
    digits = F.translate(F.regexp_replace(upper, f"[^{BASES}]", BASES[0]), BASES, "0123")
    count = int_div(F.length(text) + (WORD_BASES - 1), WORD_BASES)
    piece = lambda i: F.rpad(F.substring(F.col("_digits"), i * WORD_BASES + 1, F.lit(WORD_BASES)), WORD_BASES, "0")
    # A negative base of the result reads the 64 bits as a signed number.
    word = lambda i: F.conv(piece(i), 4, -10).cast("bigint")
    words = F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(0), (F.col("_count") - 1).cast("int")), word))
    masked = _runs(text, r"(\p{Ll}+|\P{Ll}+)", lambda p: p.rlike(r"^\p{Ll}"))
    unknown = _runs(upper, rf"([{BASES}]+|([^{BASES}])\2*)", lambda p: ~p.rlike(f"^[{BASES}]"))
    others = [c for c in chunks.columns if c != "bases"]
    prepared = chunks.withColumns({"_digits": digits, "_count": count})
    return prepared.select(
        *others, F.length(text).alias("length"),
        F.coalesce(words, F.array().cast("array<bigint>")).alias("words"),
        F.transform(masked, lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("stop"))).alias("masked"),
        unknown.alias("unknown"),
    )


def _laid_out(runs: Column, letter, filler: str) -> Column:
    """The runs as one text with a letter per base, fillers in the gaps between them."""

    def part(run: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(runs, i)["stop"])
        return F.concat(F.repeat(F.lit(filler), run["start"] - before), F.repeat(letter(run), run["stop"] - run["start"]))

    return F.array_join(F.transform(runs, part), "")


def by_word(packed: DataFrame) -> DataFrame:
    """Packed chunks with masked bits and unknown letters by word, in place of the intervals.

    ``masked_bits`` has the first base of a word highest, like the words; ``letters`` is NULL for a word
    without unknown bases, and elsewhere has a base's letter in the places that are known.
    """
    known = BASES[0]
    numbers = F.sequence(F.lit(0), F.size("words") - 1)
    piece = lambda name, i: F.substring(F.col(name), i * WORD_BASES + 1, F.lit(WORD_BASES))
    bits = lambda i: F.conv(F.rpad(piece("_masked", i), WORD_BASES, "0"), 2, 10).cast("bigint")
    letters = lambda i: F.when(F.translate(piece("_unknown", i), known, "") != "", piece("_unknown", i))
    texts = packed.withColumns(
        {
            "_masked": _laid_out(F.col("masked"), lambda r: F.lit("1"), "0"),
            "_unknown": _laid_out(F.col("unknown"), lambda r: r["letter"], known),
        }
    )
    per_word = {name: F.when(F.size("words") > 0, F.transform(numbers, f)) for name, f in (("masked_bits", bits), ("letters", letters))}
    return texts.withColumns(per_word).drop("_masked", "_unknown", "masked", "unknown")


def base_at(offset: Column) -> Column:
    """The base at an offset of a row of ``by_word``; NULL outside the chunk."""
    number = (int_div(offset, WORD_BASES) + 1).cast("int")
    place = (offset % WORD_BASES).cast("int")
    right = lambda word, by: F.call_function("shiftright", word, by)
    code = right(F.try_element_at("words", number), 2 * (WORD_BASES - 1) - 2 * place).bitwiseAND(F.lit(3)).cast("int")
    base = F.substring(F.lit(BASES), code + 1, F.lit(1))
    letter = F.substring(F.try_element_at("letters", number), place + 1, F.lit(1))
    found = F.when(F.coalesce(letter, F.lit("")).isin("", BASES[0]), base).otherwise(letter)
    masked = right(F.try_element_at("masked_bits", number), WORD_BASES - 1 - place).bitwiseAND(F.lit(1)) == 1
    shown = F.when(masked, F.lower(found)).otherwise(found)
    return F.when((offset >= 0) & (offset < F.col("length")), shown)


def packed_base_lookup(rows: DataFrame, packed: DataFrame, chunk: int = STATS_BIN) -> DataFrame:
    """Attach the genome base at each row's location from packed chunks with a column ``location`` (an action on the chunks).

    The chunks that the rows' genome has are measured, and broadcast when they are small.
    """
    side = by_word(packed.select(F.col("location").alias("_chunk"), "length", "words", "masked", "unknown"))
    keyed = rows.withColumn("_chunk", floor_to(F.col("location"), chunk))
    joined = join_measured(keyed, side, ["_chunk"]).withColumn("_offset", F.col("location") - F.col("_chunk"))
    return joined.select(*rows.columns, base_at(F.col("_offset")).alias("ref_base"))


def unpacked_genome(packed: DataFrame) -> DataFrame:
    """The chunks with their text again."""
    others = [c for c in packed.columns if c not in ("length", "words", "masked", "unknown")]
    packed = by_word(packed)
    each = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda o: base_at(o.cast("bigint")))
    text = F.when(F.col("length") > 0, F.array_join(each, "")).otherwise(F.when(F.col("length") == 0, ""))
    return packed.select(*others, text.alias("bases"))
