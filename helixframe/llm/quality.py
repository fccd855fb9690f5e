"""Quality rules: lines are judged first, and a text that loses too much with them is rejected.

Everything is a column expression over one row, so there is no shuffle and no group.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Lines
without a word are neither judged nor lost. Repeated rows are judged each for itself. Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import SPACE, WORD, text_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A text is rejected when its failed lines hold more than this share of its characters.
MAX_LOST_PERCENT = 30
BOILERPLATE_WORDS = 30

# Line patterns, in the common part of Java's and RE2's syntax.
ENDS_SENTENCE = r"""[.!?:;…。！？"'”’»)\]]""" + SPACE + "*$"
HAS_SENTENCE = r"[.!?…。！？]" + SPACE
SHOUT = r"[!?]{2,}"
SYMBOL = r"[#*$%&|<>]"
SEPARATOR = SPACE + r"[|»›>·•]" + SPACE
NAVIGATION = (
    r"(?i)^" + SPACE + r"*(home|menu|log ?in|sign ?(in|up|out)|register|search|next|previous|back|"
    r"back to top|contact( us)?|about( us)?|site ?map|help|faq|skip to (main )?content|read more|"
    r"share( this)?|subscribe|follow us)" + SPACE + "*$"
)
BOILERPLATE = (
    r"(?i)all rights reserved|licen[sc]ed under|released under the|copyright (©|\(c\)|[0-9]{4})|"
    r"terms of (use|service)|privacy policy|(uses?|cookie) (cookies|policy)|enable javascript|lorem ipsum"
)


def line_fails(line: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for one line."""
    words = F.regexp_count(line, F.lit(WORD))
    unpunctuated = ~line.rlike(ENDS_SENTENCE) & ~line.rlike(HAS_SENTENCE)
    shouting = F.regexp_count(line, F.lit(SHOUT)) * 3 > words
    symbols = F.regexp_count(line, F.lit(SYMBOL)) * 2 > words
    navigation = (F.regexp_count(line, F.lit(SEPARATOR)) >= 3) | line.rlike(NAVIGATION)
    boilerplate = (words <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE)
    return unpunctuated | shouting | symbols | navigation | boilerplate


def _repeat_words() -> Column:
    """Words inside a 3-word window that the text has twice or more.

    Windows are compared by 64-bit hashes. Where all differ, which one pass tells, nothing is
    sorted; else hashes are sorted with their positions, and each window whose neighbour has the
    same hash covers its words up to the next such window.
    """
    sorted_ = "sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i)))"
    repeated = f"""
        transform(array({sorted_}), s -> sort_array(transform(
            filter(s, (x, k) -> (k > 0 AND get(s, k - 1).h = x.h) OR (k < size(s) - 1 AND get(s, k + 1).h = x.h)),
            x -> x.i)))[0]"""
    covered = f"""
        transform(array({repeated}), p -> aggregate(
            transform(p, (x, k) -> if(k < size(p) - 1, least(3, get(p, k + 1) - x), 3)),
            0L, (a, x) -> a + x))[0]"""
    return F.expr(f"CASE WHEN size(_h) = size(array_distinct(_h)) THEN 0L ELSE {covered} END")


def line_first(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, the verdict, the cleaned text and the characters lost.

    ``clean_text`` is the text without its failed lines.
    """
    base = docs.select("doc_id", text_of().alias("_t"))
    split = base.select(
        "doc_id",
        "_t",
        F.filter(F.split("_t", SPACE + "+"), lambda w: w != "").alias("_w"),
        F.split("_t", "\n").alias("_all"),
    )
    lines = split.select(
        "doc_id",
        "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter("_all", lambda x: x.rlike(WORD)).alias("_lines"),
        F.transform("_all", lambda x: F.struct(x.alias("l"), (x.rlike(WORD) & line_fails(x)).alias("bad"))).alias("_judged"),
        F.expr(
            "CASE WHEN size(_w) < 3 THEN array() ELSE transform(sequence(0, size(_w) - 3),"
            " i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END"
        ).cast("array<bigint>").alias("_h"),
    )
    counted = lines.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
        F.char_length(F.array_join("_lines", "")).cast("long").alias("line_chars"),
        F.expr("char_length(array_join(transform(filter(_judged, x -> x.bad), x -> x.l), ''))").cast("long").alias("lost_chars"),
        F.expr("array_join(transform(filter(_judged, x -> NOT x.bad), x -> x.l), '\n')").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fair = 100 * F.col("lost_chars") <= MAX_LOST_PERCENT * F.col("line_chars")
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & fair)


REPORT = (
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "base_failed", "kept", "lost_chars",
)


def report(docs: DataFrame) -> DataFrame:
    return line_first(docs).select(*REPORT)


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def oracle() -> str:
    word, space = _sql_text(WORD), _sql_text(SPACE + "+")

    def count(pattern: str) -> str:
        return f"len(regexp_extract_all(l, {_sql_text(pattern)}))"

    def has(pattern: str) -> str:
        return f"regexp_matches(l, {_sql_text(pattern)})"

    fails = (
        f"(NOT {has(ENDS_SENTENCE)} AND NOT {has(HAS_SENTENCE)}) OR {count(SHOUT)} * 3 > {count(WORD)}"
        f" OR {count(SYMBOL)} * 2 > {count(WORD)} OR {count(SEPARATOR)} >= 3 OR {has(NAVIGATION)}"
        f" OR ({count(WORD)} <= {BOILERPLATE_WORDS} AND {has(BOILERPLATE)})"
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT rid, doc_id, t, regexp_extract_all(t, {word}) AS w,
                 list_filter(string_split(t, chr(10)), lambda l: {has(WORD)}) AS lines FROM d),
    wins AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
             FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
    rep AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM wins) WHERE c > 1),
    cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
    c AS (SELECT doc_id, len(w)::BIGINT AS n_words,
            length(regexp_replace(t, {space}, '', 'g'))::BIGINT AS word_chars,
            len(regexp_extract_all(t, {_sql_text(SYMBOL)}))::BIGINT AS n_symbols,
            (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
            coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
            length(array_to_string(lines, ''))::BIGINT AS line_chars,
            length(array_to_string(list_filter(lines, lambda l: {fails}), ''))::BIGINT AS lost_chars
          FROM w LEFT JOIN cov USING (rid))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
      (NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
        AND 100 * lost_chars <= {MAX_LOST_PERCENT} * line_chars) AS kept, lost_chars
    FROM c"""
