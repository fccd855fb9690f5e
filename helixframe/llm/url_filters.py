"""URL filters: a temporal list join.

A list says, dated, which domains and URL prefixes it takes up and which it lets go. Its events
become validity intervals per key; every capture is held against the entries that were active when
it was fetched: an as-of join over all keys its URL falls under (its host and the parent domains,
its host with each directory of the path). Intervals are laid out over time slots, so the join is an
equality on key and slot plus a comparison inside the slot, and a key with a third of all captures
meets one slot's entries only. The list's side is broadcast when it measures small; else both sides
are shuffled and adaptive execution splits hot keys.

Defined results: events of one key and day count as one, and a removal wins. An entry without a
later removal stays valid. Events without key or day are left out. A capture without a URL that has
a host, or without a fetch day, matches nothing and is kept. Of several matches the longest key is
reported, the smallest among equals. Repeated captures are reported once.
Columns other than those named are not read.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..operators.joins import join_measured

SLOT_DAYS = 30
#: Scheme, then host without user and port; a port or a query ends it.
HOST = r"^(?i:[a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?i:[a-z][a-z0-9+.-]*)://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def with_keys(df: DataFrame) -> DataFrame:
    """``_keys``: every list key that covers the URL. Domains of two labels and more, host with directories."""
    split = df.withColumn("_host", F.coalesce(host_of(F.col("url")), F.lit(""))).withColumns(
        {"_labels": F.split("_host", r"\."), "_path": F.split(F.regexp_extract("url", PATH, 1), "/")}
    )
    domains = """transform(filter(sequence(1, greatest(size(_labels) - 1, 1)), i -> i < size(_labels)),
                           i -> array_join(slice(_labels, i, size(_labels)), '.'))"""
    # "/a/b/c" splits into "", "a", "b", "c": the directories are "", "a" and "a/b".
    folders = """transform(filter(sequence(1, greatest(size(_path) - 1, 1)), i -> i < size(_path)),
                           i -> concat(_host, array_join(slice(_path, 1, i), '/'), '/'))"""
    keys = F.expr(f"CASE WHEN _host <> '' THEN array_distinct(concat({domains}, {folders})) ELSE array() END")
    return split.withColumn("_keys", keys.cast("array<string>")).drop("_host", "_labels", "_path")


def intervals(events: DataFrame) -> DataFrame:
    """key, category, valid_from and valid_to (null: still valid) from key, day, action, category."""
    daily = events.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "day").agg(
        F.max("action").alias("action"), F.min("category").alias("category")
    )
    following = Window.partitionBy("key").orderBy("day")
    return (
        daily.withColumn("valid_to", F.lead("day").over(following))
        .where("action = 'add'")
        .select("key", "category", F.col("day").alias("valid_from"), "valid_to")
    )


def _slot(day: Column) -> Column:
    return F.floor(F.unix_date(day) / SLOT_DAYS).cast("int")


def evaluate(captures: DataFrame, events: DataFrame) -> DataFrame:
    """One row per capture (page_id, url, fetched): blocked, matches, and the entry that decides."""
    base = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched"))
    keyed = with_keys(base).withColumn("key", F.explode_outer("_keys")).withColumn("_slot", _slot(F.col("fetched")))
    last = base.agg(F.max("fetched")).first()[0]
    if last is None:  # no capture has a day, so none meets an interval
        last = datetime.date(1970, 1, 1)
    ends = F.least(F.date_sub(F.coalesce("valid_to", F.date_add(F.lit(last), 1)), 1), F.lit(last))
    laid = (
        intervals(events)
        .where(F.col("valid_from") <= F.lit(last))
        .withColumn("_slot", F.explode(F.sequence(_slot(F.col("valid_from")), _slot(ends))))
    )
    met = join_measured(keyed, laid, ["key", "_slot"], "left")
    active = (F.col("valid_from") <= F.col("fetched")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    # The longest key, the smallest among equals: by negated length.
    best = F.min(F.when(active, F.struct((-F.length("key")).alias("n"), "key", "valid_from", "category")))
    out = met.groupBy("page_id", "url", "fetched").agg(best.alias("_best"))
    return out.select(
        "page_id",
        host_of(F.coalesce("url", F.lit(""))).alias("host"),
        "fetched",
        F.col("_best").isNotNull().alias("blocked"),
        F.col("_best.key").alias("entry"),
        F.col("_best.category").alias("category"),
        F.col("_best.valid_from").alias("listed"),
    )


# The tables have URLs only. Days and lists are derived from them.

FIRST_DAY = "2024-01-01"


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages fetched over a year, by their id."""
    day = F.expr(f"date_add(DATE'{FIRST_DAY}', cast(pmod(page_id, 366) AS int))")
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_events(pages: DataFrame) -> DataFrame:
    """A sixteenth of all keys the URLs fall under, listed on some day; some let go, some listed again."""
    keys = with_keys(pages.select("url")).select(F.explode("_keys").alias("key")).distinct()
    value = F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int")
    listed = keys.withColumn("v", value).where("v % 16 = 0").withColumn("v", F.expr("v div 16"))
    day = lambda extra: F.expr(f"date_add(DATE'{FIRST_DAY}', cast(v % 300 + {extra} AS int))")
    event = lambda extra, action: F.struct(day(extra).alias("day"), F.lit(action).alias("action"))
    events = F.array(
        event(0, "add"),
        F.when(F.col("v") % 3 == 0, event(60, "remove")),
        F.when(F.col("v") % 9 == 0, event(105, "add")),
    )
    category = F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("v") % 3 + 1).cast("int"))
    return listed.select("key", category.alias("category"), F.explode(events).alias("e")).where("e IS NOT NULL").select(
        "key", "e.day", "e.action", "category"
    )


def report(pages: DataFrame) -> DataFrame:
    return evaluate(derived_captures(pages), derived_events(pages))


def oracle() -> str:
    return rf"""
    WITH c AS (SELECT DISTINCT page_id, url, DATE '{FIRST_DAY}' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS fetched,
                 coalesce(lower(regexp_extract(url, '{HOST}', 1)), '') AS host,
                 string_split(coalesce(lower(regexp_extract(url, '{HOST}', 1)), ''), '.') AS labels,
                 string_split(coalesce(regexp_extract(url, '{PATH}', 1), ''), '/') AS path FROM pages),
    k AS (SELECT DISTINCT page_id, url, fetched, host, key FROM (
            SELECT page_id, url, fetched, host, array_to_string(labels[i:len(labels)], '.') AS key
            FROM (SELECT *, unnest(range(1, len(labels))) AS i FROM c WHERE host <> '')
            UNION ALL
            SELECT page_id, url, fetched, host, host || array_to_string(path[1:i], '/') || '/' AS key
            FROM (SELECT *, unnest(range(1, len(path))) AS i FROM c WHERE host <> ''))),
    v AS (SELECT key, v // 16 AS v FROM (SELECT key, ('0x' || substr(md5(key), 1, 6))::BIGINT AS v
                                         FROM (SELECT DISTINCT key FROM k)) WHERE v % 16 = 0),
    e AS (SELECT key, v % 3 AS g, DATE '{FIRST_DAY}' + CAST(v % 300 AS INTEGER) AS day, 'add' AS action FROM v
          UNION ALL SELECT key, v % 3, DATE '{FIRST_DAY}' + CAST(v % 300 + 60 AS INTEGER), 'remove' FROM v WHERE v % 3 = 0
          UNION ALL SELECT key, v % 3, DATE '{FIRST_DAY}' + CAST(v % 300 + 105 AS INTEGER), 'add' FROM v WHERE v % 9 = 0),
    m AS (SELECT k.page_id, k.url, k.fetched, k.key, e.g, e.day FROM k ASOF JOIN e ON k.key = e.key AND k.fetched >= e.day
          WHERE e.action = 'add'),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC, key) = 1)
    SELECT c.page_id, c.host, c.fetched, b.key IS NOT NULL AS blocked, b.key AS entry,
           ['adult', 'malware', 'spam'][b.g + 1] AS category, b.day AS listed
    FROM c LEFT JOIN b ON c.page_id IS NOT DISTINCT FROM b.page_id AND c.url IS NOT DISTINCT FROM b.url"""
