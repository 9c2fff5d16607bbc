"""Line dedup by site-relative frequency.

Pages are grouped by host; a line that stands on more than a given share of its
host's pages is boilerplate and is dropped from all of them. Lines are compared
after white space is collapsed and trimmed; blank lines are neither counted nor
kept. Everything here is DataFrame code on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A line on more than this share of its host's pages is dropped, on hosts with so many pages at least.
RATIO, LEAST_PAGES = 0.3, 5
#: Hosts with at least this share of all pages may be broadcast with their lines, if those are at most so many.
HOT_SHARE, MAX_BROADCAST_LINES = 1 / 2000, 500_000


def host_of(url: Column) -> Column:
    """The host in lower case, without user and port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def html_text(html: Column) -> Column:
    """Scripts and styles go; inline tags go; other tags and comments end a line."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>", "\n")
    text = F.regexp_replace(text, r"(?i)</?(a|b|i|em|strong|span|small|u)( [^>]*)?>", "")
    return F.regexp_replace(text, r"<[^>]*>", "\n")


def lines_of(text: Column) -> Column:
    """The lines that aren't blank, white space collapsed and trimmed."""
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.filter(F.transform(F.split(spaced, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", host: Column | None = None, text: Column | None = None, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page: page_id, host, host_pages, n_lines, n_dropped, text (the lines that stay).

    host defaults to that of column url, text to the text of column html. A page
    without a host belongs to host ''. Repeated rows are pages of their own. A
    line repeated within a page counts once there and is dropped everywhere.
    """
    host = host_of(F.col("url")) if host is None else F.coalesce(host, F.lit(""))
    text = html_text(F.col("html")) if text is None else text
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), lines_of(text).alias("lines"))
    digest = lambda x: F.unhex(F.md5(x))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    counts = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", digest(F.col("line")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n"))
    # A host has few such lines: each stands on more than the ratio of its pages.
    possible = counts.filter(F.col("n") > ratio * least_pages)
    boiler = possible.join(totals, "host").filter((F.col("host_pages") >= least_pages) & (F.col("n") > ratio * F.col("host_pages")))
    lines = boiler.groupBy("host").agg(F.collect_list("line").alias("boiler"))
    hosts = written(totals.join(lines, "host", "left").select("host", "host_pages", F.coalesce("boiler", F.array().cast("array<binary>")).alias("boiler")), "hosts")

    total = hosts.agg(F.sum("host_pages")).first()[0] or 0
    hot = F.col("host_pages") >= max(1000, HOT_SHARE * total)
    held = hosts.filter(hot).agg(F.sum(F.size("boiler") + 1)).first()[0] or 0
    if 0 < held <= MAX_BROADCAST_LINES:
        joined = rows.join(F.broadcast(hosts.filter(hot)), "host").unionByName(rows.join(hosts.filter(~hot), "host"))
    else:  # the shuffled join leaves a hot host to adaptive splitting
        joined = rows.join(hosts, "host")
    kept = F.filter("lines", lambda x: ~F.array_contains("boiler", digest(x)))
    out = joined.withColumn("kept", F.when(F.size("boiler") > 0, kept).otherwise(F.col("lines")))
    return out.select("page_id", "host", "host_pages", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def oracle(table: str = "pages", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> str:
    """The same in DuckDB's SQL."""
    return rf"""
        WITH p AS (SELECT row_number() OVER () AS rid, page_id,
            lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '')) AS host,
            regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
                '(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>', chr(10), 'g'),
                '(?i)</?(a|b|i|em|strong|span|small|u)( [^>]*)?>', '', 'g'), '<[^>]*>', chr(10), 'g') AS t FROM {table}),
        l AS (SELECT rid, page_id, host, list_filter(list_transform(string_split(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM p),
        e AS (SELECT DISTINCT rid, host, unnest(lines) AS line FROM l),
        h AS (SELECT host, count(*) AS host_pages FROM p GROUP BY host),
        b AS (SELECT host, list(line) AS boiler FROM (SELECT host, line, count(*) AS n FROM e GROUP BY host, line) JOIN h USING (host)
            WHERE host_pages >= {least_pages} AND n > {ratio} * host_pages GROUP BY host),
        k AS (SELECT page_id, host, host_pages, lines, CASE WHEN boiler IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(boiler, x)) END AS kept
            FROM l JOIN h USING (host) LEFT JOIN b USING (host))
        SELECT page_id, host, host_pages, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(lines) - len(kept) AS INTEGER) AS n_dropped,
            coalesce(array_to_string(kept, chr(10)), '') AS text FROM k
    """
