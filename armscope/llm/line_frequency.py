"""Line dedup by site-relative frequency.

Lines of a page are what its block elements hold. For each host, the pages that contain a line are divided by
the host's pages; lines on more than ``percent`` of them, and on ``min_pages`` pages at least, are boilerplate
and dropped from all pages of the host.

Counts are combined before the shuffle, and lines travel as two 64-bit hashes. A host has at most
(mean lines a page) * 100 / percent boilerplate lines, so its list is one short row however many pages it has;
pages meet that row in one join, by host and ``salts`` salts.

Defined cases: a page without html has no lines. A url without a scheme and host, or a null one, belongs to
host ''. Repeated rows count as pages of their own. Null ids are kept. Lines are compared after trimming; a
line repeated within a page counts once, and all its repeats go. Extra columns are ignored. Empty table: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HIDDEN = r"(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>"
BLOCK_TAG = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header"
    r"|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>"
)
ANY_TAG = r"<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
EDGES = r"^\s+|\s+$"


@dataclass(frozen=True)
class LineSpec:
    percent: int = 10
    min_pages: int = 3
    salts: int = 32


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, HOST, 1)), F.lit(""))


def lines_of(html: Column) -> Column:
    """Trimmed, non-empty lines of a page's visible text, in order."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK_TAG, "\n"), ANY_TAG, "")
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, EDGES, ""))
    return F.filter(lines, lambda x: x != "")


def digest(line: Column) -> Column:
    """Two independent 64-bit hashes."""
    return F.struct(F.xxhash64(line).alias("one"), F.xxhash64(F.lit("line"), line).alias("two"))


def boilerplate(pages: DataFrame, spec: LineSpec) -> DataFrame:
    """(host, drop): the digests of each host's boilerplate lines. pages: host, digests."""
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        pages.select("host", F.explode(F.array_distinct("digests")).alias("d"))
        .groupBy("host", "d")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= spec.min_pages)
    )
    return (
        counts.join(totals, "host")
        .where(F.col("n") * 100 > F.col("pages") * spec.percent)
        .groupBy("host")
        .agg(F.collect_list("d").alias("drop"))  # bounded: see above
    )


def without_boilerplate(pages: DataFrame, spec: LineSpec = LineSpec()) -> DataFrame:
    """(page_id, host, n_lines, n_dropped, kept_text) of every row of ``pages`` (page_id, url, html)."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    found = boilerplate(cut.select("host", F.transform("lines", digest).alias("digests")), spec)
    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains(F.col("drop"), digest(x)))
    )
    # a host may hold a third of all pages: they are dealt by host and salt, to a copy of its list each
    salt = F.pmod(F.xxhash64("page_id", F.size("lines")), F.lit(spec.salts))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spec.salts - 1).cast("long"))))
    return (
        cut.withColumn("salt", salt)
        .join(found, ["host", "salt"], "left")
        .select("page_id", "host", "lines", kept.alias("kept"))
        .select(
            "page_id",
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.concat_ws("\n", "kept").alias("kept_text"),
        )
    )


def sql(spec: LineSpec = LineSpec()) -> str:
    """The same in DuckDB's SQL."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    text = "html"
    for pattern, by in ((HIDDEN, "''"), (BLOCK_TAG, "chr(10)"), (ANY_TAG, "''")):
        text = f"regexp_replace({text}, {quoted(pattern)}, {by}, 'g')"
    return f"""
WITH cut AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, {quoted(HOST)}, 1)), '') AS host,
    list_filter(list_transform(string_split(coalesce({text}, ''), chr(10)),
      lambda x: regexp_replace(x, {quoted(EDGES)}, '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
totals AS (SELECT host, count(*) AS pages FROM cut GROUP BY host),
counts AS (
  SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM cut) GROUP BY host, line),
boilerplate AS (
  SELECT host, list(line) AS dropped FROM counts JOIN totals USING (host)
  WHERE n >= {spec.min_pages} AND n * 100 > pages * {spec.percent} GROUP BY host),
kept AS (
  SELECT page_id, host, lines,
    list_filter(lines, lambda x: NOT list_contains(coalesce(dropped, []), x)) AS kept
  FROM cut LEFT JOIN boilerplate USING (host))
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
  array_to_string(kept, chr(10)) AS kept_text
FROM kept"""
