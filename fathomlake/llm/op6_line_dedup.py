"""Line dedup by site-relative frequency, in DataFrame operations only.

A page's lines are the trimmed, non-empty pieces of its visible text: comments, script and style elements are taken
out, the tags of block elements and line feeds end a line, other tags are dropped. The pages of a host that hold a line
(once or more often) are divided by all pages of the host; a line over ``max_ratio`` on a host with ``min_pages`` pages
or more is boilerplate and goes from every page of that host.

Cases: a null url or one without host is the host ''; null or empty html has no lines and an empty kept_text;
repeated rows are pages of their own; a null page_id is a page like others; very long html is one row of its lines; ties do not
arise, as every line over the ratio goes; an empty table gives an empty one; other columns are not read, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RATIO, MIN_PAGES = 0.3, 5
#: Parts that a host's pages are spread over to meet its drops.
SALTS = 64
#: Fixed patterns, in a form that Java and RE2 read alike.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|td|th|table|article|section|header|footer|nav|title|head|body|html)\b[^>]*>"
TAGS = r"<[^>]*>"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def page_lines(html: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")), lambda x: x != "")


def line_dedup(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped, kept_text (the lines that stay, in order, joined by line feeds).

    A host may hold a third of all pages: its lines are counted with map-side combining on (host, line), each task
    sending one row for each of them, and nothing gathers a host. The lines to drop go back to the pages by a join on
    the host and a salt: a host's pages are spread over SALTS keys, and its small set of drops is there for each of them.
    """
    rows = pages.select(F.col("page_id").cast("long"), host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines")).withColumn("row", F.monotonically_increasing_id())
    # A line is known by its 16-byte digest: lines in full go over the network only once, with their page.
    pieces = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.md5(x)))).alias("line"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    # What fewer pages hold than the least host needs cannot pass: most lines, before anything is joined by host.
    held = pieces.groupBy("host", "line").agg(F.count("*").alias("holding")).where(F.col("holding") > max_ratio * min_pages)
    drops = held.join(totals, "host").where(F.col("holding") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("drops"))
    # At most 1 / max_ratio times the mean number of lines of a host's pages can pass the ratio, so a host's set is small.
    salted = drops.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    marked = marked.withColumn("kept", F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("drops"), F.md5(x)))))
    return marked.select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))


ORACLE = rf"""
WITH r AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{HIDDEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g'), chr(10)),
      lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
t AS (SELECT host, count(*) AS pages FROM r GROUP BY 1),
h AS (SELECT host, line, count(*) AS holding FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM r) GROUP BY 1, 2),
d AS (SELECT host, list(line) AS drops FROM h JOIN t USING (host) WHERE pages >= {MIN_PAGES} AND holding > {MAX_RATIO} * pages GROUP BY 1),
k AS (SELECT page_id, r.host AS host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept FROM r LEFT JOIN d ON r.host = d.host)
SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS kept_text FROM k
"""
