r"""Line deduplication by site-relative frequency.

For every site the pages that contain a line are counted and divided by the
site's page total; a line whose share exceeds the boilerplate ratio is dropped
from all pages of that site. Counting shuffles (site, 128-bit line key, count)
after a map-side combine, never texts, so a line on a third of all pages sends
one row a task. The lines to drop are a short list a site (at most the mean
lines of a page over the ratio) and are joined to the pages by site: Spark
broadcasts that list only if its measured size is under the session's
threshold, else it shuffles, and as both sides are plain exchanges adaptive
execution can split a site that holds a third of all pages.

Everything runs on DataFrame functions. Lines are compared without blanks at
their ends; blank lines are neither counted nor dropped. A page counts once
for each distinct line. Defined results: a null text stays null and counts as
a page; a null site is a site of its own; repeated rows are pages each; a page
whose every line goes keeps its row with an empty text; a text of any length is
read whole; an empty table gives no rows. On a site of one or two pages every
line has a share of a half or more, boilerplate or not, so a share tells
nothing there: a line on fewer than ``min_pages`` pages is never dropped. With
``min_pages`` 1 the ratio alone decides, and such pages are emptied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querent.llm.shared import once, pick, written

RATIO = 0.1
MIN_PAGES = 3
BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def _key(line: Column) -> Column:
    own = _trimmed(line)
    return F.struct(F.xxhash64(own).alias("a"), F.xxhash64(F.lit(1), own).alias("b"))


def boilerplate(pages: DataFrame, sites: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """site, keys of the lines to drop; pages has the columns site and text, sites the site of every page."""
    totals = sites.groupBy("site").agg(F.count("*").alias("pages"))
    spoken = F.filter(_lines(F.col("text")), lambda x: _trimmed(x) != "")
    seen = pages.select("site", F.explode(F.array_distinct(F.transform(spoken, _key))).alias("key"))
    counts = seen.groupBy("site", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = counts.alias("c").join(totals.alias("t"), F.col("c.site").eqNullSafe(F.col("t.site"))).where(F.col("n") > ratio * F.col("pages"))
    return written(often.groupBy("c.site").agg(F.collect_list("key").alias("keys")), "boilerplate")


def drop_boilerplate(pages: DataFrame, site: Column, text: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with the columns _text (without boilerplate), _lines and _dropped added."""
    base = once(once(pages, "_site", site), "_raw", text)
    # Page totals come from a frame without the texts, which a generator would keep from being pruned.
    found = boilerplate(base.select(F.col("_site").alias("site"), F.col("_raw").alias("text")), pages.select(site.alias("site")), ratio, min_pages)
    found = found.select(F.col("site").alias("_of"), F.col("keys").alias("_keys"))
    joined = base.join(found, F.col("_site").eqNullSafe(F.col("_of")), "left")
    lines = _lines(F.col("_raw"))
    kept = F.when(F.col("_keys").isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col("_keys"), _key(x))))
    out = once(joined, "_kept", kept)
    return out.withColumns({"_text": F.array_join("_kept", "\n"), "_lines": F.coalesce(F.size(lines), F.lit(0)), "_dropped": F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0))}).drop("_of", "_keys", "_kept", "_raw", "_site")


HIDDEN = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|article|header|footer|title|tr|td|th|table|body|head|html|section|aside|main)(?:\s[^>]*)?/?>"
TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def html_lines(html: Column) -> Column:
    """A page's visible text, a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, ""), BLOCK, "\n"), TAG, "")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    pages = pick(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    found = drop_boilerplate(pages, F.col("host"), html_lines(F.col("html")))
    return found.select("page_id", "host", F.col("_lines").cast("long").alias("lines"), F.col("_dropped").cast("long").alias("dropped"), F.col("_text").alias("text"))


OP8_SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS host,
    string_split(regexp_replace(regexp_replace(regexp_replace(html, '{HIDDEN}', '', 'g'), '{BLOCK}', chr(10), 'g'), '{TAG}', '', 'g'), chr(10)) AS ls
  FROM pages
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY host
), s AS (
  SELECT host, k, count(*) AS n FROM (
    SELECT host, unnest(list_distinct(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))))) AS k FROM p
  ) WHERE k <> '' GROUP BY host, k
), b AS (SELECT s.host, list(k) AS ks FROM s JOIN t ON s.host IS NOT DISTINCT FROM t.host WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages GROUP BY s.host
), c AS (
  SELECT page_id, p.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(ks, []), trim(x, ' ' || chr(9) || chr(13)))) AS kept
  FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host
)
SELECT page_id, host, coalesce(CAST(len(ls) AS BIGINT), 0) AS lines, coalesce(CAST(len(ls) - len(kept) AS BIGINT), 0) AS dropped, CASE WHEN ls IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text FROM c
"""
