"""Line dedup by site-relative frequency.

A line's boilerplate ratio is the number of the site's pages that contain it over the number of the site's pages, where
pages of equal text count as one (else a page copied often would be all boilerplate). Lines above a ratio are dropped,
if min_pages pages or more contain them: on a site of one to four pages any line would be above it. The site is the host
of a url column, or a column that holds it (documents have no url; their `source` is what a host is to pages).

Lines are counted by 64-bit hash first; the few that pass are counted again by their text, so a collision can't drop a
line. A site's dropped lines are at most its lines per page over the ratio, so each site's list is bounded by page
length, whatever the number of pages.

Defined results: a null text stays null, has no lines and is no page of its site; blank lines (ASCII white space only)
are never dropped; a null site is a site of its own; repeated rows count as one page and are cut alike; long texts are
cut whole; other columns pass through unless they bear a result's name, in any case, which then holds the result; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillway.llm.common import cut, placed
from rillway.llm.url_filter import url_parts

RESULTS = ("n_lines", "n_dropped")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.when(line.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(line))


def boilerplate(pages: DataFrame, ratio: float, min_pages: int) -> DataFrame:
    """site and lines: the lines to drop, one row per site that has any. pages: site, text."""
    pages = pages.filter("text is not null")
    keyed = pages.select("site", F.md5("text").alias("page"), F.array_distinct(F.transform(_lines(F.col("text")), _key)).alias("keys"))
    alone = keyed.groupBy("site", "page").agg(F.first("keys").alias("keys"))
    totals = cut(alone.groupBy("site").agg(F.count(F.lit(1)).alias("total"))).select(F.col("site").alias("of"), "total")
    counts = alone.select("site", F.explode("keys").alias("key")).filter("key is not null").groupBy("site", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    often = counts.join(totals, counts["site"].eqNullSafe(totals["of"])).filter(F.col("n") > ratio * F.col("total"))
    likely = cut(often.groupBy("site").agg(F.collect_list("key").alias("keys"), F.first("total").alias("total"))).select(F.col("site").alias("of"), "keys", "total")
    # The same by text, for the lines whose hash has passed.
    near = pages.join(likely, pages["site"].eqNullSafe(likely["of"]))
    hits = near.select("site", "total", F.md5("text").alias("page"), F.explode(F.array_distinct(F.filter(_lines(F.col("text")), lambda x: F.array_contains("keys", _key(x))))).alias("line"))
    exact = hits.groupBy("site", "line", "page").agg(F.first("total").alias("total")).groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    return exact.filter((F.col("n") >= min_pages) & (F.col("n") > ratio * F.col("total"))).groupBy("site").agg(F.collect_list("line").alias("lines"))


def _cut_lines(df: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int, url_col: str | None) -> tuple[DataFrame, str]:
    """df's columns by place with _all and _kept, the lines of its text and those that stay; where the text is."""
    rows, (site, text) = placed(df, url_col or site_col, text_col)
    of = url_parts(F.col(site))[0] if url_col else F.col(site)
    found = cut(boilerplate(rows.select(of.alias("site"), F.col(text).alias("text")), ratio, min_pages)).select(F.col("site").alias("_of"), F.col("lines").alias("_drop"))
    rows = rows.withColumn("_site", of).withColumn("_all", _lines(F.col(text)))
    rows = rows.join(found, F.col("_site").eqNullSafe(F.col("_of")), "left")
    return rows.withColumn("_kept", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(F.filter("_all", lambda line: ~F.array_contains("_drop", line)))), text


def line_dedup(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5, url_col: str | None = None) -> DataFrame:
    """df with its text cut to the lines kept, n_lines and n_dropped. url_col: a column whose host is the site, in place
    of site_col."""
    rows, text = _cut_lines(df, site_col, text_col, ratio, min_pages, url_col)
    n_lines, n_kept = (F.coalesce(F.size(c), F.lit(0)).cast("long") for c in ("_all", "_kept"))
    own = [(f"_c{i}", c) for i, c in enumerate(df.columns) if c.lower() not in RESULTS]
    columns = [F.array_join("_kept", "\n").alias(c) if c == text else F.col(c) for c, _ in own]
    return rows.select(*columns, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")).toDF(*[name for _, name in own], *RESULTS)


def without_boilerplate(df: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = 0.1, min_pages: int = 5, url_col: str | None = None, length_col: str | None = None) -> DataFrame:
    """df's own columns, all rows, with the text cut to the lines kept; length_col: a column that then holds the text's
    number of characters."""
    rows, text = _cut_lines(df, site_col, text_col, ratio, min_pages, url_col)
    length = placed(df, length_col)[1][0] if length_col else None
    new = {text: F.array_join("_kept", "\n")}
    if length:
        new[length] = F.length(new[text]).cast(rows.schema[length].dataType)
    return rows.select(*[new.get(f"_c{i}", F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(df.columns))]).toDF(*df.columns)
