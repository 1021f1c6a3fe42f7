"""Headings and links of catalogue pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRIP = "<[^>]*>"


def headings(pages: DataFrame, item: str = "<li>(.*?)</li>") -> DataFrame:
    """(page_id, pos, heading): the list items of a page without their markup, in order; blanks are left out."""
    li = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(item), 1)).alias("pos", "x"))
    return li.select("page_id", "pos", F.trim(F.regexp_replace("x", STRIP, "")).alias("heading")).where("heading <> ''")


def links(pages: DataFrame) -> DataFrame:
    """(href, text, page_id): links made absolute, one row per URL (first page, then first place)."""
    href = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), 1)
    text = F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), 2)
    base = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    rows = pages.select("page_id", base.alias("base"), F.posexplode(F.arrays_zip(href.alias("h"), text.alias("t"))).alias("pos", "x"))
    full = rows.select("page_id", "pos", F.when(F.startswith("x.h", F.lit("/")), F.concat("base", "x.h")).otherwise(F.col("x.h")).alias("href"), F.trim("x.t").alias("text"))
    first = Window.partitionBy("href").orderBy("page_id", "pos")
    return full.withColumn("n", F.row_number().over(first)).where("n = 1").select("href", "text", "page_id")
