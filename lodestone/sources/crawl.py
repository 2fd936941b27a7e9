"""A breadth-first crawl over a table of pages, and what a crawl row gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_links, strip, url_join
from .scratch import stored


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, href, target): the links of each page and where they lead."""
    found = pages.select(F.col(url_col).alias("url"), F.explode(html_links(F.col(html_col))).alias("href"))
    return found.withColumn("target", url_join(F.col("url"), F.col("href")))


def admitted(href: Column, target: Column, root: str) -> Column:
    """Whether a link belongs to the site: no fragment, below the root, and not
    a source or an image."""
    odd = target.endswith(".txt") | target.endswith(".rst") | F.contains(target, F.lit("_sources")) | F.contains(target, F.lit("_images"))
    return ~F.contains(href, F.lit("#")) & target.startswith(root) & ~odd


def crawl(pages: DataFrame, start: Sequence[str], root: str, max_seen: int | None = None, max_items: int | None = None) -> DataFrame:
    """(url, depth) of the pages reached from ``start``.

    Each round joins the frontier with the link table and keeps the targets not
    seen before.  Whatever is admitted counts as seen; only ``.html`` goes on.
    The loop ends with an empty frontier; ``max_seen`` urls or ``max_items`` pages
    end it before, where they are given.  Only counts reach the driver."""
    most = min((n for n in (max_seen, max_items) if n is not None), default=None)
    spark = pages.sparkSession
    edges = links(pages)
    edges = stored(edges.where(admitted(F.col("href"), F.col("target"), root)).select("url", "target").distinct())
    frontier = spark.createDataFrame([(u,) for u in start], "url string").distinct().withColumn("depth", F.lit(0))
    seen = frontier
    depth = 0
    while True:
        depth += 1
        html = frontier.where(F.col("url").endswith(".html") | (F.col("depth") == 0))
        found = html.select("url").join(edges, "url").select(F.col("target").alias("url")).distinct()
        frontier = stored(found.join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        new = frontier.count()
        if not new:
            break
        seen = stored(seen.unionByName(frontier))
        if most is not None and seen.count() >= most:
            break
    order = seen.orderBy("depth", "url")
    return order if most is None else order.limit(most)


def with_sources(pages: DataFrame, sources: DataFrame, fallbacks: DataFrame | None = None, least: int = 10) -> DataFrame:
    """Crawled pages with their source text.  ``sources`` and ``fallbacks`` have
    url and text; a source that is missing or shorter than ``least`` gives way to
    the fallback, if one is asked for at all.  status: ok, ok_sources or missing;
    without fallbacks it stays ok."""
    poor = F.length(strip(F.coalesce("rst", F.lit("")))) < least
    out = pages.join(sources.select("url", F.col("text").alias("rst")), "url", "left")
    if fallbacks is None:
        return out.select(*pages.columns, F.coalesce("rst", F.lit("")).alias("rst_text"), F.lit("raw").alias("source_used"), F.lit("ok").alias("status"))
    out = out.join(fallbacks.select("url", F.col("text").alias("other")), "url", "left")
    there = F.length(strip(F.coalesce("other", F.lit("")))) > 0
    status = F.when(~poor, F.lit("ok")).when(there, F.lit("ok_sources")).otherwise(F.lit("missing"))
    return out.select(
        *pages.columns,
        F.when(~poor, F.col("rst")).when(there, F.col("other")).otherwise(F.coalesce("rst", F.lit(""))).alias("rst_text"),
        F.when(poor & there, F.lit("sources")).otherwise(F.lit("raw")).alias("source_used"),
        status.alias("status"),
    )
