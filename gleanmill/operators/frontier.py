"""The crawl frontier: which listed urls are new, and where paging stops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.operators.lookup import attach


def page_stops(links: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """First page of each crawl that brings no url the crawl had not seen.

    links: crawl, page, pos, url_key; pages: crawl, page, every page that was
    read.  A page that lists nothing has no link but stops its crawl too, so
    ``pages`` may be left out only where every page lists something.  First
    sightings are found by a minimum per (crawl, url), so the busiest crawl is
    reduced before it is shuffled.
    """
    first_seen = links.groupBy("crawl", "url_key").agg(F.min("page").alias("page"))
    fresh = first_seen.select("crawl", "page").distinct()
    read = (links if pages is None else pages).select("crawl", "page").distinct()
    empty = read.join(fresh, ["crawl", "page"], "left_anti")
    return empty.groupBy("crawl").agg(F.min("page").alias("stop_page"))


def frontier(links: DataFrame, pages: DataFrame | None = None, page_cap: int | None = None) -> DataFrame:
    """Urls to visit: first sighting in the whole run, before the crawl's stop page.

    links: crawl, page, pos, url_key (crawl sorts in run order); pages as in
    page_stops.  Stopping looks
    at one crawl only; taking a url looks at every earlier crawl.
    """
    if page_cap is not None:
        links = links.where(F.col("page") <= page_cap)
    sighted = links.groupBy("crawl", "url_key").agg(F.min(F.struct("page", "pos")).alias("at"))
    open_pages = attach(sighted, page_stops(links, pages), "crawl", ["stop_page"], ["url_key"]).where(
        F.col("stop_page").isNull() | (F.col("at.page") < F.col("stop_page"))
    )
    taken = open_pages.groupBy("url_key").agg(F.min(F.struct("crawl", "at.page", "at.pos")).alias("_first"))
    return taken.select("url_key", "_first.crawl", "_first.page", "_first.pos")
