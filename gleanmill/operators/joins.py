"""Lookups, overlays and plans.

Where a left side may hold a hot key or many rows without one, the lookup goes
through ``lookup.attach``.  The other joins meet on keys that are unique on the
left; there Spark picks a broadcast only below its own size limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.functions.text import blank_to_null
from gleanmill.functions.urls import percent_encode
from gleanmill.functions.values import isbn_valid
from gleanmill.operators.dedupe import first_place_last_value, keep_last
from gleanmill.operators.lookup import attach
from gleanmill.operators.numbering import with_position


def match_requested(requested: DataFrame, stored: DataFrame, key: str, seq: str) -> DataFrame:
    """Requested keys with the last stored row of that key; ``found`` tells misses."""
    latest = keep_last(stored, key, seq).withColumn("found", F.lit(True))
    return requested.join(latest, key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def join_dimensions(rows: DataFrame, origin: DataFrame, category: DataFrame, seq: str) -> DataFrame:
    """Origin is required, category optional; rows without origin are kept and marked.

    Needs rows.origin_id, origin(origin_id, category_code, …), category(category_code, …).
    """
    about = [c for c in origin.columns if c != "origin_id"]
    with_origin = attach(rows, origin.withColumn("has_origin", F.lit(True)), "origin_id", [*about, "has_origin"], [seq])
    marked = with_origin.withColumn("has_origin", F.coalesce("has_origin", F.lit(False)))
    return attach(marked, category, "category_code", [c for c in category.columns if c != "category_code"], [seq])


def join_covers(books: DataFrame, covers: DataFrame, seq: str) -> DataFrame:
    """Cover by ISBN for books only; anything missing is null and changes nothing else."""
    wanted = F.when((F.col("menu_id") == "BOOKS") & isbn_valid("isbn"), F.col("isbn"))
    cover = covers.groupBy(F.col("isbn").alias("_isbn")).agg(F.max(blank_to_null("cover_url")).alias("cover_url"))
    return attach(books.withColumn("_isbn", wanted), cover, "_isbn", ["cover_url"], [seq]).drop("_isbn")


def overlay(rows: DataFrame, details: DataFrame, key: str, values: str = "fields") -> DataFrame:
    """Maps of a list row overlaid by its detail row; detail keys win even if blank."""
    detail = details.select(key, F.col(values).alias("_detail"))
    own = F.col(values)
    late = F.coalesce(F.col("_detail"), F.create_map().cast("map<string,string>"))
    kept = F.map_filter(own, lambda k, _: ~F.map_contains_key(late, k))
    return rows.join(detail, key, "left").withColumn(values, F.map_concat(kept, late)).drop("_detail")


def zip_by_position(
    left: DataFrame, right: DataFrame, group: Sequence[str], left_order: str, right_order: str
) -> DataFrame:
    """i-th row of each left group with the i-th row of the right group.

    Both sides are numbered by range partitions, so a group of any size is
    zipped by many tasks; the join key (group, position) is unique.
    """
    a = with_position(left, [left_order], group, "position")
    b = with_position(right, [right_order], group, "position")
    return a.join(b, [*group, "position"])


def zip_arrays(urls: Column, values: Column) -> Column:
    """Within one page: (url, value) pairs by position; missing values are null."""
    return F.transform(urls, lambda u, i: F.struct(u.alias("url"), F.get(values, i).alias("value")))


def harvest_plan(sources: DataFrame, keywords: Sequence[str], fields: Sequence[str] = ("",)) -> DataFrame:
    """Source × keyword (× field), one request each.

    Keywords and fields are configuration, so each row fans out where it is.
    """
    words = F.array(*[F.struct(F.lit(n).alias("keyword_no"), F.lit(w).alias("keyword")) for n, w in enumerate(keywords)])
    parts = F.array(*[F.struct(F.lit(n).alias("field_no"), F.lit(f).alias("field")) for n, f in enumerate(fields)])
    return sources.select("*", F.inline(words)).select("*", F.inline(parts))


def expand_keywords(start_urls: DataFrame, keywords: str = "keywords", url: str = "url") -> DataFrame:
    """{keyword} replaced by each encoded keyword; urls without it stay as they are."""
    words = F.coalesce(F.col(keywords), F.array().cast("array<string>"))
    templated = F.contains(F.col(url), F.lit("{keyword}")) & (F.size(words) > 0)
    one = F.array(F.struct(F.col(url).alias("url"), F.lit(None).cast("string").alias("keyword"), F.lit(False).alias("from_keyword")))
    many = F.transform(
        words,
        lambda w: F.struct(
            F.replace(F.col(url), F.lit("{keyword}"), percent_encode(w)).alias("url"),
            w.alias("keyword"),
            F.lit(True).alias("from_keyword"),
        ),
    )
    rest = [c for c in start_urls.columns if c not in (keywords, url)]
    return start_urls.select(*rest, F.posexplode(F.when(templated, many).otherwise(one)).alias("word_no", "e")).select(
        *rest, "word_no", "e.*"
    )


def distinct_urls(entries: DataFrame, seq: str = "seq") -> DataFrame:
    return first_place_last_value(entries, "url", seq)


def expected_pages(totals: DataFrame, page_cap: int | None = None, block: int = 4096) -> DataFrame:
    """Page numbers 1..ceil(total / page_size) per request.

    A request with very many pages is cut into blocks that are spread before
    the page numbers are written out.
    """
    pages = F.ceil(F.col("total") / F.col("page_size")).cast("long")
    if page_cap is not None:
        pages = F.least(pages, F.lit(page_cap).cast("long"))
    keys = [c for c in totals.columns if c not in ("total", "page_size")]
    blocks = (
        totals.select(*keys, pages.alias("_pages"))
        .where("_pages > 0")
        .select(*keys, "_pages", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_pages") - 1) / block))).alias("_block"))
        .repartition(*keys, "_block")
    )
    first = F.col("_block") * block + 1
    last = F.least(F.col("_pages"), (F.col("_block") + 1) * block)
    return blocks.select(*keys, F.explode(F.sequence(first, last)).alias("page"))


def capture_gaps(totals: DataFrame, captured: DataFrame, page_cap: int | None = None, block: int = 4096) -> DataFrame:
    """Runs of expected pages that were not captured: the keys of a request, first_page, last_page.

    Only captured pages and requests are rows, however many pages a request has.
    Captured pages are compared with the one before inside blocks of pages, then
    the blocks with each other, so no task holds all captures of a request.
    """
    keys = [c for c in totals.columns if c not in ("total", "page_size")]
    pages = F.ceil(F.col("total") / F.col("page_size")).cast("long")
    if page_cap is not None:
        pages = F.least(pages, F.lit(page_cap).cast("long"))
    have = captured.select(*keys, F.col("page").cast("long").alias("page")).where("page >= 1").dropna(subset=keys).distinct()
    have = have.withColumn("_block", F.floor((F.col("page") - 1) / block))
    gap = lambda before, after: F.struct((before + 1).alias("first_page"), (after - 1).alias("last_page"))
    inside = have.withColumn("_before", F.lag("page").over(Window.partitionBy(*keys, "_block").orderBy("page"))).where("_before < page - 1")
    ends = have.groupBy(*keys, "_block").agg(F.min("page").alias("_low"), F.max("page").alias("_high"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    between = ends.withColumn("_before", F.coalesce(F.lag("_high").over(by_block), F.lit(0).cast("long"))).where("_before < _low - 1")
    # after the last captured page: open until the request's last one
    rest = ends.groupBy(*keys).agg(F.max("_high").alias("_last"))
    gaps = (
        inside.select(*keys, gap(F.col("_before"), F.col("page")).alias("_g"))
        .unionByName(between.select(*keys, gap(F.col("_before"), F.col("_low")).alias("_g")))
        .unionByName(rest.select(*keys, gap(F.col("_last"), F.lit(None).cast("long")).alias("_g")))
    )
    first = F.coalesce("_g.first_page", F.lit(1).cast("long"))
    last = F.least(F.coalesce("_g.last_page", "_pages"), "_pages")
    return (
        totals.select(*keys, pages.alias("_pages")).join(gaps, keys, "left")
        .select(*keys, first.alias("first_page"), last.alias("last_page")).where("first_page <= last_page")
    )


def expanded(gaps: DataFrame, block: int = 4096) -> DataFrame:
    """The pages of runs as rows; long runs are cut into blocks that are spread before."""
    keys = [c for c in gaps.columns if c not in ("first_page", "last_page")]
    start = F.explode(F.sequence("first_page", "last_page", F.lit(block).cast("long")))
    starts = gaps.withColumn("_start", start).repartition(*keys, "_start")
    return starts.select(*keys, F.explode(F.sequence("_start", F.least("last_page", F.col("_start") + block - 1))).alias("page"))


def capture_gap(totals: DataFrame, captured: DataFrame, page_cap: int | None = None) -> DataFrame:
    """Expected pages that were not captured, one row each."""
    return expanded(capture_gaps(totals, captured, page_cap))


# Each source's rule for asking another page, over page, page_size,
# total and records (rows on the page just read).
STOP_RULES = {
    "kci": "page * page_size < total",
    "riss": "page * page_size + 1 <= total",
    "ntis": "page * page_size + 1 <= total",
    "losi": "records > 0 and page * page_size < total",
    "kisti": "records > 0 and (page + 1) * page_size < total + page_size and (page + 1) * page_size <= 10000",
    "encykorea": "records > 0 and case when total is null then records >= page_size else page * page_size < total end",
}


def wants_next_page(source: str) -> Column:
    return F.expr(STOP_RULES[source])


def due_recipes(recipes: DataFrame, time: str) -> DataFrame:
    return recipes.where(F.col("enabled") & F.array_contains("scheduleTime", time))


def attach_translations(rows: DataFrame, translated: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, text) rows pivoted and attached; a failed field stays null."""
    wide = translated.groupBy(key).agg(
        *[F.max(F.when(F.col("field") == f, blank_to_null("text"))).alias(f + "_translated") for f in fields]
    )
    return rows.join(wide, key, "left")


def change_set(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Rows of which any field differs, with old and new values."""
    before = old.select(key, *[F.col(f).alias("old_" + f) for f in fields])
    after = new.select(key, *[F.col(f).alias("new_" + f) for f in fields])
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col("old_" + f).eqNullSafe(F.col("new_" + f))
    return before.join(after, key).where(differs)
