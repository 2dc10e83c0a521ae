"""Page jobs: mapInPandas over (page_id, url, html), nothing kept between pages.

Only the columns a job needs enter Python, in Arrow batches; pages are
independent, so any partitioning works and no shuffle is involved.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.dates import legacy_date, listed_date
from gleanmill.functions.text import text_of, writer_cleanup
from gleanmill.functions.urls import item_key, url_normalise
from gleanmill.operators.lookup import attach
from gleanmill.pages import content as P
from gleanmill.pages.tree import Node, Selector, parse

Reader = Callable[[Node, str], dict]


def _per_page(pages: DataFrame, schema: str, reader: Callable[[], Callable[[pd.Series], list[dict]]]) -> DataFrame:
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = reader()
        for batch in batches:
            rows = [row for record in batch.itertuples(index=False) for row in read(record)]
            yield pd.DataFrame(rows, columns=names)

    return pages.mapInPandas(run, schema)


def page_text(pages: DataFrame, selector: str = "body", visible_only: bool = True) -> DataFrame:
    """(page_id, text): one line per block, tables flattened, hidden parts left out if asked."""
    def reader():
        chosen = Selector(selector)
        def read(page):
            return [{"page_id": page.page_id, "text": P.block_text(chosen.all(parse(page.html)), visible_only)}]
        return read

    return _per_page(pages.select("page_id", "html"), "page_id long, text string", reader)


def page_tables(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, row_no, cells): row 0 holds the header cells."""
    def reader():
        tables = Selector("table")
        def read(page):
            for t, table in enumerate(tables.all(parse(page.html))):
                heads, rows = P.table_rows(table)
                for r, cells in enumerate([heads, *rows]):
                    yield {"page_id": page.page_id, "table_no": t, "row_no": r, "cells": cells}
        return read

    return _per_page(
        pages.select("page_id", "html"), "page_id long, table_no int, row_no int, cells array<string>", reader
    )


def page_clean(pages: DataFrame, keep_media: bool = False) -> DataFrame:
    """(page_id, html) of the cleaned body."""
    def reader():
        def read(page):
            return [{"page_id": page.page_id, "html": P.clean_html(parse(page.html), keep_media)}]
        return read

    return _per_page(pages.select("page_id", "html"), "page_id long, html string", reader)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href): every quoted href, read by a JVM expression."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return pages.select("page_id", F.posexplode(hrefs).alias("pos", "href"))


def selected_links(pages: DataFrame, selector: str) -> DataFrame:
    """(page_id, pos, href) of selected elements, or of the first anchor inside each."""
    def reader():
        chosen = Selector(selector)
        def read(page):
            hrefs = P.links(chosen.all(parse(page.html)))
            return [{"page_id": page.page_id, "pos": i, "href": h} for i, h in enumerate(hrefs)]
        return read

    return _per_page(pages.select("page_id", "html"), "page_id long, pos int, href string", reader)


# ---- recipe targets ---------------------------------------------------------

def _text(root: Node, target: dict, url: str):
    return P.joined_text(target["chosen"].all(root))


def _blocks(root: Node, target: dict, url: str):
    return P.tidy(P.block_text(target["chosen"].all(root)))


def _images(root: Node, target: dict, url: str):
    return P.images(target["chosen"].all(root), url, target.get("containerSelector"), target.get("captionSelector"))


def _files(root: Node, target: dict, url: str):
    nodes = target["chosen"].all(root)
    if not nodes:
        return [] if target.get("optional") else None
    return [{"url": u} for u in P.attributes(nodes, target.get("attribute") or "href", url, target.get("customTransform"))]


# Field kinds of recipes; register_target adds others.
TARGETS: dict[str, Callable[[Node, dict, str], object]] = {
    "uniqueText": _text,
    "duplicatedText": _blocks,
    "images": _images,
    "file": _files,
    "list": lambda root, t, url: P.links(t["chosen"].all(root)),
    "title": lambda root, t, url: P.strip("".join(n.text() for n in t["chosen"].all(root))),
    "author": lambda root, t, url: P.author(t["chosen"].all(root)),
    "writedate": lambda root, t, url: P.written(t["chosen"].all(root), root),
    "content": lambda root, t, url: P.content(t["chosen"].all(root)),
    "thumbnail": lambda root, t, url: [
        {"url": n.attrs["src"].replace("_w250_", "_w1597_", 1)} for n in t["chosen"].all(root) if n.attrs.get("src")
    ],
    "img": lambda root, t, url: [
        {"url": n.attrs["src"].replace(t.get("srcOld") or "", t.get("srcNew") or "", 1) if t.get("srcOld") else n.attrs["src"]}
        for n in t["chosen"].all(root) if n.attrs.get("src")
    ],
    "imgCaption": lambda root, t, url: [P.strip(n.text()) for n in t["chosen"].all(root)],
}


def register_target(kind: str, read: Callable[[Node, dict, str], object]) -> None:
    TARGETS[kind] = read


def accumulate(fields: dict, name: str, value: object) -> None:
    """Several targets of one name: texts join, a list gains one element, objects merge, else a pair."""
    if name not in fields:
        fields[name] = value
        return
    old = fields[name]
    if isinstance(old, str) and isinstance(value, str):
        fields[name] = old + value
    elif isinstance(old, list):
        fields[name] = [*old, value]
    elif isinstance(old, dict) and isinstance(value, dict):
        fields[name] = {**old, **value}
    else:
        fields[name] = [old, value]


def extract_fields(pages: DataFrame, recipes: DataFrame) -> DataFrame:
    """Apply each recipe to the pages of its host: (page_id, recipe_id, url, fields).

    recipes: recipe_id, host, targets (JSON list).  A page meets the recipes of
    its own host only; a host with most of the pages is looked up apart, so its
    pages stay spread.  ``fields`` maps a
    target's name to its text, or to JSON for lists; a value that could not be
    read has no entry.  List-page targets ('-list') are skipped here.
    """
    per_host = recipes.groupBy("host").agg(F.collect_list(F.struct("recipe_id", "targets")).alias("_recipes"))
    found = attach(pages.select("page_id", "url", "html", "host"), per_host, "host", ["_recipes"], ["page_id"])
    joined = found.select("page_id", "url", "html", F.inline("_recipes"))

    def reader():
        cache: dict[str, list[dict]] = {}

        def targets_of(text: str) -> list[dict]:
            if text not in cache:
                cache[text] = [
                    {**t, "chosen": Selector(t["selector"])}
                    for t in json.loads(text)
                    if not t["name"].endswith("-list") and t["type"] in TARGETS
                ]
            return cache[text]

        def read(page):
            root, fields = parse(page.html), {}
            for target in targets_of(page.targets):
                accumulate(fields, target["name"], TARGETS[target["type"]](root, target, page.url))
            flat = [
                (k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
                for k, v in fields.items()
                if v is not None
            ]
            return [{"page_id": page.page_id, "recipe_id": page.recipe_id, "url": page.url, "fields": dict(flat)}]

        return read

    return _per_page(
        joined.select("page_id", "recipe_id", "url", "html", "targets"),
        "page_id long, recipe_id long, url string, fields map<string,string>",
        reader,
    )


def finished_fields(extracted: DataFrame) -> DataFrame:
    """Writers without their label, dates as yyyyMMdd where readable, the url's stored form and key."""
    def finish(name: Column, value: Column) -> Column:
        return (
            F.when(name == "writer", writer_cleanup(value))
            .when(F.contains(name, F.lit("date")), F.coalesce(listed_date(value), legacy_date(value), value))
            .otherwise(value)
        )

    stored = url_normalise("url")
    return extracted.withColumns({
        "fields": F.transform_values("fields", finish), "current_url": stored, "item_hash": item_key(stored)
    })


def list_values(pages: DataFrame, targets: str) -> DataFrame:
    """(page_id, name, pos, value) of the '-list' targets of listing pages.

    The i-th value belongs to the i-th link of the page: join both by
    (page_id, pos) before links are deduplicated.
    """
    def reader():
        wanted = [(t["name"].removesuffix("-list"), Selector(t["selector"])) for t in json.loads(targets) if t["name"].endswith("-list")]
        def read(page):
            root = parse(page.html)
            for name, chosen in wanted:
                for pos, node in enumerate(chosen.all(root)):
                    yield {"page_id": page.page_id, "name": name, "pos": pos, "value": P.one_line(node.text())}
        return read

    return _per_page(pages.select("page_id", "html"), "page_id long, name string, pos int, value string", reader)


def with_title(extracted: DataFrame) -> DataFrame:
    """Pages whose title came out blank are dropped."""
    title = F.try_element_at("fields", F.lit("title"))
    return extracted.where(F.btrim(text_of(title)) != "")


def same_name_text(values: DataFrame, order: str = "target_no") -> DataFrame:
    """Text values of one (page, name) concatenated in recipe order.

    A page has as many values per name as the recipe has targets of it.
    """
    parts = F.array_sort(F.collect_list(F.struct(order, "value")))
    text: Column = F.array_join(F.transform(parts, lambda p: p["value"]), "")
    return values.groupBy("page_id", "name").agg(text.alias("value"))
