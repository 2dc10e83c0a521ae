"""Bibliographic ingest: merge, drop, classify, translate, store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.text import publisher_normalise, title_suffix
from gleanmill.functions.urls import item_key
from gleanmill.operators.dedupe import ordered_distinct, with_url_key
from gleanmill.operators.joins import attach_translations, join_covers
from gleanmill.operators.rollups import counters
from gleanmill.operators.verdicts import (
    TRANSLATED,
    assign_themes,
    confirm_academic,
    confirm_institution,
    confirm_topic,
    theme_batches,
    with_english,
)
from gleanmill.rules import vocabulary as V
from gleanmill.rules.cascades import academic_rule, bib_rule, institution_rule, menu_of
from gleanmill.session import cut_lineage

def register_no() -> Column:
    return F.concat(F.upper("source"), F.lit(":"), "source_id")


def decisions(items: DataFrame, stored: DataFrame | None, store: DataFrame, replies: DataFrame) -> DataFrame:
    """(seq, register_no, item_hash, matched_keywords, topic, academic, status) of each merged item.

    The first reason to drop is the one counted.  Only the short fields the
    rules and keys need go through the joins.
    """
    words = ordered_distinct(with_url_key(items), ["source", "source_id", "_url"], "matched_keyword", "seq", "matched_keywords")
    short = items.select("seq", "source", "source_id", "title", "publisher", "sub_category", "material_type")
    merged = short.join(words.select("seq", "matched_keywords"), "seq").withColumns({
        "register_no": register_no(),
        "item_hash": item_key(F.concat("source", F.lit(":"), "source_id")),
        "topic_rule": bib_rule("title"),
        "academic_rule": academic_rule("source", "title", "publisher", "sub_category", "material_type"),
    })
    if stored is None:
        known = merged.withColumn("_stored", F.lit(False))
    else:
        marks = stored.select("register_no", F.lit(True).alias("_stored")).distinct()
        known = merged.join(marks, "register_no", "left")
    on_topic = confirm_topic(cut_lineage(known), store, replies)
    judged = confirm_academic(cut_lineage(on_topic), store, replies)
    status = (
        F.when(F.coalesce("_stored", F.lit(False)), "existing")
        .when(~F.col("topic.relevant"), "irrelevant")
        .when(~F.col("academic.academic"), "non_academic")
        .when(publisher_normalise("publisher") == "", "unclassifiable")
        .otherwise("saved")
    )
    return judged.select(
        "seq", "register_no", "item_hash", "matched_keywords", "topic", "academic", status.alias("status")
    )


def judged_items(items: DataFrame, stored: DataFrame | None, store: DataFrame, replies: DataFrame) -> DataFrame:
    """First items of each source id with their decisions: one wide shuffle, by the unique place."""
    return items.join(decisions(items, stored, store, replies), "seq")


def classified_items(
    judged: DataFrame,
    store: DataFrame,
    replies: DataFrame,
    theme_replies: DataFrame,
    covers: DataFrame,
    translations: DataFrame,
) -> DataFrame:
    """Survivors with theme, institution, menu, english fields and cover."""
    survivors = judged.where("status = 'saved'")
    short = survivors.select(
        "seq", "register_no", "title", "publisher", "material_type", "isbn", institution_rule("publisher").alias("institution_rule")
    )
    short = cut_lineage(short)
    classified = cut_lineage(confirm_institution(short, store, replies).drop("institution_rule"))
    with_menu = classified.withColumn("menu_id", menu_of("material_type", "classification.verdict"))
    themes = assign_themes(theme_batches(short.select("seq", "title"), "seq"), theme_replies).select("seq", "theme")
    covered = join_covers(with_menu.join(themes, "seq", "left"), covers, "seq")
    translated = attach_translations(covered, translations, "register_no", TRANSLATED)
    added = ["classification", "menu_id", "theme", "cover_url", *[f + "_translated" for f in TRANSLATED]]
    return with_english(survivors.join(translated.select("seq", *added), "seq"))


def archive_metas(classified: DataFrame, collected_at: str) -> DataFrame:
    """The stored record."""
    labels = F.create_map(*[F.lit(x) for pair in V.SOURCE_LABELS.items() for x in pair])
    return classified.select(
        "source", "source_id", "menu_id", "title", "title_en", "publisher", "publisher_en", "author", "author_en",
        "publish_year",
        F.coalesce("theme", F.lit(V.THEME_FALLBACK)).alias("category"),
        F.lit(None).cast("string").alias("category_en"),
        "sub_category",
        F.lit(None).cast("string").alias("sub_category_en"),
        "summary", "summary_en",
        F.col("detail_url").alias("link_url"),
        "isbn", "cover_url", "register_no",
        F.try_element_at(labels, F.col("source")).alias("remark"),
        "matched_keywords", "classification",
        F.lit(collected_at).alias("collected_at"),
        "item_hash",
        title_suffix("title").alias("title_suffix"),
        "seq",
    )


def ingest_summary(items: DataFrame, judged: DataFrame, classified: DataFrame) -> DataFrame:
    """Fetched, merged, dropped by reason, saved per menu, translated, covered: one row."""
    fetched = items.agg(F.count(F.lit(1)).alias("n")).scalar()
    by_status = counters(judged, {
        "deduped": F.lit(True),
        "skipped_existing": F.col("status") == "existing",
        "dropped_irrelevant": F.col("status") == "irrelevant",
        "dropped_non_academic": F.col("status") == "non_academic",
        "dropped_unclassifiable": F.col("status") == "unclassifiable",
        "saved": F.col("status") == "saved",
    })
    by_menu = counters(classified, {
        **{m.lower(): F.col("menu_id") == m for m in V.MENUS},
        "translated": F.coalesce("title_en", "summary_en").isNotNull(),
        "cover_fetched": F.col("cover_url").isNotNull(),
    })
    menu_row = by_menu.select(F.struct("*").alias("m")).scalar()
    return by_status.select(fetched.alias("fetched"), "*", menu_row.alias("_m")).select("*", "_m.*").drop("_m")
