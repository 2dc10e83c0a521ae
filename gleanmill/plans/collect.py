"""Feed collection and archive backfill share one record type and one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.text import text_of
from gleanmill.functions.urls import article_identity, item_key, verdict_key
from gleanmill.operators.dedupe import first_per_key
from gleanmill.operators.joins import attach_translations
from gleanmill.operators.rollups import counters, written_counts
from gleanmill.operators.verdicts import confirm_news
from gleanmill.rules.cascades import NewsRules, with_news_rule
from gleanmill.session import cut_lineage

STATUSES = ("no_keyword", "duplicate", "existing", "irrelevant", "saved")


def decisions(
    articles: DataFrame,
    stored: DataFrame | None,
    store: DataFrame,
    replies: DataFrame,
    seq: str = "seq",
    keyword_gate: bool = True,
    check_topic: bool = True,
    rules: NewsRules = NewsRules(),
    enabled: bool = True,
    provider: bool = True,
) -> DataFrame:
    """(seq, identity, matched_keywords, status, verdict, verdict_key) of every article.

    ``status`` is the first thing that dropped the article.  The live feed gates
    on keywords and topic; the backfill records matches but drops nothing,
    because its supplier already filtered.

    Rules read the text where it lies; only keys and verdicts are shuffled
    after that, never the articles.
    """
    identity = article_identity("guid", "link")
    narrow = [F.col(seq), identity.alias("identity"), F.col("matched_keywords")]
    if check_topic:
        articles = with_news_rule(articles, "title", "content", rules)
        narrow += [F.col("rule"), verdict_key(identity, "title", "content").alias("verdict_key")]
    is_open = F.size("matched_keywords") > 0 if keyword_gate else F.lit(True)
    # the one pass over the texts; everything below reads its short results
    rows = cut_lineage(articles.select(*narrow).withColumn("_open", is_open))
    # a key is taken by its first article that passed the gate; from here on
    # keys are unique, so no lookup sees a hot one
    firsts = first_per_key(rows.where("_open"), "identity", seq).select(seq, "identity")
    if stored is None:
        firsts = firsts.withColumn("_stored", F.lit(False))
    else:
        marks = stored.select("identity", F.lit(True).alias("_stored")).distinct()
        firsts = firsts.join(marks, "identity", "left").withColumn("_stored", F.coalesce("_stored", F.lit(False)))
    marked = rows.join(firsts.select(seq, "_stored"), seq, "left")
    relevant: Column = F.lit(True)
    if check_topic:
        new = marked.where("not _stored").select(seq, "rule", "verdict_key")
        judged = confirm_news(new, store, replies, enabled=enabled, provider=provider, seq=seq)
        marked = marked.drop("rule").join(judged.select(seq, "verdict"), seq, "left")
        relevant = F.col("verdict.relevant")
    status = (
        F.when(~F.col("_open"), "no_keyword")
        .when(F.col("_stored").isNull(), "duplicate")
        .when(F.col("_stored"), "existing")
        .when(~relevant, "irrelevant")
        .otherwise("saved")
    )
    return marked.withColumn("status", status).drop("_open", "_stored")


def judged_articles(articles: DataFrame, *args, seq: str = "seq", **options) -> DataFrame:
    """The articles with their decisions: one wide shuffle, by the unique place."""
    decided = decisions(articles, *args, seq=seq, **options).drop("matched_keywords")
    return articles.join(decided, seq).withColumn("item_hash", item_key("identity"))


def collect_tests() -> dict[str, Column]:
    """What a run counts of its decisions."""
    status, by = F.col("status"), F.col("verdict.by")
    reached = ~status.isin("no_keyword", "duplicate", "existing")
    return {
        "total_items": F.lit(True),
        "keyword_matched": F.size("matched_keywords") > 0,
        "skipped_duplicate": status.isin("duplicate", "existing"),
        "skipped_irrelevant": status == "irrelevant",
        "llm_checked": reached & F.startswith(by, F.lit("llm-")),
        "llm_dropped": reached & (by == "llm-drop"),
        "trial_dropped": reached & (by == "trial-drop"),
        "roundup_dropped": reached & (by == "roundup-drop"),
        "saved": status == "saved",
    }


def collect_summary(judged: DataFrame) -> DataFrame:
    """All counters of a run in one pass over its decisions."""
    return counters(judged, collect_tests())


def write_collected(judged: DataFrame, path: str) -> DataFrame:
    """Write a run's decisions; returns its summary, counted while they are written."""
    return written_counts(judged, collect_tests(), lambda rows: rows.write.mode("append").parquet(path))


def preview_counts(judged: DataFrame) -> DataFrame:
    return counters(judged, {
        "total_items": F.lit(True),
        "keyword_matched": F.size("matched_keywords") > 0,
        "keep": F.col("verdict.relevant"),
        "drop": ~F.col("verdict.relevant"),
        "llm_drop": F.col("verdict.by") == "llm-drop",
    })


def backfill_tests() -> dict[str, Column]:
    return {
        "parsed": F.lit(True),
        "keyword_matched": F.size("matched_keywords") > 0,
        "skipped_duplicate": F.col("status").isin("duplicate", "existing"),
        "saved": F.col("status") == "saved",
    }


def backfill_summary(scanned: DataFrame, errors: DataFrame, judged: DataFrame) -> DataFrame:
    """Files, parse errors and outcomes of a backfill, as one row."""
    files = scanned.agg(F.count(F.lit(1)).alias("n")).scalar()
    bad = errors.agg(F.count(F.lit(1)).alias("n")).scalar()
    return counters(judged, backfill_tests()).select(files.alias("total_files"), "*", bad.alias("parse_errors"))


def article_metas(judged: DataFrame, origin_id: int, translations: DataFrame | None = None) -> DataFrame:
    """Saved articles in the stored meta shape, one row per article."""
    saved = judged.where("status = 'saved'")
    if translations is None:
        saved = saved.withColumns({"title_translated": F.lit(""), "content_translated": F.lit("")})
    else:
        saved = attach_translations(saved, translations, "identity", ["title", "content"])
    pictures = F.transform(
        "img_urls",
        lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("caption"), F.lit(None).cast("string").alias("s3Path")),
    )
    return saved.select(
        F.lit(origin_id).cast("long").alias("origin_id"),
        "item_hash", "identity", "title", "content", "writer",
        F.col("reg_dt").alias("writedate"),
        F.col("link").alias("currentUrl"),
        text_of("title_translated").alias("title_en"),
        text_of("content_translated").alias("content_text_en"),
        pictures.alias("img"),
        "guid",
        F.col("matched_keywords").alias("matchedKeywords"),
    )
