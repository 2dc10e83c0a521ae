"""Load of stored article metas into the news and news_file tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.dates import UNREADABLE, article_date
from gleanmill.functions.text import text_of, translated_flag
from gleanmill.operators.dedupe import flag_first
from gleanmill.operators.files import file_rows, skipped_files
from gleanmill.operators.joins import join_dimensions
from gleanmill.operators.lookup import attach
from gleanmill.operators.numbering import with_ids
from gleanmill.operators.rollups import counters
from gleanmill.plans.export import _with_name
from gleanmill.session import cut_lineage


def judged_loads(metas: DataFrame, news: DataFrame, seq: str = "seq") -> DataFrame:
    """Metas with ``status``: batch_duplicate, table_duplicate or inserted.

    The batch keeps its first row of (title, writer, day) even when the table
    then rejects that row; the table is compared by (origin, title, day).
    """
    day = F.coalesce(article_date("writedate", keep_time=False), F.lit(UNREADABLE))
    narrow = metas.select(
        seq, "origin_id", "title", text_of("title").alias("_t"), text_of("writer").alias("_w"), day.alias("reg_dt")
    ).withColumn("reg_day", F.left("reg_dt", F.lit(10)))
    marked = flag_first(narrow, ["origin_id", "_t", "_w", "reg_day"], seq)
    # a null title never counts as known
    place = F.when(F.col("title").isNotNull(), F.struct("origin_id", "title", "reg_day")).alias("_place")
    known = (
        news.where("title is not null")
        .withColumn("reg_day", F.date_format("reg_dt", "yyyy-MM-dd"))
        .select(place, F.lit(True).alias("_known"))
        .distinct()
    )
    joined = attach(marked.select(seq, "is_first", "reg_dt", place), known, "_place", ["_known"], [seq])
    status = (
        F.when(~F.col("is_first"), "batch_duplicate")
        .when(F.coalesce("_known", F.lit(False)), "table_duplicate")
        .otherwise("inserted")
    )
    # decided once on a narrow frame; the articles themselves are shuffled once, by their unique place
    return metas.join(cut_lineage(joined.select(seq, "reg_dt", status.alias("status"))), seq)


def news_rows(
    judged: DataFrame, origin: DataFrame, category: DataFrame, news: DataFrame, now: str, seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """(rows for the news table, rows whose origin is unknown).

    Ids follow load order from the highest existing id; they are numbered over
    (seq) alone and joined back.
    """
    new = judged.where("status = 'inserted'")
    named = cut_lineage(join_dimensions(cut_lineage(new.select(seq, "origin_id")), origin, category, seq))
    missing = new.join(named.where("not has_origin").select(seq), seq, "left_semi").select(
        seq, "origin_id", F.col("currentUrl").alias("link_url")
    )
    good = named.where("has_origin").drop("origin_id")
    ids = with_ids(good.select(seq), [seq], news, "news_id")
    rows = new.join(good.join(ids, seq), seq)
    loaded = rows.select(
        "news_id", "title",
        F.col("content").alias("content_text"),
        "origin_id", "origin_nm",
        F.col("currentUrl").alias("link_url"),
        "category_nm",
        F.col("category_code").alias("category_id"),
        F.lit("ko").alias("lang_code"),
        translated_flag("title_en", "content_text_en").alias("trsl_yn"),
        F.lit("Y").alias("use_yn"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit("admin").alias("rgtr_id"),
        F.to_timestamp("reg_dt").alias("reg_dt"),
        F.lit("admin").alias("mdfr_id"),
        F.lit(now).alias("mdfcn_dt"),
        "title_en", "content_text_en", "origin_nm_en", "category_nm_en",
        F.lit(now).alias("crawl_dt"),
        "img", "file",
    )
    return loaded, missing


def news_file_rows(loaded: DataFrame, news_file: DataFrame, now: str) -> DataFrame:
    """Rows for the news_file table, ids following (news_id, list, order)."""
    lists = F.array(
        F.struct(F.lit(0).alias("list_no"), file_rows(_with_name(F.col("img"))).alias("rows")),
        F.struct(F.lit(1).alias("list_no"), file_rows(F.col("file"), name_field=True).alias("rows")),
    )
    flat = loaded.select("news_id", F.inline(lists)).select("news_id", "list_no", F.inline("rows"))
    narrow = flat.select("news_id", "list_no", "sort_order", "file_path", "file_url", "file_ty")
    numbered = with_ids(narrow, ["news_id", "list_no", "sort_order"], news_file, "file_id")
    return numbered.select(
        "file_id", "news_id", "file_path", "file_url", "file_ty", "sort_order",
        F.lit("Y").alias("use_yn"), F.lit("admin").alias("rgtr_id"), F.lit(now).alias("reg_dt"), F.lit("ko").alias("lang_code"),
    )


def load_counters(judged: DataFrame) -> DataFrame:
    inserted = F.col("status") == "inserted"
    files = F.size(file_rows(_with_name(F.col("img")))) + F.size(file_rows(F.col("file"), name_field=True))
    skipped = skipped_files(F.col("img"), F.col("file"))
    counts = judged.agg(
        F.count(F.lit(1)).alias("total_meta"),
        F.count_if(inserted).alias("inserted"),
        F.count_if(~inserted).alias("skipped_duplicate"),
        F.coalesce(F.sum(F.when(inserted, files)), F.lit(0)).cast("long").alias("file_inserted"),
        F.coalesce(F.sum(F.when(inserted, skipped)), F.lit(0)).cast("long").alias("file_skipped"),
    )
    return counts
