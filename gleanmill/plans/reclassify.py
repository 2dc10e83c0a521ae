"""Recompute menus and categories of stored archive metas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.operators.verdicts import confirm_institution
from gleanmill.rules import vocabulary as V
from gleanmill.rules.cascades import institution_rule, material_by_register, menu_of, register_kind


def by_register(metas: DataFrame, store: DataFrame, replies: DataFrame) -> DataFrame:
    """Category by register prefix and menu by today's rules.

    metas: origin_id, item_hash, register_no, publisher, menu_id, category.
    Rows of another prefix are left out.
    """
    kinds = F.create_map(*[
        x for k, (label, english, _) in V.REGISTER_KINDS.items()
        for x in (F.lit(k), F.struct(F.lit(label).alias("label"), F.lit(english).alias("english")))
    ])
    rows = metas.withColumn("_kind", F.try_element_at(kinds, register_kind("register_no"))).where("_kind is not null")
    return _with_new_menu(rows, store, replies).withColumns({
        "new_category": F.col("_kind.label"), "new_category_en": F.col("_kind.english")
    }).drop("_kind")


def by_theme(metas: DataFrame, themes: DataFrame, store: DataFrame, replies: DataFrame) -> DataFrame:
    """Category by assigned theme, menu by today's rules, no English category."""
    rows = metas.join(themes.select("register_no", "theme"), "register_no", "left")
    return _with_new_menu(rows, store, replies).withColumns({
        "new_category": F.coalesce("theme", F.lit(V.THEME_FALLBACK)), "new_category_en": F.lit(None).cast("string")
    }).drop("theme")


def _with_new_menu(rows: DataFrame, store: DataFrame, replies: DataFrame) -> DataFrame:
    ruled = rows.withColumn("institution_rule", institution_rule("publisher"))
    decided = confirm_institution(ruled, store, replies, out="new_classification", seq="register_no").drop("institution_rule")
    return decided.withColumn("new_menu", menu_of(material_by_register("register_no"), "new_classification.verdict"))


def changed(recomputed: DataFrame) -> DataFrame:
    return recomputed.where(
        ~F.col("menu_id").eqNullSafe(F.col("new_menu")) | ~F.col("category").eqNullSafe(F.col("new_category"))
    )
