"""Keep-first, keep-last and merge operators.

All of them reduce on the map side first: a key that holds a third of all rows
leaves each task as one row, and no window ever sees a whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.urls import riss_id


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_per_key(rows: DataFrame, keys: str | Sequence[str], seq: str, copies: str = "copies") -> DataFrame:
    """Arrival position of each key's first row, and how many rows share the key."""
    return rows.groupBy(*_names(keys)).agg(F.min(seq).alias(seq), F.count(F.lit(1)).alias(copies))


def keep_first(rows: DataFrame, keys: str | Sequence[str], seq: str) -> DataFrame:
    """First row per key in arrival order.

    Only (key, seq) is aggregated; the wide rows are then picked by ``seq``,
    which is unique and so never skewed.
    """
    firsts = first_per_key(rows, keys, seq)
    return rows.join(firsts.select(seq), seq, "left_semi")


def keep_first_narrow(rows: DataFrame, keys: str | Sequence[str], seq: str) -> DataFrame:
    """As keep_first for narrow rows: one aggregation, no join."""
    names = _names(keys)
    rest = [c for c in rows.columns if c not in names]
    best = rows.groupBy(*names).agg(F.min_by(F.struct(*rest), seq).alias("_row"))
    return best.select(*names, "_row.*").select(*rows.columns)


def flag_first(rows: DataFrame, keys: str | Sequence[str], seq: str, flag: str = "is_first") -> DataFrame:
    """Every row, marked whether it is its key's first."""
    firsts = first_per_key(rows, keys, seq).select(seq, F.lit(True).alias(flag))
    return rows.join(firsts, seq, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def keep_last(rows: DataFrame, keys: str | Sequence[str], seq: str) -> DataFrame:
    """Last row per key: later entries overwrite earlier ones."""
    names = _names(keys)
    lasts = rows.groupBy(*names).agg(F.max(seq).alias(seq))
    return rows.join(lasts.select(seq), seq, "left_semi")


def first_place_last_value(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """One row per key: the place of the first occurrence, the values of the last."""
    rest = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(
        F.min(seq).alias(seq), F.max_by(F.struct(*rest), seq).alias("_row")
    ).select(key, seq, "_row.*")


def ordered_distinct(rows: DataFrame, keys: str | Sequence[str], value: str, seq: str, name: str) -> DataFrame:
    """Distinct values per key in order of first arrival, and the key's own first place.

    The first step leaves one row per (key, value), so the list that is then
    built is as long as the answer itself.
    """
    names = _names(keys)
    firsts = rows.groupBy(*names, value).agg(F.min(seq).alias("_seq"))
    gathered = F.array_sort(F.collect_list(F.struct("_seq", F.col(value).alias("_value"))))
    return firsts.groupBy(*names).agg(F.transform(gathered, lambda e: e["_value"]).alias(name), F.min("_seq").alias(seq))


def with_url_key(items: DataFrame) -> DataFrame:
    """Items with ``_url``: the url whose shortened digest is the source id, null where the service gave the id.

    Different urls may share the 12 characters, so items are the same only if this agrees too.
    """
    if "detail_url" not in items.columns:
        return items.withColumn("_url", F.lit(None).cast("string"))
    return items.withColumn("_url", F.when((F.col("source") == "riss") & (riss_id("detail_url") == ""), F.col("detail_url")))


def merge_by_source_id(items: DataFrame, seq: str = "seq") -> DataFrame:
    """First item per (source, source_id) kept whole, keywords gathered in arrival order.

    Source ids that are shortened digests count with their whole url.

    The wide items are shuffled once, by their unique place.
    """
    words = ordered_distinct(with_url_key(items), ["source", "source_id", "_url"], "matched_keyword", seq, "matched_keywords")
    return items.join(words.select(seq, "matched_keywords"), seq)


def without_stored(rows: DataFrame, stored: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet; only the keys of the history are read."""
    names = _names(keys)
    return rows.join(stored.select(*names), names, "left_anti")


def fill_missing(target: DataFrame, legacy: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """The target plus those legacy rows whose key it lacks."""
    return target.unionByName(without_stored(legacy, target, keys))


def array_first_by(values: Column, key) -> Column:
    """Array entries whose key did not occur earlier in the array."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


def merge_images(inline: Column, enclosure: Column) -> Column:
    """Pictures by base name: first inline size wins, the enclosure only if new."""
    from gleanmill.functions.urls import image_base

    listed = array_first_by(F.coalesce(inline, F.array().cast("array<string>")), image_base)
    extra = F.coalesce(enclosure, F.lit(""))
    new = (extra != "") & ~F.exists(listed, lambda u: image_base(u) == image_base(extra))
    return F.when(new, F.array_append(listed, extra)).otherwise(listed)
