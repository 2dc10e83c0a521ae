"""What several of these operators need: words, bindings, staged tables, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanmill.session import prepare, shared_dir

#: A word is a run of anything but the ASCII blanks.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Arrow batches carry whole texts, so their size is bounded in bytes besides rows.
ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


def prepared(spark: SparkSession) -> SparkSession:
    prepare(spark)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def stage(rows: DataFrame) -> DataFrame:
    """Write rows to the folder all executors share and go on from the table.

    Computed once, read by column, and unchanged when an executor is lost.
    """
    path = f"{shared_dir(rows.sparkSession).rstrip('/')}/staged-{uuid.uuid4().hex}"
    written(rows, path, compression="zstd")
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


#: Shuffle files of a query go when it ends; without it they stay until the driver's JVM happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame, path: str, **options: str) -> None:
    """Write rows as Parquet and leave no shuffle files, since the table is what is read from then on.

    Only for the write: a frame that is run twice would have to shuffle again.
    """
    conf = rows.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        rows.write.options(**options).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null, empty or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def word_count(text: Column) -> Column:
    """How many words a text has, without building them (long; null text: 0)."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marks, GAP, "")).cast("long")


def held_out(doc_id: Column, of: int, part: int) -> Column:
    """Whether crc32 of the id's text leaves this remainder (null id: crc32 of an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of)) == part


def running_total(
    rows: DataFrame, group: str, bucket: str, order: Sequence[str], value: Column, name: str
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group, in (bucket, order).

    A group is dealt out by bucket, so that one with a third of all rows fills
    many tasks: totals per bucket are pre-aggregated and summed in a window over
    one row per bucket, and only a bucket's own rows are ever sorted together.
    ``group`` and ``bucket`` hold no nulls.
    """
    counted = rows.withColumn("_value", value)
    earlier = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        counted.groupBy(group, bucket).agg(F.sum("_value").alias("_sum"))
        .select(group, bucket, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = counted.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (
        local.join(before, [group, bucket])
        .withColumn(name, (F.col("_before") + F.col("_local")).cast("long"))
        .drop("_value", "_before", "_local")
    )


#: Bits of the filter below: 8 MB, whatever the number of members.
FILTER_BITS = 1 << 26


def perhaps_among(rows: DataFrame, key: Sequence[str], members: DataFrame) -> DataFrame:
    """Rows whose key may be one of the members', so that an exact join moves few others."""
    return marked_among(rows, key, members, "_among").where("_among").drop("_among")


def marked_among(rows: DataFrame, key: Sequence[str], members: DataFrame, name: str) -> DataFrame:
    """``rows`` with a flag: false only where the key is none of the members'.

    One bit per hashed key, in bitmaps whose total size is fixed; that bound is
    why they may be broadcast.  With very many members more rows are marked, never fewer.
    """
    place = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    maps = members.groupBy(F.bitmap_bucket_number(place).alias("_map")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")
    )
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = rows.withColumn("_map", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "_map", "left")
    bit = byte.bitwiseAND(F.pow(F.lit(2), F.pmod(at, F.lit(8))).cast("int")) != 0
    return marked.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_map", "_bits")
