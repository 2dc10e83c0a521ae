"""Parquet tables that grow by inserts and change by rewriting few partitions.

A table is partitioned by (origin_id, bucket, table_version): the bucket is a hash of
the key, so an origin that holds most rows is still rewritten in small parts.  A
rewrite adds a new version of the buckets it touches beside the old ones; which
version is read is said by the last list of versions that was written to its end,
so a rewrite that dies leaves the table as it was.  A table has one writer.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gleanmill.operators.dedupe import without_stored
from gleanmill.operators.verdicts import fresh, latest_verdicts
from gleanmill.session import cut_lineage

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


#: Version of rows that were only appended, and the folder of the lists of versions.
VERSION, FIRST, LIVE = "table_version", "v0", "_live"


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first write."""
    stored = _all_versions(spark, path)
    if stored is None or VERSION not in stored.columns:
        return stored
    live = live_versions(spark, path)
    if live is None:
        return stored.where(F.col(VERSION) == FIRST).drop(VERSION)
    place = [c for c in live.columns if c != "_live"]
    return stored.join(live, place, "left").where(F.col(VERSION) == F.coalesce("_live", F.lit(FIRST))).select(*[c for c in stored.columns if c != VERSION])


def _all_versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return None
        raise


def _last_commit(spark: SparkSession, path: str) -> int:
    """Number of the last list of versions that was written to its end; 0 before the first."""
    files, folder = _folder(spark, f"{path}/{LIVE}")
    if not files.exists(folder):
        return 0
    jvm = spark.sparkContext._jvm
    numbers = [int(entry.getPath().getName()) for entry in files.listStatus(folder)]
    done = [n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{LIVE}/{n}/_SUCCESS"))]
    return max(done, default=0)


def live_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(origin, bucket, _live) of the buckets that were ever rewritten, one row each; None if none was."""
    last = _last_commit(spark, path)
    return spark.read.parquet(f"{path}/{LIVE}/{last}") if last else None


def _append(rows: DataFrame, path: str, key: str, origin: str, buckets: int) -> None:
    """Append rows to the versions that are read."""
    rows = rows.withColumn("bucket", bucket_of(key, buckets))
    live = live_versions(rows.sparkSession, path)
    if live is None:
        rows = rows.withColumn(VERSION, F.lit(FIRST))
    else:
        names = rows.columns
        rows = rows.join(live, [origin, "bucket"], "left").select(*names, F.coalesce("_live", F.lit(FIRST)).alias(VERSION))
    rows.write.mode("append").partitionBy(origin, "bucket", VERSION).parquet(path)


def _replace(rows: DataFrame, path: str, origin: str) -> None:
    """Make ``rows`` (with their bucket) the whole content of the buckets they are in.

    The new version is written first and read by nobody; the list of versions
    that names it is the commit.
    """
    spark, version = rows.sparkSession, f"v{uuid.uuid4().hex}"
    rows.withColumn(VERSION, F.lit(version)).write.mode("append").partitionBy(origin, "bucket", VERSION).parquet(path)
    written = _all_versions(spark, path)
    if written is None:
        return
    # from the folders' names; a bucket without rows wrote none and is not touched
    touched = written.where(F.col(VERSION) == version).select(origin, "bucket").distinct().withColumn("_live", F.lit(version))
    last, live = _last_commit(spark, path), live_versions(spark, path)
    if live is not None:
        touched = live.join(touched, [origin, "bucket"], "left_anti").unionByName(touched)
    _commit(touched, path, last + 1)


def _commit(live: DataFrame, path: str, number: int) -> None:
    live.write.mode("overwrite").parquet(f"{path}/{LIVE}/{number}")


def vacuum(spark: SparkSession, path: str, origin: str = "origin_id") -> int:
    """Delete the versions that are no longer read, or never were; returns how many folders.

    For a time when nobody still reads an older state of the table.
    """
    stored, live, last = _all_versions(spark, path), live_versions(spark, path), _last_commit(spark, path)
    if stored is None or VERSION not in stored.columns:
        return 0
    folders = stored.select(origin, "bucket", VERSION).distinct()
    if live is None:
        dead = folders.where(F.col(VERSION) != FIRST)
    else:
        dead = folders.join(live, [origin, "bucket"], "left").where(F.col(VERSION) != F.coalesce("_live", F.lit(FIRST)))
    n = 0
    # names of folders, one at a time; rows stay where they are
    for r in cut_lineage(dead.select(origin, "bucket", VERSION)).toLocalIterator():
        remove_folder(spark, f"{path}/{origin}={r[origin]}/bucket={r['bucket']}/{VERSION}={r[VERSION]}")
        n += 1
    for number in range(1, last):
        remove_folder(spark, f"{path}/{LIVE}/{number}")
    return n


def insert_new(rows: DataFrame, path: str, key: str, origin: str = "origin_id", buckets: int = BUCKETS) -> DataFrame:
    """Append the rows whose (origin, key) the table lacks; returns what was added.

    The rows are the last thing a run writes: a row that failed earlier is not
    here, stays absent from the table, and is taken up again by the next run.
    """
    stored = read_table(rows.sparkSession, path)
    new = rows if stored is None else without_stored(rows, stored, [origin, key])
    new = cut_lineage(new)
    _append(new, path, key, origin, buckets)
    return new


def append_rows(rows: DataFrame, path: str, key: str, origin: str = "origin_id", buckets: int = BUCKETS) -> None:
    """Append rows whose keys are known to be new, without a look at the table."""
    _append(rows, path, key, origin, buckets)


def upsert(rows: DataFrame, path: str, key: str, origin: str = "origin_id", buckets: int = BUCKETS) -> None:
    """Overwrite rows of the same (origin, key), add the others.

    Only buckets that receive a row are rewritten, all of them or, if the write
    dies, none.
    """
    rows = cut_lineage(rows.withColumn("bucket", bucket_of(key, buckets)))
    stored = read_table(rows.sparkSession, path)
    if stored is not None:
        touched = rows.select(origin, "bucket").distinct()
        kept = stored.join(touched, [origin, "bucket"], "left_semi")
        rows = without_stored(kept, rows, [origin, "bucket", key]).unionByName(rows, allowMissingColumns=True)
    _replace(rows, path, origin)


def rewrite_changed(path: str, changes: DataFrame, key: str, fields: Sequence[str], origin: str = "origin_id", buckets: int = BUCKETS) -> None:
    """New values for the given fields of existing keys; other rows keep theirs.

    changes: origin, key and the new values under the same names.  Changes are
    seen all at once or, if the write dies, not at all.
    """
    stored = read_table(changes.sparkSession, path)
    new = cut_lineage(changes.withColumn("bucket", bucket_of(key, buckets)).select(
        origin, "bucket", key, F.struct(*fields).alias("_new")
    ))
    touched = new.select(origin, "bucket").distinct()
    kept = stored.join(touched, [origin, "bucket"], "left_semi")
    merged = kept.join(new, [origin, "bucket", key], "left").withColumns({
        f: F.when(F.col("_new").isNotNull(), F.col(f"_new.{f}")).otherwise(F.col(f)) for f in fields
    })
    _replace(merged.select(*stored.columns), path, origin)


#: Buckets of a verdict store, and deltas of a bucket that are merged into one.
VERDICT_BUCKETS, DELTAS = 16, 8


def read_verdicts(spark: SparkSession, path: str, as_of: Column | None = None, expiring: Sequence[str] = ("news",)) -> DataFrame | None:
    """The verdicts of a store, one per key, without those that have expired; None before its first flush.

    Deltas that overlap, as a compaction that was cut short leaves them, agree
    after that, so a reader never sees a verdict twice or none.
    """
    stored = read_table(spark, path)
    if stored is None:
        return None
    kept = latest_verdicts(stored)
    return kept if as_of is None else kept.where(~F.col("classifier").isin(*expiring) | fresh(as_of))


def flush_verdicts(path: str, new: DataFrame, as_of: Column, expiring: Sequence[str] = ("news",)) -> bool:
    """Add new verdicts as a delta: what is written and read is in proportion to the news.

    One verdict per key; expired ones are left out.  The delta is one Spark
    append, so a flush that fails adds nothing and loses nothing.  Without news
    nothing is written.
    """
    kept = latest_verdicts(new).where(~F.col("classifier").isin(*expiring) | fresh(as_of))
    rows = cut_lineage(kept.withColumn("bucket", bucket_of("key", VERDICT_BUCKETS)))
    if rows.isEmpty():
        return False
    _append_delta(rows, path)
    return True


def _append_delta(rows: DataFrame, path: str) -> str:
    name = uuid.uuid4().hex
    rows.withColumn("delta", F.lit(f"d{name}")).repartition("classifier", "bucket").write.mode("append").partitionBy(
        "classifier", "bucket", "delta"
    ).parquet(path)
    return name


def compact_verdicts(path: str, spark: SparkSession, as_of: Column, most: int = DELTAS, expiring: Sequence[str] = ("news",)) -> int:
    """Merge the deltas of buckets that have more than ``most``; returns how many buckets.

    A bucket's verdicts are first written as one new delta, expired ones left out,
    and only then are the deltas they came from deleted.  A run that dies between
    leaves both, which read the same; no other bucket is touched.
    """
    stored = read_table(spark, path)
    if stored is None:
        return 0
    deltas = stored.select("classifier", "bucket", "delta").distinct()
    full = deltas.groupBy("classifier", "bucket").agg(F.collect_list("delta").alias("deltas")).where(F.size("deltas") > most)
    # names of folders, a bounded number of deltas for each of a fixed number of buckets
    old = [(r["classifier"], r["bucket"], r["deltas"]) for r in full.collect()]
    if not old:
        return 0
    chosen = stored.join(F.broadcast(full.select("classifier", "bucket")), ["classifier", "bucket"], "left_semi")
    merged = latest_verdicts(chosen).where(~F.col("classifier").isin(*expiring) | fresh(as_of))
    _append_delta(cut_lineage(merged.withColumn("bucket", bucket_of("key", VERDICT_BUCKETS))), path)
    for classifier, bucket, names in old:
        for name in names:
            remove_folder(spark, f"{path}/classifier={classifier}/bucket={bucket}/delta={name}")
    return len(old)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table where the table lives."""
    files, folder = _folder(spark, path)
    files.delete(folder, True)


def _folder(spark: SparkSession, path: str):
    """The file system of a folder, and the folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def write_run_logs(logs: DataFrame, path: str) -> None:
    """A JSON object per run and line, in a folder per configId and day; ``sources.stored.run_logs`` reads it."""
    logs.withColumn("date", F.date_format("startedAt", "yyyy-MM-dd")).write.mode("append").partitionBy(
        "configId", "date"
    ).json(path)


def write_dated_json(rows: DataFrame, path: str, name: str, day: str, category: str) -> None:
    """{name}/{day}/{category} folders of JSON."""
    rows.withColumns({"name": F.lit(name), "day": F.lit(day), "category": F.lit(category)}).write.mode(
        "append"
    ).partitionBy("name", "day", "category").json(path)


def write_sorted_text(lines: DataFrame, path: str, line: str = "line") -> None:
    """A sorted frame as text part files whose concatenation, by name, is the document."""
    lines.select(F.col(line).alias("value")).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, target: str, **jdbc: str) -> None:
    """Append to a JDBC table, or to parquet when no url is given."""
    if jdbc:
        rows.write.mode("append").format("jdbc").options(dbtable=target, **jdbc).save()
    else:
        rows.write.mode("append").parquet(target)
