"""Poll the landing folder of the feed, judge new items, add them to the table.

Which identities are stored is keyed state of the stream, fed by the table's own
files as a second source, so a batch reads what is new in the landing folder and
in the table and never the table's history.  Identities that were offered before
but are not known to be stored (dropped by a rule or a verdict, or saved a moment
ago) are offered again: they are the retries, and only they are looked up in the
table, in the buckets they belong to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StructField, StructType

from gleanmill.functions.urls import article_identity
from gleanmill.plans.collect import article_metas, judged_articles
from gleanmill.rules.cascades import NewsRules
from gleanmill.session import STATE_STORE
from gleanmill.sinks.tables import append_rows, bucket_of, insert_new, read_table
from gleanmill.sources.news import articles_from_rss, rss_reader


def feed_items(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of feed articles, repeated items included."""
    return articles_from_rss(rss_reader(spark.readStream, landing))


def first_offers(stream: DataFrame, stored: DataFrame, key: str, order: list[str], again: str = "again") -> DataFrame:
    """Per batch the first row of each key that ``stored`` has not named yet.

    ``stored`` is a stream of keys (one column, ``key``).  A key it names, earlier
    or in the same batch, is never offered any more.  Other keys are offered
    once per batch in which they arrive, their first row by ``order``; ``again``
    says that an earlier batch offered the key, too.  The state is one short
    number per key.
    """
    spark = stream.sparkSession
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    shape = StructType([*stream.schema.fields, StructField(again, BooleanType())])
    names = [f.name for f in stream.schema.fields]
    rows = F.struct(*names)
    places = [f"_o{i}" for i in range(len(order))]
    offered = stream.select(F.col(key).alias("_key"), F.to_json(rows).alias("_row"), *[F.col(o).alias(p) for o, p in zip(order, places)])
    known = stored.select(F.col(key).alias("_key"))
    # in a row of the table's stream the other columns are null
    both = offered.unionByName(known, allowMissingColumns=True).where("_key IS NOT NULL")

    def decide(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0  # 1: offered, 2: stored
        best = None
        now_stored = seen == 2
        for part in parts:  # plain lists: most keys have few rows, and a frame of them costs more than they do
            # null places come last
            ranks = [[(pd.isna(v), None if pd.isna(v) else v) for v in part[p].tolist()] for p in places]
            for at, row in enumerate(part["_row"].tolist()):
                if row is None:
                    now_stored = True
                elif best is None or [*(r[at] for r in ranks), row] < best:
                    best = [*(r[at] for r in ranks), row]
        if now_stored:
            state.update((2,))
        elif best is not None:
            state.update((1,))
            yield pd.DataFrame({"_row": [best[-1]], again: [seen == 1]})

    decided = both.groupBy("_key").applyInPandasWithState(
        decide, f"_row string, {again} boolean", "seen int", "append", GroupStateTimeout.NoTimeout
    )
    row_type = StructType(shape.fields[:-1])
    return decided.select(F.from_json("_row", row_type).alias("_row"), again).select("_row.*", again)


def stored_keys(spark: SparkSession, table: str, key: str = "identity", kind: str = "string") -> DataFrame:
    """Stream of the keys in a table's files; an absent table begins as an empty folder."""
    if read_table(spark, table) is None:
        spark.createDataFrame([], f"{key} {kind}").write.mode("append").parquet(table)
    return spark.readStream.schema(f"{key} {kind}").parquet(table).select(key)


def first_attempt(spark: SparkSession, checkpoint: str, batch_id: int) -> bool:
    """Whether a batch is tried for the first time; the try is noted before anything is written."""
    path = f"{checkpoint.rstrip('/')}/attempts/batch={batch_id}"
    if read_table(spark, path) is not None:
        return False
    spark.range(1).write.mode("overwrite").parquet(path)
    return True


def batch_writer(
    table: str,
    origin_id: int,
    verdicts: Callable[[], tuple[DataFrame, DataFrame]],
    checkpoint: str,
    rules: NewsRules = NewsRules(),
    **switches: bool,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: a batch that is tried again adds nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        replayed = not first_attempt(spark, checkpoint, batch_id)
        store, replies = verdicts()
        # arrival order inside a batch: capture file, then identity
        ordered = batch.withColumn("seq", F.struct("captured_at", "capture", "identity")).persist()
        try:
            for again, stored in ((False, None), (True, read_table(spark, table))):
                rows = ordered.where(F.lit(True) if replayed and again else F.lit(False) if replayed else F.col("again") == again)
                if rows.isEmpty():
                    continue
                if stored is not None and "bucket" in stored.columns:
                    # at most one row per origin and bucket, so small enough to be broadcast
                    buckets = rows.select(bucket_of("identity").alias("bucket")).distinct()
                    stored = stored.where(F.col("origin_id") == origin_id).join(F.broadcast(buckets), "bucket", "left_semi")
                else:
                    stored = None
                judged = judged_articles(rows.drop("identity", "again"), stored, store, replies, rules=rules, **switches)
                metas = article_metas(judged, origin_id)
                if again:
                    insert_new(metas, table, "identity")
                else:
                    append_rows(metas, table, "identity")
        finally:
            ordered.unpersist()

    return write


def poll(
    spark: SparkSession,
    landing: str,
    table: str,
    checkpoint: str,
    origin_id: int,
    verdicts: Callable[[], tuple[DataFrame, DataFrame]],
    every: str | None = "5 minutes",
    **options,
) -> StreamingQuery:
    """Start the poll; ``every=None`` takes what is there and stops.

    One query per checkpoint is the guard against two runs at once.
    """
    items = feed_items(spark, landing).withColumn("identity", article_identity("guid", "link"))
    offers = first_offers(items, stored_keys(spark, table), "identity", ["captured_at", "capture", "link"])
    writer = offers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        batch_writer(table, origin_id, verdicts, checkpoint, **options)
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**trigger).start()
