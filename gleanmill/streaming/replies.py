"""Replies that arrive after the rows they answer.

A pending row waits a bounded time for its reply.  The wait is a left outer join
in event time, so the same expression is a batch job over tables and a stream
whose state holds the rows of one wait, not the history.  What is not answered
in time takes the verdict of the rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanmill.functions.values import relevant_unless_false
from gleanmill.session import STATE_STORE
from gleanmill.sinks.tables import read_table


def answered_rows(
    pending: DataFrame,
    replies: DataFrame,
    key: str = "key",
    asked: str = "asked_at",
    replied: str = "replied_at",
    wait: str = "2 days",
    late: str = "12 hours",
) -> DataFrame:
    """Pending rows with ``_reply`` and ``_replied`` of each reply that came within ``wait``, or nulls.

    Both frames are tables or both are streams.  On streams a row is given out
    with its reply at once, and without one when the watermark (the slower
    side's latest time, less ``late``) has passed the end of its wait.  A null
    key meets nothing and times out.  ``asked`` and ``replied`` are stamped by
    whoever writes the rows and never null.  A row may come once per reply.
    """
    if pending.isStreaming:
        for name, value in STATE_STORE.items():
            pending.sparkSession.conf.set(name, value)
    answers = replies.select(F.col(key).alias("_key"), F.col(replied).alias("_replied"), F.col("reply_text").alias("_reply"))
    on_time = (F.col("_replied") >= F.col(asked)) & (F.col("_replied") <= F.col(asked) + F.expr(f"INTERVAL {wait}"))
    return (
        pending.withWatermark(asked, late)
        .join(answers.withWatermark("_replied", late), (F.col(key) == F.col("_key")) & on_time, "left_outer")
        .drop("_key")
    )


def reply_verdicts(
    answered: DataFrame,
    key: str = "key",
    rule: str = "rule",
    asked: str = "asked_at",
    wait: str = "2 days",
    reading: Callable[[str], Column] = relevant_unless_false,
) -> DataFrame:
    """(key, asked, relevant, by, reason, decided_at, ok, reply) of each answered row.

    ``rule`` is the struct(relevant, reason) a row falls back to when its reply
    is missing or cannot be read.
    """
    read, r = reading("_reply"), F.col(rule)
    ok = F.coalesce(read["ok"], F.lit(False))
    return answered.select(
        key,
        asked,
        F.when(ok, read["value"]).otherwise(r["relevant"]).alias("relevant"),
        F.when(ok, F.when(read["value"], "llm-keep").otherwise("llm-drop"))
        .otherwise(F.when(r["relevant"], "llm-error-keep").otherwise("rule-drop")).alias("by"),
        F.when(ok, read["reason"]).otherwise(r["reason"]).alias("reason"),
        F.when(ok, F.col("_replied")).otherwise(F.col(asked) + F.expr(f"INTERVAL {wait}")).alias("decided_at"),
        ok.alias("ok"),
        F.col("_reply").alias("reply"),
    )


def settled(verdicts: DataFrame, key: str = "key", asked: str = "asked_at") -> DataFrame:
    """One verdict per (key, asked): the first readable reply's, ties by its text, else the rule's.

    Partial aggregation keeps a row that was answered very often from meeting in
    one task.  A reply that a stream adds later can only replace a fallback or an
    equal time.
    """
    values = F.struct("relevant", "by", "reason", "decided_at")
    place = F.struct(~F.col("ok"), "decided_at", F.coalesce("reply", F.lit("")))
    return verdicts.groupBy(key, asked).agg(F.min_by(values, place).alias("_v")).select(key, asked, "_v.*")


def follow_replies(verdicts: DataFrame, path: str, checkpoint: str, every: str | None = "5 minutes") -> StreamingQuery:
    """Write a stream of verdicts as a folder per batch; ``every=None`` takes what is there and stops.

    A batch that is tried again overwrites its own folder and adds nothing twice.
    """
    writer = verdicts.writeStream.option("checkpointLocation", checkpoint).outputMode("append").foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    )
    return writer.trigger(**({"availableNow": True} if every is None else {"processingTime": every})).start()


def read_replies(spark, path: str, key: str = "key", asked: str = "asked_at") -> DataFrame | None:
    """The settled verdicts a stream has written so far; None before its first batch."""
    written = read_table(spark, path)
    return None if written is None else settled(written, key, asked)
