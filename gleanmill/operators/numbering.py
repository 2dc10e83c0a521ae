"""Positions in a total order, without passing all rows through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.session import cut_lineage


def with_position(
    rows: DataFrame, order: Sequence[str], within: Sequence[str] = (), name: str = "position"
) -> DataFrame:
    """0-based position of each row in ``order``, overall or within groups.

    Rows are range-partitioned by (within, order), so even a group that holds a
    third of all rows is spread over many tasks.  Positions count inside each
    partition; what earlier partitions held is added from a frame with at most
    one row per partition, which is why that frame may be broadcast.  The sorted
    rows are staged as a table first: sampling picks the range bounds, and both
    passes must see the same ones.  ``order`` must be unique within its group,
    and callers pass narrow rows and join the position back.
    """
    keys = [*within, *order]
    sorted_rows = (
        rows.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    stable = cut_lineage(sorted_rows)

    pieces = stable.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_start"))
    # one row per partition at most: only a group that began in an earlier
    # partition has rows before this one, and a partition starts in one group
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .where(F.col("_before") > 0)
        .select("_part", *within, "_before")
    )
    if within:
        own = Window.partitionBy("_part", *within).orderBy("_at")
        local = stable.withColumn("_local", F.row_number().over(own) - 1)
    else:
        local = stable.withColumn("_local", F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33))
    on = [local["_part"] == offsets["_part"]] + [local[k].eqNullSafe(offsets[k]) for k in within]
    joined = local.join(F.broadcast(offsets), on, "left")
    position = (local["_local"] + F.coalesce(offsets["_before"], F.lit(0))).cast("long")
    return joined.select(*[local[c] for c in rows.columns], position.alias(name))


def with_ids(rows: DataFrame, order: Sequence[str], table: DataFrame, id_column: str) -> DataFrame:
    """Sequential ids from the table's highest id plus one, in load order."""
    highest = table.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("long").alias("m")).scalar()
    numbered = with_position(rows, order, name="_pos")
    return numbered.withColumn(id_column, F.col("_pos") + 1 + highest).drop("_pos")


def with_batches(rows: DataFrame, order: Sequence[str], size: int, within: Sequence[str] = ()) -> DataFrame:
    """Fixed-size batches: batch_id from 0, i from 1 inside the batch."""
    numbered = with_position(rows, order, within, "_pos")
    return (
        numbered.withColumn("batch_id", F.floor(F.col("_pos") / size).cast("long"))
        .withColumn("i", (F.col("_pos") % size + 1).cast("long"))
        .drop("_pos")
    )
