"""A left lookup that no hot key can turn into one long task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy when it holds more than one row in SHARE.  Fewer than SHARE
# keys can be heavy, which bounds what is broadcast whatever the data's size.
SHARE = 1000
SPREAD = 4096


def attach(rows: DataFrame, table: DataFrame, key: str, values: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """rows left-joined with ``values`` of a table that has one row per key.

    Heavy keys are looked up in a broadcast of fewer than SHARE table rows and
    their rows, like rows without a key, are then dealt out by ``spread``
    instead of meeting in their key's partition.  All other keys take the
    ordinary join.  ``rows`` is read twice, so a long lineage should be cut
    before.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).scalar()
    found = F.struct(*values)
    heavy = (
        counts.where(F.col("_n") * SHARE > total)
        .select(key)
        .join(table.select(key, found.alias("_heavy_value")), key, "left")
        .withColumn("_is_heavy", F.lit(True))
    )
    marked = rows.join(F.broadcast(heavy), key, "left")
    apart = F.col("_is_heavy").isNotNull() | F.col(key).isNull()
    salt = F.when(apart, 1 + F.pmod(F.xxhash64(*spread), F.lit(SPREAD))).otherwise(0)
    # one struct, not two columns: a constant column of the table would be
    # folded into a filter, and the join would hash the bare key again
    salted = marked.withColumn("_at", F.struct(F.col(key).alias("k"), salt.alias("salt")))
    place = F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("salt"))
    light = table.select(place.alias("_at"), found.alias("_light_value"))
    joined = salted.join(light, "_at", "left")
    value = F.coalesce("_heavy_value", "_light_value")
    return joined.select(*rows.columns, *[value[v].alias(v) for v in values])
