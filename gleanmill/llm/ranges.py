"""Searches over a long array held as rows (at, ...), in blocks with sparse tables of their own.

A block answers from its sparse table: row k of the table holds the minimum of
every run of 2^k values, so the minimum of any range is one of two entries, and
a binary search steps by falling powers of two.  What a block cannot answer is
asked of the array of block minima, which is a shorter array of the same kind;
so no task ever holds more than one block and the questions put to it, and the
number of rounds is the logarithm of the length to the base BLOCK.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import stage

BLOCK = 256


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row k: the minimum of the 2^k values from each place on."""
    rows, width = [values], 1
    while 2 * width <= len(values):
        rows.append(np.minimum(rows[-1][:-width], rows[-1][width:]))
        width *= 2
    return rows


def least_of(table: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum over each inclusive range, from two overlapping runs."""
    out = np.empty(len(low), table[0].dtype)
    power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    for k in np.unique(power).tolist():
        mine = power == k
        out[mine] = np.minimum(table[k][low[mine]], table[k][high[mine] - (1 << k) + 1])
    return out


def below_left(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Per question the largest place <= start whose value is below depth; -1: none here."""
    at = start.copy()
    for k in range(len(table) - 1, -1, -1):
        runs = at - (1 << k) + 1
        skip = (runs >= 0) & (table[k][np.maximum(runs, 0)] >= depth)
        at[skip] -= 1 << k
    return at


def below_right(table: list[np.ndarray], start: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Per question the smallest place >= start whose value is below depth; the length: none here."""
    mirrored = [row[::-1] for row in table]
    n = len(table[0])
    return n - 1 - below_left(mirrored, n - 1 - start, depth)


def blocked(rows: DataFrame, at: str = "at") -> DataFrame:
    return rows.withColumn("block", F.floor(F.col(at) / BLOCK).cast("long"))


def _search(values: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """Answers of one block; ``found`` is missing where the block has none."""
    asks = asks.copy()
    found = np.full(len(asks), -1, np.int64)
    if len(values):
        values = values.sort_values("at")
        first, table = int(values["at"].iloc[0]), sparse_table(values["v"].to_numpy(np.int64))
        n = len(table[0])
        start, depth = asks["start"].to_numpy(np.int64) - first, asks["depth"].to_numpy(np.int64)
        left = asks["to_left"].to_numpy(bool)
        for side, search in ((left, below_left), (~left, below_right)):
            inside = side & (start >= 0) & (start < n)
            place = search(table, start[inside], depth[inside])
            found[inside] = np.where((place >= 0) & (place < n), place + first, -1)
    asks["found"] = pd.array(np.where(found < 0, 0, found), "Int64")
    asks.loc[found < 0, "found"] = pd.NA
    return asks[["block", "start", "depth", "to_left", "found"]]


def _local(values: DataFrame, asks: DataFrame) -> DataFrame:
    return blocked(values).groupBy("block").cogroup(asks.groupBy("block")).applyInPandas(
        _search, "block long, start long, depth long, to_left boolean, found long"
    )


def nearest_below(values: DataFrame, asks: DataFrame) -> DataFrame:
    """Per question (start, depth, to_left): the nearest place with a value below depth, as ``found``.

    To the left that is the largest place <= start, to the right the smallest
    >= start; null: there is none.  ``values`` are (at, v) for all places from 0.
    """
    values = values.select("at", "v")
    asks = asks.select("start", "depth", "to_left").distinct()
    local = stage(_local(values, blocked(asks, "start")))
    if not values.where(F.col("at") >= BLOCK).head(1):
        return local.drop("block")
    above = stage(blocked(values).groupBy("block").agg(F.min("v").alias("v")).withColumnRenamed("block", "at"))
    next_block = F.when(F.col("to_left"), F.col("block") - 1).otherwise(F.col("block") + 1)
    lost = local.where("found IS NULL").withColumn("next", next_block)
    blocks = nearest_below(above, lost.select(F.col("next").alias("start"), "depth", "to_left"))
    asked_on = blocks.where("found IS NOT NULL").select(
        F.col("start").alias("next"), "depth", "to_left", F.col("found").alias("block"),
        F.when(F.col("to_left"), F.col("found") * BLOCK + BLOCK - 1).otherwise(F.col("found") * BLOCK).alias("start"),
    )
    # the last block may be short, so its questions start at its last place
    last = values.agg(F.max("at")).scalar()
    asked_on = asked_on.withColumn("start", F.least("start", last))
    answers = _local(values, asked_on.select("block", "start", "depth", "to_left").distinct())
    answered = asked_on.join(answers, ["block", "start", "depth", "to_left"]).select("next", "depth", "to_left", "found")
    far = lost.drop("found").join(answered, ["next", "depth", "to_left"], "left")
    return local.where("found IS NOT NULL").drop("block").unionByName(far.select("start", "depth", "to_left", "found"))


def _totals(sums: Sequence[str]):
    def totals(values: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        if not len(asks):
            return asks.assign(least=[], **{s: [] for s in sums})[["low", "high", "least", *sums]]
        values = values.sort_values("at")
        first = int(values["at"].iloc[0])
        low, high = asks["from"].to_numpy(np.int64) - first, asks["to"].to_numpy(np.int64) - first
        out = {"low": asks["low"], "high": asks["high"], "least": least_of(sparse_table(values["least"].to_numpy(np.int64)), low, high)}
        for s in sums:
            running = np.concatenate([[0], np.cumsum(values[s].to_numpy(np.int64))])
            out[s] = running[high + 1] - running[low]
        return pd.DataFrame(out)

    return totals


def range_totals(values: DataFrame, sums: Sequence[str], asks: DataFrame) -> DataFrame:
    """Per inclusive range (low, high) of places: the minimum of ``least`` and the sums of columns.

    A range is its part of the first block, its part of the last, and whole
    blocks between, which are a range of the shorter array of block totals.
    """
    asks = asks.select("low", "high").distinct()
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    piece = lambda b, a, z: F.struct(b.alias("block"), a.cast("long").alias("from"), z.cast("long").alias("to"))
    b, e = block("low"), block("high")
    pieces = F.when(b == e, F.array(piece(b, F.col("low"), F.col("high")))).otherwise(
        F.array(piece(b, F.col("low"), (b + 1) * BLOCK - 1), piece(e, e * BLOCK, F.col("high")))
    )
    parts = asks.select("low", "high", F.explode(pieces).alias("p")).select("low", "high", "p.*")
    added = "".join(f", {s} long" for s in sums)
    held = blocked(values.select("at", "least", *sums))
    found = held.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(_totals(sums), f"low long, high long, least long{added}")
    totals = [F.min("least").alias("least"), *[F.sum(s).alias(s) for s in sums]]
    if values.where(F.col("at") >= 2 * BLOCK).head(1):
        above = stage(held.groupBy("block").agg(*totals).withColumnRenamed("block", "at"))
        long = asks.where(e > b + 1).select("low", "high", (b + 1).alias("first"), (e - 1).alias("last"))
        middle = range_totals(above, sums, long.select(F.col("first").alias("low"), F.col("last").alias("high")))
        middle = middle.withColumnsRenamed({"low": "first", "high": "last"})
        found = found.unionByName(long.join(middle, ["first", "last"]).drop("first", "last"))
    return found.groupBy("low", "high").agg(*totals)
