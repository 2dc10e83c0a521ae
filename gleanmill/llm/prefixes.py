"""Conversation prefix trie: members of every prefix as an interval of the sorted conversations.

Conversations are sorted as sequences of turns, so the members of a prefix stand
side by side.  With the common prefix length (LCP) of each conversation and its
predecessor, the members of a prefix of depth d around a place reach as far as
no LCP is below d.  Every candidate prefix searches its left and right end on
its own, by binary search on range minima (``ranges``); no stack, no nesting.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import stage
from gleanmill.llm.ranges import BLOCK, nearest_below, range_totals
from gleanmill.operators.lookup import attach
from gleanmill.operators.numbering import with_position

#: Ids joined into one piece of a digest's text.
PIECE = 4096
NOTHING = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos from 0, token, bytes: turns by number, null first, then by role and token.

    A token is 16 bytes of the SHA-256 of role and text (null: empty), which stand
    for the turn from here on, so texts are read once and do not move.  Rows
    without a conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"),
        F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("token"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return stage(with_position(rows, ["turn", "role", "token"], ["conv_id"], "pos").select("conv_id", "pos", "token", "bytes"))


def spliced_turns(turns: DataFrame) -> DataFrame:
    """Numbered turns of conversations whose start is taken from another one.

    Conversation c gets the first h turns of c - c % 5 (all if fewer, none if
    absent) and its own after its first h, h being crc32 of its id modulo 9.
    Positions keep gaps where fewer turns came in; a row with a null ``pos``
    stands for every conversation, also one left without turns.
    """
    head = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    ids = turns.select("conv_id").distinct()
    own = turns.where(F.col("pos") >= head)
    # a multiple of 5 heads at most nine ids (0 stands on both sides)
    heirs = F.filter(
        F.sequence(F.col("conv_id") - 4, F.col("conv_id") + 4), lambda c: c - c % 5 == F.col("conv_id")
    )
    lent = (
        turns.where((F.col("conv_id") % 5 == 0) & (F.col("pos") < 8))
        .select(F.explode(heirs).alias("conv_id"), "pos", "token", "bytes")
        .where(F.col("pos") < head)
        .join(ids, "conv_id", "left_semi")
    )
    marker = ids.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("token"), F.lit(None).cast("long").alias("bytes"))
    return own.unionByName(lent).unionByName(marker)


def sorted_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation in the order of its turns: at, conv_id, n, lcp, next_lcp, reach, held.

    ``lcp`` is the common prefix with the one before (first: -1), ``next_lcp`` with
    the one after (last: -1), ``reach`` the bytes of the first k turns for k = 0
    to n, ``held`` those of the common prefix.
    """
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "token", "bytes"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    sizes = F.transform("t", lambda t: t["bytes"])
    running = F.aggregate(
        sizes, F.array(F.lit(0).cast("long")), lambda done, size: F.concat(done, F.array(F.element_at(done, -1) + size))
    )
    rows = whole.select("conv_id", F.transform("t", lambda t: t["token"]).alias("tokens"), running.alias("reach"))
    placed = stage(with_position(rows, ["tokens", "conv_id"], name="at"))
    # a block also holds the last row of the block before it
    block = F.floor(F.col("at") / BLOCK).cast("long")
    blocks = F.when(F.col("at") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    by_block = Window.partitionBy("block").orderBy("at")
    differs = F.array_position(F.zip_with("tokens", "before", lambda a, b: a.eqNullSafe(b)), False)
    lcp = F.when(F.col("before").isNull(), -1).when(differs > 0, differs - 1).otherwise(F.size("tokens")).cast("long")
    with_lcp = (
        placed.withColumn("block", F.explode(blocks))
        .withColumn("before", F.lag("tokens").over(by_block))
        .where(F.col("block") == block)
        .select("at", "conv_id", F.size("tokens").cast("long").alias("n"), lcp.alias("lcp"), "reach")
    )
    with_lcp = stage(with_lcp.withColumn("held", F.when(F.col("lcp") < 0, 0).otherwise(F.get("reach", F.col("lcp").cast("int"))).cast("long")))
    after = with_lcp.where("lcp >= 0").select((F.col("at") - 1).alias("at"), F.col("lcp").alias("next_lcp"))
    return stage(with_lcp.join(after, "at", "left").withColumn("next_lcp", F.coalesce("next_lcp", F.lit(-1).cast("long"))))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (low, conv_id) rows as comma-joined pieces of ids of one group."""
    group, ids = None, []

    def piece():
        text = ",".join(map(str, ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([group], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([text])], names=["low", "first", "text"]
        )

    for batch in batches:
        for low, conv in zip(batch["low"].to_pylist(), batch["conv_id"].to_pylist()):
            if ids and (low != group or len(ids) == PIECE):
                yield piece()
                ids = []
            group = low
            ids.append(conv)
    if ids:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (low, first, text) pieces as one digest per group, however long."""
    group, running = None, None
    lows: list[int] = []
    out: list[str] = []

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(lows, pa.int64()), pa.array(out)], names=["low", "ends_sha256"])
        lows.clear()
        out.clear()
        return made

    for b in batches:
        for low, text in zip(b["low"].to_pylist(), b["text"].to_pylist()):
            if running is not None and low == group:
                running.update(b"," + text.encode())
                continue
            if running is not None:
                lows.append(group)
                out.append(running.hexdigest())
                if len(lows) >= PIECE:
                    yield batch()
            group, running = low, hashlib.sha256(text.encode())
    if running is not None:
        lows.append(group)
        out.append(running.hexdigest())
    if lows:
        yield batch()


def ends_digests(ends: DataFrame) -> DataFrame:
    """Of (low, conv_id): per low the SHA-256 of the ids, ascending and comma-joined.

    Pieces are made where the ids are range-sorted, so a group with a third of all
    ids is joined by many tasks; only its pieces meet in one, as a SHA-256 must
    read its text in order, and they pass through without being held.
    """
    alone = ends.groupBy("low").agg(F.count(F.lit(1)).alias("k"), F.min("conv_id").alias("conv_id"))
    single = alone.where("k = 1").select("low", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256"))
    several = ends.join(alone.where("k > 1").select("low"), "low", "left_semi")
    pieces = several.repartitionByRange("low", "conv_id").sortWithinPartitions("low", "conv_id").mapInArrow(_pieces, "low long, first long, text string")
    digests = pieces.repartition("low").sortWithinPartitions("low", "first").mapInArrow(_digests, "low long, ends_sha256 string")
    return single.unionByName(digests)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Of numbered turns (conv_id, pos, token, bytes): a row per distinct prefix.

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256; the root is the prefix
    without turns.  A row with a null ``pos`` adds its conversation without a
    turn.  No conversation at all: no row, not even the root.  Equal
    conversations share all their nodes.

    A conversation is one value of about 24 bytes a turn while it is sorted; its
    prefixes are worked on as rows.  Between two branchings a prefix has the
    members of the next branching, so searches are made for the LCP and the end
    of every conversation only, and depths between are filled in.
    """
    convs = sorted_conversations(turns)
    at_lcp = convs.where("lcp >= 0").select(F.col("at"), F.col("lcp").alias("depth"))
    at_end = convs.select("at", F.col("n").alias("depth"))
    asked = at_lcp.unionByName(at_end).distinct()
    # left: from the place itself; right: from the place after it
    sides = F.explode(F.array(F.struct(F.col("at").alias("start"), F.lit(True).alias("to_left")), F.struct((F.col("at") + 1).alias("start"), F.lit(False).alias("to_left"))))
    asks = asked.select("depth", sides.alias("s")).select("s.start", "depth", "s.to_left")
    found = stage(nearest_below(convs.select("at", F.col("lcp").alias("v")), asks))
    last = convs.agg(F.max("at")).scalar()
    low = found.where("to_left").select(F.col("start").alias("at"), "depth", F.col("found").alias("low"))
    high = found.where("NOT to_left").select((F.col("start") - 1).alias("at"), "depth", F.coalesce(F.col("found") - 1, last).alias("high"))
    extents = stage(asked.join(low, ["at", "depth"]).join(high, ["at", "depth"]))

    spans = extents.groupBy("low", "high").agg(F.max("depth").alias("bottom"))
    first = convs.select(F.col("at").alias("low"), F.col("lcp").alias("low_lcp"), "reach", "held")
    final = convs.select(F.col("at").alias("high"), F.col("next_lcp").alias("high_lcp"))
    spans = spans.join(first, "low").join(final, "high").withColumn("above", F.greatest("low_lcp", "high_lcp"))
    # the parent is the prefix around the boundary with the larger LCP
    edge = F.when(F.col("low_lcp") >= F.col("high_lcp"), F.col("low")).otherwise(F.col("high") + 1)
    around = extents.select(F.col("at").alias("edge"), F.col("depth").alias("above"), F.struct("low", "high").alias("parent"))
    spans = stage(spans.withColumn("edge", edge).join(around, ["edge", "above"], "left").drop("edge", "low_lcp", "high_lcp"))

    values = convs.select(
        "at", F.col("conv_id").alias("least"), (F.col("next_lcp") < F.col("n")).cast("long").alias("leaves"), F.col("held").alias("shared")
    )
    totals = stage(range_totals(values, ["leaves", "shared"], spans.select("low", "high")))
    children = spans.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    children = children.select(F.col("parent.low").alias("low"), F.col("parent.high").alias("high"), "n_children")
    digests = ends_digests(
        extents.join(convs.select("at", F.col("n").alias("depth"), "conv_id"), ["at", "depth"]).select("low", "conv_id")
    )
    # conversations that end at a span stand first in it, so its low end and depth name it
    ended = convs.select(F.col("at").alias("low"), F.col("n").alias("bottom")).join(digests, "low")
    named = totals.select(F.struct("low", "high").alias("parent"), F.col("least").alias("parent_conv_id"))
    full = stage(
        spans.join(totals, ["low", "high"]).join(children, ["low", "high"], "left").join(ended, ["low", "bottom"], "left")
    )
    full = attach(full, named, "parent", ["parent_conv_id"], ["low", "high"])

    depth, n = F.col("depth"), (F.col("high") - F.col("low") + 1)
    at_bottom = depth == F.col("bottom")
    spent = F.when(depth > 0, F.get("reach", (depth - 1).cast("int"))).otherwise(0)
    return full.withColumn("depth", F.explode(F.sequence(F.col("above") + 1, F.col("bottom")))).select(
        F.col("least").alias("conv_id"), "depth",
        F.when(depth == F.col("above") + 1, F.col("parent_conv_id")).otherwise(F.col("least")).alias("parent_conv_id"),
        n.alias("n_convs"),
        F.when(at_bottom, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("shared") - F.col("held") - (n - 1) * spent).alias("saved_tokens"),
        F.when(at_bottom, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(NOTHING).alias("ends_sha256"),
    )
