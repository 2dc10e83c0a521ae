"""Mixing sources to target weights by a low-discrepancy schedule (expressions only).

Slot j of the schedule takes the point frac(j * golden ratio), which falls into
one source's share of [0, 1).  The slots of a source are ranked, its documents
are shuffled, laid end to end and cut into blocks of equal words, and slot
number r of a source plays block r modulo its number of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import running_total, stage, word_count, words_of

#: The fractional part of the golden ratio in units of 2**-32.
GOLDEN = 2654435769
POINTS = 1 << 32
#: The unit interval is cut into so many cells, on which slots meet the sources' shares.
CELLS = 4096
#: Slots of one run of numbers, ranked together.
RUN = 1 << 14
#: Hash buckets a source's documents are dealt to.
DEALS = 4096


def golden_point(j: Column) -> Column:
    """j * GOLDEN modulo 2**32, without leaving 64 bits for any j."""
    low, high = F.pmod(j, F.lit(1 << 16)), F.pmod(F.shiftright(j, 16), F.lit(1 << 16))
    return F.pmod(low * GOLDEN + F.pmod(high * GOLDEN, F.lit(1 << 16)) * (1 << 16), F.lit(POINTS))


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """Per source: skey, source_size, target.

    Sources by code point, null last, get the weights in turn.  The mix has
    ``share`` times all words; a target stops at ``cap`` times its source and
    the excess goes to the others by weight, until none is above: with sources
    sorted by cap over weight, those stopped come first, and one rate serves the
    rest.  One row per source meets in the windows, never a document.
    """
    totals = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(everything.orderBy("skey")) - 1, F.lit(len(weights)))
    given = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    weighed = totals.select("skey", "source_size", given.alias("w")).withColumn("cap", F.col("source_size") * cap)
    by_room = everything.orderBy(F.col("cap") / F.col("w"), "skey")
    stopped = F.coalesce(F.sum("cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    rate = (F.sum("source_size").over(everything) * share - stopped) / left
    rated = weighed.withColumn("rate", rate).withColumn("full", F.col("rate") * F.col("w") >= F.col("cap"))
    common = F.max(F.when(~F.col("full"), F.col("rate"))).over(everything)
    target = F.when(F.col("full"), F.col("cap")).otherwise(common * F.col("w"))
    return rated.select("skey", "source_size", target.alias("target"))


def own_block(source_size: Column, block_words: int) -> Column:
    """Words of a source's blocks: fewer in a source of less than 64 whole blocks, so that it has enough of them."""
    return F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(source_size / 64))).cast("long")


def schedule(targets: DataFrame) -> DataFrame:
    """The slots: slot, skey, epoch, block; (slot, skey) is unique.

    ``targets`` has skey, source_size, target and block_words.  A source is due as
    many slots as its blocks make up its target, and the points fall to sources
    by what they are due.  Points miss that number by a few; slots beyond it are
    left out, those that lack follow after the last point, so every source comes
    within a block of its target, also one whose share is below the points' grid.
    """
    spark = targets.sparkSession
    everything = Window.partitionBy(F.lit(0))
    in_order = everything.orderBy("skey")
    need = F.col("target") / F.col("block_words")
    due = stage(
        targets.where("target > 0").select(
            "skey", "block_words", F.ceil(F.col("source_size") / F.col("block_words")).alias("blocks"), F.ceil(need).cast("long").alias("due"),
            F.floor(F.sum(need).over(in_order) / F.sum(need).over(everything) * POINTS).alias("high"),
        ).withColumn("low", F.coalesce(F.lag("high").over(in_order), F.lit(0)))
    )
    cells = F.sequence(F.floor(F.col("low") * CELLS / POINTS), F.floor((F.col("high") - 1) * CELLS / POINTS))
    shares = due.where("high > low").withColumn("cell", F.explode(cells))
    # one number comes to the driver: how many slots there are
    total = due.agg(F.coalesce(F.sum("due"), F.lit(0)).cast("long")).first()[0]
    slots = (
        spark.range(total).withColumnRenamed("id", "slot")
        .withColumn("point", golden_point(F.col("slot")))
        .withColumn("cell", F.floor(F.col("point") * CELLS / POINTS))
    )
    hit = (
        slots.join(shares, "cell")
        .where("point >= low AND point < high")
        .select("slot", "skey", "blocks", "due", F.floor(F.col("slot") / RUN).alias("run"))
    )
    ranked = running_total(hit, "skey", "run", ["slot"], F.lit(1), "rank")
    ranked = stage(ranked.where("rank < due").select("slot", "skey", "blocks", "rank"))
    given = ranked.groupBy("skey").agg(F.count(F.lit(1)).alias("given"))
    lacking = (
        due.join(given, "skey", "left").withColumn("given", F.coalesce("given", F.lit(0).cast("long"))).where("given < due")
        .select("skey", "blocks", F.explode(F.sequence("given", F.col("due") - 1)).alias("rank"))
        .select((F.col("rank") + total).alias("slot"), "skey", "blocks", "rank")
    )
    return ranked.unionByName(lacking).select(
        "slot", "skey", F.floor(F.col("rank") / F.col("blocks")).alias("epoch"), F.pmod("rank", "blocks").alias("block")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 64,
    seed: str = "mix",
    numbered: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The mix of a corpus: (its documents, its pieces).

    ``docs`` has doc_id, text and source; other columns are not read.  The first
    result has a row per input row: row, doc_id, skey, size, source_size,
    target (``numbered``: docs brings its own unique row); the second the mix itself: slot, epoch, skey, block, row, from_word,
    to_word, a document being cut where a block ends.  Null text has no words, so
    it has a row in the first result and none in the second; null source is a
    source of its own, after the others; repeated rows are documents of their
    own; an empty table gives empty results.  The order of a source's documents
    is by md5 of seed and id, ties by id and size, so reruns agree.  Taken words
    differ from the target by less than a block, which is ``block_words`` or a
    64th of a small source, and no document is taken more than ``cap`` times.
    """
    narrow = stage(
        docs.select(
            F.col("row") if numbered else F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t")).alias("skey"),
            word_count(F.col("text")).alias("size"),
            F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("shuffle"),
        )
    )
    targets = stage(
        source_targets(narrow, weights, share, cap).withColumn("block_words", own_block(F.col("source_size"), block_words))
    )
    # a source with a third of the rows is dealt out over this join by row
    copies = targets.select("*", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("salt"))
    described = (
        narrow.withColumn("salt", F.pmod(F.col("row"), F.lit(64)).cast("int")).join(copies, ["skey", "salt"]).drop("salt")
    )
    dealt = described.withColumn("deal", F.conv(F.substring("shuffle", 1, 3), 16, 10).cast("int"))
    laid = running_total(dealt, "skey", "deal", ["shuffle", "doc_id", "size", "row"], F.col("size"), "start")
    # where a piece of a document lies: the blocks it covers
    words = F.col("block_words")
    first, last = F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words)
    covered = (
        laid.where("size > 0")
        .select("row", "skey", "start", "size", "block_words", F.explode(F.sequence(first, last)).alias("block"))
    )
    pieces = covered.join(schedule(targets), ["skey", "block"]).select(
        "slot", "epoch", "skey", "block", "row",
        F.greatest(F.lit(0), F.col("block") * words - F.col("start")).alias("from_word"),
        F.least(F.col("size"), (F.col("block") + 1) * words - F.col("start")).alias("to_word"),
    )
    return described.drop("shuffle", "block_words"), pieces


def mixed_totals(docs: DataFrame, **options) -> DataFrame:
    """Per input row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    described, pieces = mix(docs, **options)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return described.join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the columns of ``docs``, a row per input row and epoch it is played in.

    The text is what the mix takes of it in that epoch, from its first to its
    last word taken; blocks of a source are played in order, so these words
    adjoin, and a text taken whole stays as it is, blanks included.  Its n_chars,
    where there is one, is the length.  Documents of which nothing is taken
    (those without words among them) do not appear.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*columns).alias("doc")))
    described, pieces = mix(held.select("row", "doc.doc_id", "doc.text", "doc.source"), numbered=True, **options)
    taken = pieces.groupBy("row", "epoch").agg(F.min("from_word").alias("first"), F.max("to_word").alias("last"))
    whole = (F.col("first") == 0) & (F.col("last") == F.col("size"))
    part = F.array_join(F.slice(words_of(F.col("doc.text")), F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int")), " ")
    joined = held.join(described.select("row", "size"), "row").join(taken, "row").select(
        "doc", F.explode(F.array(F.when(whole, F.col("doc.text")).otherwise(part))).alias("text")
    )
    out = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return joined.select(*[column.alias(c) for c, column in out.items()])
