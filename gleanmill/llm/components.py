"""Connected components over DataFrames, by alternating stars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanmill.llm.common import stage


def components(links: DataFrame) -> DataFrame:
    """Of links (a, b): node, component (its smallest node), for every node that has a link.

    A distributed union-find: the large star hangs all larger neighbours of a
    node on its smallest neighbour, the small star the smaller ones, until every
    node hangs on one that hangs on none; a logarithmic number of rounds for any
    shape.  A round joins links with one row per node; nothing is collected.
    Each round is a staged table, so a lost executor repeats little.
    """
    edges = stage(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while True:
        tops = edges.select(F.col("v").alias("u")).distinct()
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not edges.join(tops, "u", "left_semi").select("u").unionByName(several.select("u")).head(1):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(nearest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(hung.unionByName(nearest.select("u", F.col("m").alias("v"))).distinct())


#: Members of a bucket compared with all its others in one round, and its growth.
#: A bucket of no more members is compared whole, which is linear in its rows.
HUBS, FASTER = 16, 4


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links (a, b): only components that links touch are worked on."""
    to = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    between = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(
        F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b")
    )
    merged = components(between).select(F.col("node").alias("old"), F.col("component").alias("new"))
    moved = labels.join(merged, labels["component"] == merged["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    fresh = merged.join(labels, merged["old"] == labels["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    return stage(moved.unionByName(fresh))


def size_class(n: str) -> str:
    """SQL for the class of a set size: sizes under 64 are their own, larger ones share a class within 1/32."""
    shift = f"greatest(length(bin({n})) - 6, 0)"
    return f"(32 * {shift} + shiftright({n}, {shift}))"


def prefix_members(elements: DataFrame, percent: int, joined: DataFrame | None = None) -> DataFrame:
    """Buckets in which all pairs of sets of this similarity meet: key, id, size, place.

    ``elements`` has id and element, the different elements of each set.  They are
    ordered rarest first.  If sets of n and m elements link, the first one they
    share has at least the needed overlap of elements from its place on, in both.
    So an element at a place is only of use for partners up to some size, and a
    key is an element with the classes of both sizes.  Elements that one set alone
    has make no key; sets that differ by their rare elements have no key in common.
    With the components known so far (node, component) there is a column c, the set's.
    """
    counts = elements.groupBy("element").agg(F.count(F.lit(1)).alias("n"))
    ordered = (
        elements.join(counts, "element").groupBy("id")
        .agg(F.sort_array(F.collect_list(F.struct("n", "element"))).alias("s")).withColumn("size", F.size("s").cast("long"))
    )
    others = []
    if joined is not None:
        ordered, others = ordered.join(joined, ordered["id"] == joined["node"], "left").withColumn("c", F.coalesce("component", "id")), ["c"]
    least = F.expr(f"({percent} * size + 99) div 100")
    first = F.slice("s", F.lit(1), (F.col("size") - least + 1).cast("int"))
    placed = ordered.select("id", "size", *others, least.alias("least"), F.posexplode(first).alias("place", "e")).where("e.n > 1")
    most = f"(((size - place) * {100 + percent} - {percent} * size) div {percent})"
    classed = placed.withColumn("most", F.expr(most)).where("most >= least").select(
        "id", "size", *others, F.col("place").cast("long").alias("place"), F.col("e.element").alias("element"),
        F.expr(size_class("size")).alias("own"),
        F.explode(F.expr(f"sequence({size_class('least')}, {size_class('most')})")).alias("other"),
    )
    return classed.select(F.xxhash64("element", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "size", "place", *others)


def components_in_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    elements: Callable[[DataFrame], DataFrame],
    percent: int,
) -> DataFrame:
    """Components of the verified links between members of a bucket: node, component.

    ``members`` has key, id, size and place: the size of the id's set (null:
    unknown) and how many of its elements come before the key's (0 where the key is
    no element); perhaps m, how many members the key has, two or more.  ``verify``
    turns pairs (a, b, n_a, n_b), a < b, into a staged frame (a, b, linked);
    ``elements`` turns a frame of id into (id, element); sets link at a similarity
    of ``percent``.

    The member of a bucket that meets most others is its hub and is compared with
    all.  A bucket that is then still in several components is compared whole if it
    has no more than HUBS members; the sets of all larger ones are dealt anew by
    their rarest elements (prefix_members), which loses no link.  There members outside
    the largest component of a key are compared with all others, a growing number
    per round, until none waits.  Pairs whose sizes and places rule a link out
    are never made; what can grow with the square of a group is only the pairs of sets
    that share their rarest elements and do not link all the same.
    """

    def counted_in(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
        return rows.join(sizes.where("m > 1"), "key")

    def ranked(counted: DataFrame) -> DataFrame:
        degree = counted.groupBy("id").agg(F.sum("m").alias("degree"))
        return stage(counted.join(degree, "id").select("key", "id", "size", "place", "degree", "m"))

    def paired(one: DataFrame, other: DataFrame) -> DataFrame:
        side = lambda rows, s: rows.select(
            "key", F.col("id").alias(s), F.col("size").alias(f"n_{s}"), F.col("place").alias(f"i_{s}"), F.col("c").alias(f"c_{s}")
        )
        need = f"{percent} * (n_x + n_y)"
        room = f"(n_x - i_x) * {100 + percent} >= {need} AND (n_y - i_y) * {100 + percent} >= {need}"
        first = F.col("x") < F.col("y")
        either = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
        return side(one, "x").join(side(other, "y"), "key").where(f"x <> y AND c_x <> c_y AND coalesce({room}, true)").select(
            either("x", "y").alias("a"), either("y", "x").alias("b"), either("n_x", "n_y").alias("n_a"), either("n_y", "n_x").alias("n_b")
        ).distinct()

    def torn_keys(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")

    def placed_in(rows: DataFrame, joined: DataFrame) -> DataFrame:
        """Rows of the buckets that are in several components, with these."""
        placed = stage(
            rows.join(joined, rows["id"] == joined["node"], "left")
            .select("key", "id", "size", "place", "degree", "m", F.coalesce("component", "id").alias("c"))
        )
        # a bucket of one component stays one, so only the others go on
        return stage(placed.join(torn_keys(placed), "key"))

    members = ranked(members if "m" in members.columns else counted_in(members))
    hubs = members.groupBy("key").agg(F.max(F.struct("degree", "id", "size", "place")).alias("h")).select(
        "key", "h.id", "h.size", "h.place", F.col("h.id").alias("c")
    )
    judged = verify(paired(hubs, members.withColumn("c", F.col("id"))))
    joined = components(judged.where("linked"))
    # the hub of a pair was all there was to compare
    torn = placed_in(members, joined).where("m > 2")
    large = stage(torn.where(F.col("m") > HUBS).select("id").distinct())
    members = torn.where(F.col("m") <= HUBS).drop("c")
    if large.head(1):
        dealt = stage(prefix_members(stage(elements(large)), percent, joined))
        # of the keys only those that stand in several components can bring a link
        dealt = stage(dealt.join(torn_keys(dealt), "key", "left_semi").select("key", "id", "size", "place"))
        members = members.unionByName(ranked(counted_in(dealt)))
    done, most = hubs.select("key", "id"), HUBS
    while True:
        open_rows = placed_in(members, joined)
        members = open_rows.drop("c")
        groups = open_rows.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n"))
        largest = groups.groupBy("key").agg(F.max(F.struct("n", "c")).alias("top")).select("key", F.col("top.c").alias("c"))
        waiting = open_rows.join(largest, ["key", "c"], "left_anti").join(done, ["key", "id"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("degree"), "id"))
        turns = stage(waiting.withColumn("turn", turn).where(F.col("turn") <= most + 1))
        chosen = turns.where(F.col("turn") <= most).drop("turn")
        if not chosen.head(1):
            return joined
        fresh = verify(paired(chosen, open_rows).join(judged.select("a", "b"), ["a", "b"], "left_anti"))
        if fresh.where("linked").head(1):
            joined = relabelled(joined, fresh.where("linked"))
        # buckets in which nobody is left to wait are done, whatever links come yet
        left = turns.where(F.col("turn") > most).select("key")
        if not left.head(1):
            return joined
        members = members.join(left, "key", "left_semi")
        judged, done, most = judged.unionByName(fresh), done.unionByName(chosen.select("key", "id")), most * FASTER
