"""Fuzzy line deduplication by MinHash.

A line's signature has a coordinate per bin of the hash range: the least hash of
its 9-character shingles that falls into the bin.  Four bins make a band, lines
that agree in a band are candidates, candidates are linked by the exact Jaccard
similarity of their shingle sets, and one line per component is kept.

Small sets, whose bins would mostly be empty, meet by prefixes instead, which lose
no pair: sets of n and m shingles of similarity p share one of the n - ceil(p n) + 1
and m - ceil(p m) + 1 that come first in any order of all shingles.  The order
puts common shingles last.

Signatures and exact similarities are expressions, from the shingles that a regular
expression cuts.  The same signature in numpy, with other hashes, stays for callers
that have lines in hand (least_hashes, band_keys); the queries do not use it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import WORD, let, perhaps_among, stage
from gleanmill.llm.components import components_in_buckets
from gleanmill.llm.lm import mixed

SHINGLE = 9
#: Lines of fewer shingles have too few for a signature; they meet others by prefixes.
#: Lines under 9 characters have no shingle and link with equal lines only.
LEAST = 32
#: A shingle is common with more than one in so many of the small sets' shingles, so
#: fewer than so many are common, which bounds what is broadcast.
SHARE = 100_000
#: Of 64 bins in 16 bands so many bands are used: at similarity 0.8 a pair
#: misses all with probability (1 - 0.8**4)**13, one in a thousand.
BINS, ROWS, BANDS = 64, 4, 13
#: Code points hashed at a time, so that memory does not grow with a line.
STEP = 1 << 15
EMPTY = np.iinfo(np.uint64).max
NEXT = np.uint64(0x9E3779B97F4A7C15)
BASE = 0xD6E8FEB86659FD93


def window_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all runs of 9 code points: a polynomial whose window doubles three times, then grows by one."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < SHINGLE:
        return np.empty(0, np.uint64)
    h = codes
    for width in (1, 2, 4):
        h = h[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + h[width:]
    return mixed(h[:-1] * np.uint64(BASE) + codes[SHINGLE - 1 :])


def least_hashes(lines: list[str]) -> np.ndarray:
    """Per line its coordinates: bins go by the lowest bits, order in a bin by the others."""
    out = np.full(len(lines) * BINS, EMPTY, np.uint64)

    def place(rows: list[int], pieces: list[str]) -> None:
        lengths = np.array([len(p) for p in pieces])
        h = window_hashes("".join(pieces))
        inside = np.ones(len(h), bool)
        inside[(np.cumsum(lengths)[:-1, None] - np.arange(1, SHINGLE)).ravel()] = False
        at = np.repeat(np.array(rows) * BINS, lengths)[: len(h)] + (h & np.uint64(BINS - 1)).astype(np.int64)
        np.minimum.at(out, at[inside], (h >> np.uint64(6))[inside])

    rows, pieces, size = [], [], 0
    for i, line in enumerate(lines):
        if len(line) < LEAST + SHINGLE - 1:
            continue
        for k in range(0, len(line) - SHINGLE + 1, STEP):
            rows.append(i)
            pieces.append(line[k : k + STEP + SHINGLE - 1])
            size += len(pieces[-1])
            if size >= STEP:
                place(rows, pieces)
                rows, pieces, size = [], [], 0
    if rows:
        place(rows, pieces)
    return out.reshape(len(lines), BINS)


def band_keys(lines: list[str]) -> pa.ListArray:
    """Per line one key for each band with a coordinate; none for lines without a signature."""
    return banded(least_hashes(lines))


def banded(least: np.ndarray) -> pa.ListArray:
    bands = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(ROWS):
        keys = mixed(keys * NEXT + bands[:, :, k])
    filled = (bands != EMPTY).any(axis=2)
    ends = np.concatenate([[0], np.cumsum(filled.sum(axis=1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[filled].view(np.int64), pa.int64()))


def most_partners(percent: int) -> int:
    """The largest set that can link with one too small for a signature."""
    return (LEAST - 1) * 100 // percent


def pieces(line: Column) -> Column:
    """The line, if long in pieces that overlap, so that each shingle is in one of them."""
    count = F.ceil((F.length(line) - SHINGLE + 1) / STEP).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(line, k * STEP + 1, F.lit(STEP + SHINGLE - 1)))
    return F.when(F.length(line) < STEP + SHINGLE, F.array(line)).otherwise(cut)


def hashed(piece: Column) -> Column:
    """64-bit hashes of all runs of 9 code points; a piece whose characters are a byte each is cut by bytes, at half the cost."""
    cut = F.regexp_extract_all(piece, F.lit(f"(?s)(?=({'.' * SHINGLE}))."), F.lit(1))
    places = F.sequence(F.lit(1), F.octet_length(piece) - SHINGLE + 1)
    by_bytes = let(piece.cast("binary"), lambda b: F.transform(places, lambda k: F.xxhash64(F.substring(b, k, F.lit(SHINGLE)))))
    plain = (F.length(piece) >= SHINGLE) & (F.length(piece) == F.octet_length(piece)) & F.is_valid_utf8(piece)
    return F.when(plain, by_bytes).otherwise(F.transform(cut, lambda s: F.xxhash64(s)))


def at_once(line: Column) -> Column:
    """Whether a line is one piece."""
    return F.length(line) < STEP + SHINGLE


def shingles(line: Column) -> Column:
    """The hashes of a line, equal ones as often as they stand in it."""
    return F.when(at_once(line), hashed(line)).otherwise(
        F.flatten(F.transform(pieces(line), lambda p: F.array_distinct(hashed(p))))
    )


def band_of(h: Column) -> Column:
    return F.shiftrightunsigned(h, 60)


def least_of_bands(hashes: Column) -> Column:
    """The ROWS least different hashes of each band."""
    return let(
        F.sort_array(F.array_distinct(hashes)),
        lambda s: F.filter(s, lambda h, i: (i < ROWS) | (band_of(F.get(s, i - ROWS)) != band_of(h))),
    )


def unordered(line: Column) -> Column:
    """What the keys of a line are read from: its hashes and the marks; of a line in pieces the least of each piece and band."""
    of_pieces = F.flatten(F.transform(pieces(line), lambda p: least_of_bands(hashed(p))))
    return F.concat(F.when(at_once(line), hashed(line)).otherwise(F.array_distinct(of_pieces)), marks())


#: The least possible hash of each band; hashes are signed, so bands from 8 on come first.
MARKS = [(k - 16 if k > 7 else k) << 60 for k in range(16)]


def marks() -> Column:
    return F.array(*[F.lit(m).cast("long") for m in MARKS])


def places_of(s: Column) -> Column:
    """Where the marks of the bands stand in sorted hashes, from 1."""
    return F.array(*[F.array_position(s, F.lit(m).cast("long")).cast("int") for m in MARKS])


def held(s: Column, places: Column, k: int | Column) -> tuple[Column, Column]:
    """Where the hashes of a band begin, from 1, and how many there are."""
    k = F.lit(k)
    at, end = F.get(places, k), F.when(k == 7, F.size(s) + 1).otherwise(F.get(places, (k + 1) % 16))
    return at + 1, end - at - 1


def first_of_bands(s: Column, places: Column) -> Column:
    """The first ROWS hashes of each of the first BANDS bands."""
    cut = [held(s, places, k) for k in range(BANDS)]
    return F.array(*[F.slice(s, at, F.least(n, F.lit(ROWS))) for at, n in cut])


def different_of_bands(first: Column, s: Column, places: Column) -> Column:
    """The same without hashes that stand there twice: the ROWS least different ones of each band."""

    def apart(f: Column, k: Column) -> Column:
        at, n = held(s, places, k)
        twice = reduce(Column.__or__, [F.coalesce(F.get(f, F.lit(i)) == F.get(f, F.lit(i + 1)), F.lit(False)) for i in range(ROWS - 1)])
        return F.when(twice, F.slice(F.array_distinct(F.slice(s, at, n)), 1, ROWS)).otherwise(f)

    return F.transform(first, apart)


def signed(line: Column, s: Column, least: Column, most: int) -> Column:
    """keys: of a line with enough characters for a signature; few: its different hashes if these are at most ``most``.

    ``s``: the hashes of ``unordered``, sorted; ``least``: the least different ones of each band.
    """
    none = F.array().cast("array<bigint>")
    keys = F.array_compact(F.transform(least, lambda h: F.when(F.size(h) > 0, F.xxhash64(h))))
    different = F.when(at_once(line), F.array_except(s, marks())).otherwise(F.array_distinct(shingles(line)))
    # as many in the bands as that rule a small set out
    few = F.when(F.size(F.flatten(least)) <= most, F.when(F.size(different) <= most, different).otherwise(none))
    return F.struct(
        F.when(F.length(line) >= LEAST + SHINGLE - 1, keys).otherwise(none).alias("keys"), few.otherwise(none).alias("few")
    )


def signature(line: Column, most: int) -> Column:
    least = lambda s, places: different_of_bands(first_of_bands(s, places), s, places)
    return let(
        F.sort_array(unordered(line)),
        lambda s: let(places_of(s), lambda places: let(least(s, places), lambda b: signed(line, s, b, most))),
    )


def with_signature(rows: DataFrame, line: str, most: int) -> DataFrame:
    """``rows`` with the line's signature in place of the line.

    The same as ``signature`` in steps: a one-row generator keeps what is made from
    being made again for each mention, and what is no lambda is compiled.
    """
    others = [c for c in rows.columns if c != line]
    once = lambda some, name, value: some.select("*", F.explode(F.array(value)).alias(name))
    s, places = F.col("_s"), F.col("_places")
    hashes = once(rows, "_h", unordered(F.col(line))).select(*others, line, F.sort_array("_h").alias("_s"))
    placed = once(hashes, "_places", places_of(s))
    # with a lambda in it a projection is cut into methods; one method of all would be too long for the JVM to compile
    first = placed.select(*others, line, "_s", F.transform(places, lambda p: p).alias("_places"), first_of_bands(s, places).alias("_first"))
    least = once(first, "_least", different_of_bands(F.col("_first"), s, places))
    return least.select(*others, signed(F.col(line), s, F.col("_least"), most).alias("s"))


def prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """id, size, key, place of each class with a small set: the shingles that come first, common ones last."""
    each = classes.select("id", F.explode("few").alias("key"))
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()
    common = counts.where((F.col("n") > 1) & (F.col("n") * SHARE > total))
    placed = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")))
    ordered = each.join(F.broadcast(common), "key", "left").groupBy("id").agg(placed.alias("s"))
    n = F.size("s")
    first = F.slice("s", F.lit(1), n - F.ceil(n * percent / 100).cast("int") + 1)
    return ordered.select("id", n.cast("long").alias("size"), F.posexplode(first["key"]).alias("place", "key"))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0), line, h1, h2: all lines with a word."""
    cut = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    return cut.where(F.rlike("line", F.lit(WORD))).select(
        "doc_id", "line_no", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")
    )


def line_fates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Per line with a word: doc_id, line_no, first_doc, first_line, kept.

    ``docs`` has doc_id and text; other columns are not read.  Equal lines are
    one class; classes link where their sets of 9-character shingles have a
    similarity of ``percent`` or more; lines under 9 characters have no shingle and
    link with equal lines only.  Of a component
    the line with the smallest (doc_id, line_no) is kept; null ids come first.
    Null, empty and blank texts have no lines; repeated rows share ids and so
    their fate; an empty table gives no rows.  Texts move only for lines that
    meet another in a band.
    """
    lines = lines_of(docs)
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no", "line")).alias("c")).select(
        "h1", "h2", F.struct("c.doc_id", "c.line_no").alias("id"), "c.line"
    )
    classes = stage(
        with_signature(firsts, "line", most_partners(percent)).select("h1", "h2", "id", "s.keys", "s.few")
    )
    short = stage(prefixes(classes, percent).withColumn("place", F.col("place").cast("long")))
    # how many shingles are different is known of small sets only
    count = F.when(F.size("few") > 0, F.size("few")).cast("long")
    banded_rows = classes.select("id", count.alias("size"), F.lit(0).cast("long").alias("place"), F.explode("keys").alias("key"))
    buckets = banded_rows.unionByName(short)
    several = stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = stage(perhaps_among(buckets, ["key"], several).join(several, "key").select("key", "id", "size", "place", "m"))
    # numbers in the order of the ids: what follows joins, groups and takes minima by them many times
    numbered = stage(met.select("id").distinct().orderBy("id").select("id", F.monotonically_increasing_id().alias("node")))
    texts = perhaps_among(lines.select(F.struct("doc_id", "line_no").alias("id"), "line"), ["id"], numbered).join(numbered, "id")
    # how many different shingles a line has, counted once a line and not once a pair
    texts = stage(texts.select(F.col("node").alias("id"), "line", F.size(F.array_distinct(shingles(F.col("line")))).cast("long").alias("n")))
    # an id that repeats with other lines has no one size
    sizes = texts.groupBy(F.col("id").alias("node")).agg(F.when(F.min("n") == F.max("n"), F.min("n")).alias("n"))
    members = stage(
        met.join(numbered.join(sizes, "node"), "id").select("key", F.col("node").alias("id"), F.coalesce("size", "n").alias("size"), "place", "m")
    )

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda s: texts.select(F.col("id").alias(s), F.col("line").alias(f"line_{s}"), F.col("n").alias(f"of_{s}"))
        possible = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
        possible = possible.where(100 * F.least("of_a", "of_b") >= percent * F.greatest("of_a", "of_b"))
        shared = F.size(F.array_intersect(shingles(F.col("line_a")), shingles(F.col("line_b"))))
        # the union is what both have less what they share
        linked = (100 + percent) * shared.cast("long") >= percent * (F.col("of_a") + F.col("of_b"))
        return stage(possible.select("a", "b", linked.alias("linked")).distinct())

    def elements(some: DataFrame) -> DataFrame:
        return texts.join(some, "id", "left_semi").select("id", F.explode(F.array_distinct(shingles(F.col("line")))).alias("element"))

    joined = components_in_buckets(members, verified, elements, percent)
    reached = numbered.select(F.col("node").alias("component"), F.col("id").alias("reached"))
    known = joined.join(numbered.select("node", F.col("id").alias("own")), "node").join(reached, "component").select("own", "reached")
    first = classes.join(known, classes["id"] == known["own"], "left").select("h1", "h2", F.coalesce("reached", "id").alias("first"))
    return lines.select("doc_id", "line_no", "h1", "h2").join(first, ["h1", "h2"]).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without the lines that repeat an earlier one.

    All columns stay as they are but text, and n_chars where there is one.
    Documents that lose a line and have no word left are dropped; others stay,
    also those that had no words.
    """
    fates = line_fates(docs, percent)
    lost = fates.where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("lost"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    held = docs.select(F.col("doc_id").alias("key"), F.struct(*columns).alias("doc"))
    joined = held.join(lost, held["key"].eqNullSafe(lost["doc_id"]), "left")
    kept = F.filter(F.split("doc.text", "\n"), lambda line, i: ~F.array_contains("lost", i))
    text = F.when(F.col("lost").isNull(), F.col("doc.text")).otherwise(F.array_join(kept, "\n"))
    cleaned = joined.select("doc", "lost", F.explode(F.array(text)).alias("text"))
    cleaned = cleaned.where(F.col("lost").isNull() | F.rlike("text", F.lit(WORD)))
    out = {c: F.col("doc").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.col("lost").isNull(), out["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*[column.alias(c) for c, column in out.items()])
