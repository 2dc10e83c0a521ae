"""Near-duplicate documents by fast similarity sketching.

Elements are placed in the sketch's coordinates by hashing, round after round,
each keeping the least (round, value); after as many rounds as coordinates, a
round fills one coordinate with all elements, so every coordinate fills, and
after fewer rounds the more elements there are.  Coordinates agree with the
probability of the Jaccard similarity and concentrate as if independent.
Coordinates form bands, documents that agree in a band are candidates, and
candidates are linked by the exact similarity of their shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import perhaps_among, stage
from gleanmill.llm.components import components_in_buckets
from gleanmill.llm.lm import LOWER, mixed

SHINGLE = 5
#: At similarity 0.85 a pair misses all bands with probability (1 - 0.85**8)**48, 2e-7.
BANDS, ROWS = 48, 8


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of the different 5-word shingles (fewer words: of all as one)."""
    from xxhash import xxh3_64_intdigest

    words = list(map(xxh3_64_intdigest, (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()))
    if not words:
        return np.empty(0, np.uint64)
    w, size = np.array(words, np.uint64), min(SHINGLE, len(words))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + len(h)])
    return np.unique(h)


def sketch(elements: np.ndarray, size: int) -> np.ndarray:
    """The filled coordinates of a non-empty set: round in the upper, value in the lower 32 bits."""
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    done, step = 0, max(1, min(2 * size, 4 * size // len(elements)))
    while done < 2 * size and (out == np.iinfo(np.uint64).max).any():
        rounds = np.arange(done, min(done + step, 2 * size), dtype=np.uint64)
        z = mixed(elements[None, :] ^ mixed(rounds + np.uint64(1))[:, None])
        low = z & np.uint64(0xFFFFFFFF)
        random = (low * np.uint64(size)) >> np.uint64(32)
        # from round ``size`` on all elements go to one coordinate, each in turn
        bins = np.where(rounds[:, None] < size, random, rounds[:, None] - np.uint64(size))
        np.minimum.at(out, bins.ravel().astype(np.int64), ((rounds[:, None] << np.uint64(32)) | (z >> np.uint64(32))).ravel())
        done += step
    return out


def band_keys(coordinates: np.ndarray, bands: int) -> list[int]:
    rows = coordinates.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64).tolist()


def sketched(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, digests, keys = [], [], []
            for text in b["text"].to_pylist():
                elements = shingle_set(text)
                sizes.append(len(elements))
                digests.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest() if len(elements) else None)
                keys.append(band_keys(sketch(elements, bands * rows), bands) if len(elements) else [])
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )

    return run


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact intersections; rows of one ``a`` come together, so its set is built once."""
    last, known = object(), np.empty(0, np.uint64)
    for b in batches:
        shared = []
        for a, text_a, text_b in zip(b["a"].to_pylist(), b["text_a"].to_pylist(), b["text_b"].to_pylist()):
            if a != last:
                last, known = a, shingle_set(text_a)
            shared.append(len(np.intersect1d(known, shingle_set(text_b), assume_unique=True)))
        yield pa.RecordBatch.from_arrays([b["a"], b["b"], b["n_a"], b["n_b"], pa.array(shared, pa.int64())], names=["a", "b", "n_a", "n_b", "shared"])


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingle_set(text) for text in b["text"].to_pylist()]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        hashes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64), pa.int64()))
        yield pa.RecordBatch.from_arrays([b["doc_id"], lists], names=["id", "elements"])


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per input row doc_id, n_shingles, component_id, kept.

    ``docs`` has doc_id and text; other columns are not read.  Rows link where
    100 * intersection >= ``percent`` * union of their shingle sets; component_id
    is the smallest doc_id that links reach, kept whether it is the row's own.
    Texts without words (null, empty, blank) link with nothing; rows without id
    stand by themselves, kept with a null component; repeated rows have one id
    and one fate; an empty table gives no rows.

    Equal sets become one class, found by a pre-aggregated digest; how the classes
    of a bucket are compared says components_in_buckets.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    sketches = stage(docs.select("doc_id", "text").mapInArrow(
        sketched(bands, rows), f"doc_id {kind}, n_shingles long, digest binary, keys array<long>"
    ))
    full = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    reps = full.join(classes, ["digest", "doc_id"]).dropDuplicates(["digest"])
    buckets = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    several = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    members = stage(buckets.join(several, "key").select("key", F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"), F.lit(0).cast("long").alias("place"), "m"))
    ids = members.select(F.col("id").alias("doc_id")).distinct()
    texts = stage(perhaps_among(known, ["doc_id"], ids).join(ids, "doc_id").select("doc_id", "text"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b, n_a, n_b) those linked and those not; sizes alone rule many out."""
        possible = pairs.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        with_b = possible.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        with_a = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        found = with_a.select("a", "b", "n_a", "n_b", "text_a", "text_b").mapInArrow(
            overlaps, f"a {kind}, b {kind}, n_a long, n_b long, shared long"
        )
        linked = 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))
        return stage(found.select("a", "b", linked.alias("linked")))

    def elements(some: DataFrame) -> DataFrame:
        held = texts.join(some.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
        return held.mapInArrow(listed, f"id {kind}, elements array<long>").select("id", F.explode("elements").alias("element"))

    joined = components_in_buckets(members, verified, elements, percent)
    fate = reps.select("digest", F.col("doc_id").alias("node")).join(joined, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("reached")
    )
    linked_rows = full.select("doc_id", "n_shingles", "digest").join(fate, "digest").select(
        "doc_id", "n_shingles", F.col("reached").alias("component_id")
    )
    others = sketches.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked_rows.unionByName(others).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
