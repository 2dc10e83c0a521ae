"""Centroid clustering: Lloyd rounds over integer vectors, each vector placed by Orchard search.

Every centroid has a list of the others, nearest first.  A search walks the list
of its current centroid; whenever it meets a closer one it goes on in that
one's list; what has been visited is not measured again, and the walk stops as
soon as the next entry is strictly beyond twice the current distance, since by
the triangle inequality no entry from there on can be nearer or as near.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gleanmill.llm.common import stage

SIZE, CLUSTERS, ROUNDS = 64, 40, 5
#: Components below this leave room for squares and their sum in 64 bits; others are Python's integers.
SAFE = 1 << 26
#: Exact sums leave a task as digits of this many bits, which add up as longs.
DIGIT = 31
LONG = (1 << 63) - 1
#: Vectors searched together.
BATCH = 8192


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 x) of finite doubles, exact: as int64 where all are small, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * 256.0)
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    # a double of 2^45 or more is a whole number, so its product is too
    exact = [int(v) * 256 if abs(v) >= 2.0**45 else int(np.floor(v * 256.0)) for v in values.ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def usable(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of ``size`` finite components, and their integers."""
    lists = batch["embedding"]
    places = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(lists.take(pa.array(places))).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(-1, size)  # nulls become NaN
    finite = np.isfinite(values).all(axis=1)
    return places[finite], whole(values[finite])


class Centroids:
    """Centroids with their sorted neighbour lists."""

    def __init__(self, points: np.ndarray):
        small = not points.size or all(abs(v) < SAFE for v in points.ravel().tolist())
        self.points = points.astype(np.int64 if small else object)
        apart = self.points[:, None, :] - self.points[None, :, :]
        squares = (apart * apart).sum(axis=2)
        n = len(points)
        self.lists = np.array(
            [sorted((j for j in range(n) if j != i), key=lambda j: (squares[i, j], j)) for i in range(n)], dtype=np.int64
        ).reshape(n, n - 1)
        self.far = np.take_along_axis(squares, self.lists, axis=1)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid (ties: smaller number) of each vector, and the squared distance; all walk in step."""
        points, far = self.points, self.far
        if vectors.dtype == object or points.dtype == object:
            vectors, points, far = vectors.astype(object), points.astype(object), far.astype(object)

        def measured(rows: np.ndarray, numbers: np.ndarray) -> np.ndarray:
            apart = vectors[rows] - points[numbers]
            return (apart * apart).sum(axis=1)

        n, m = len(vectors), len(points)
        best = np.zeros(n, np.int64)
        distance = measured(np.arange(n), best)
        visited = np.zeros((n, m), bool)
        visited[:, 0] = True
        at = np.zeros(n, np.int64)
        going = np.arange(n) if m > 1 else np.arange(0)
        while len(going):
            here = best[going]
            # strictly beyond twice the distance; squared: beyond four times
            going = going[(far[here, at[going]] <= 4 * distance[going]).astype(bool)]
            number = self.lists[best[going], at[going]]
            at[going] += 1
            fresh = ~visited[going, number]
            rows, number = going[fresh], number[fresh]
            visited[rows, number] = True
            found = measured(rows, number)
            better = ((found < distance[rows]) | ((found == distance[rows]) & (number < best[rows]))).astype(bool)
            rows = rows[better]
            best[rows], distance[rows], at[rows] = number[better], found[better], 0
            going = going[at[going] < m - 1]
        return best, distance

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.points.tolist()]


def searched(batches: Iterator[pa.RecordBatch], size: int, centroids: Centroids) -> Iterator[tuple]:
    """(batch, places, integers, cluster, squared distance) of the usable vectors, some thousands at a time."""
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, BATCH):
            batch = whole_batch.slice(start, BATCH)
            places, vectors = usable(batch, size)
            yield batch, places, vectors, *centroids.nearest(vectors)


def digits_of(number: int) -> list[int]:
    """Digits of DIGIT bits, lowest first, all with the number's sign."""
    sign, number, out = (-1 if number < 0 else 1), abs(number), []
    while number or not out:
        out.append(sign * (number & ((1 << DIGIT) - 1)))
        number >>= DIGIT
    return out


def totals(size: int, centroids: Centroids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task the exact component sums and the count (as component -1) of each cluster."""

    def summed(batches):
        sums: dict[int, list[int]] = {}
        for _, _, vectors, best, _ in searched(batches, size, centroids):
            for c in np.unique(best).tolist():
                mine = vectors[best == c]
                held = sums.setdefault(c, [0] * (size + 1))
                added = [len(mine), *map(int, mine.sum(axis=0).tolist())]
                held[:] = [a + b for a, b in zip(held, added)]
        rows = [(c, k - 1, p, d) for c, held in sums.items() for k, s in enumerate(held) for p, d in enumerate(digits_of(s))]
        if rows:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "component", "place", "digit"])

    return summed


def first_centroids(vectors: DataFrame, size: int, clusters: int, seed: int) -> list[list[int]]:
    """The usable vectors with the smallest hashes of their ids, then of smallest components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    fit = (
        (F.size("embedding") == size)
        & ~F.exists("embedding", lambda x: x.isNull())
        & F.forall("embedding", lambda x: (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    )
    rows = (
        vectors.where(fit).select(name.alias("name"), F.col("embedding").cast(ArrayType(DoubleType())).alias("v"))
        .orderBy("name", "v").limit(clusters).collect()
    )
    return [whole(np.array([r["v"]], dtype=np.float64))[0].tolist() for r in rows]


def clustered(
    vectors: DataFrame, size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 2
) -> DataFrame:
    """Of vectors (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``size`` components, none null, NaN or infinite; a
    component x counts as floor(256 x).  The first centroids are the kept vectors
    with the smallest sha256 of ``seed:vec_id`` (null id: nothing after the
    colon; equal ids: smaller components first), fewer where fewer are kept.
    Repeated rows are rows of their own and a null id stays null.  No kept vector:
    no row.  Arithmetic is exact at any magnitude; a distance or sum above the
    largest long is given as the largest long.

    A round is one pass over the vectors without a shuffle of them: a task returns
    one row per cluster, component and digit, so what reaches the driver after
    their sum is clusters x (size + 1) numbers, whatever the input.  The same
    bound holds for the centroids sent to tasks and for the table of cluster sums.
    """
    vectors = vectors.select("vec_id", "embedding")
    start = first_centroids(vectors, size, clusters, seed)
    if not start:
        return vectors.where("false").select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
            F.lit("").alias("centroid_sha256"),
        )
    points = np.array(start, dtype=object)
    for _ in range(rounds):
        parts = vectors.mapInArrow(totals(size, Centroids(points)), "cluster long, component long, place long, digit long")
        sums: dict[tuple[int, int], int] = {}
        for r in parts.groupBy("cluster", "component", "place").agg(F.sum("digit").alias("s")).collect():
            key = (r["cluster"], r["component"])
            sums[key] = sums.get(key, 0) + (r["s"] << (DIGIT * r["place"]))
        for c in {c for c, _ in sums}:
            points[c] = [sums[c, k] // sums[c, -1] for k in range(size)]
    final = Centroids(points)

    def placed(batches):
        for batch, places, _, best, distance in searched(batches, size, final):
            far = [min(int(d), LONG) for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"].take(pa.array(places)), pa.array(best, pa.int32()), pa.array(far, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    kind = vectors.schema["vec_id"].dataType.simpleString()
    found = stage(vectors.mapInArrow(placed, f"vec_id {kind}, cluster int, distance long"))
    known = found.sparkSession.createDataFrame(list(enumerate(final.digests())), "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    bounded = lambda total: F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_cluster = found.groupBy("cluster").agg(exact.alias("sum")).join(F.broadcast(known), "cluster")
    every = found.agg(exact.alias("all")).scalar()
    table = by_cluster.select(
        "cluster", bounded(F.col("sum")).alias("cluster_inertia"), bounded(every).alias("inertia"), "centroid_sha256"
    )
    # at most one row per cluster, which is why it may be broadcast
    return found.join(F.broadcast(table), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
