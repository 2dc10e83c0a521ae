"""Centroid clustering against measuring every pair, in plain integers."""

import hashlib
import math
import random

import numpy as np

from gleanmill.llm import centroids
from gleanmill.llm.common import prepared


def plain(rows, size, clusters, rounds, seed=2):
    kept = [
        (i, [math.floor(256 * int(x)) if abs(x) > 2**60 else math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    points = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(points))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for k, mine in groups.items():
            points[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    most = lambda n: min(n, centroids.LONG)
    sums = {k: sum(d for _, c, d in found if c == k) for _, k, _ in found}
    digest = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in points]
    return sorted(((i, k, most(d), most(sums[k]), most(sum(sums.values())), digest[k]) for i, k, d in found), key=repr)


def run(spark, rows, **more):
    prepared(spark)
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, sum string")
    return sorted((tuple(r) for r in centroids.clustered(frame.repartition(3), **more).collect()), key=repr)


def test_clusters_of_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(i % 5, 0.4), 2) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)]  # one very common vector
    rows += [(3, rows[3][1]), (None, [0.0] * 4), (None, None), (400, []), (401, [1.0] * 3), (402, [1.0] * 5)]
    rows += [(403, [1.0, None, 1.0, 1.0]), (404, [1.0, math.nan, 1.0, 1.0]), (405, [1.0, math.inf, 1.0, 1.0])]
    for clusters, rounds in ((8, 3), (1, 2), (1000, 2), (5, 0)):
        assert run(spark, rows, size=4, clusters=clusters, rounds=rounds) == plain(rows, 4, clusters, rounds)
    assert run(spark, [(1, None)], size=4) == run(spark, [], size=4) == []


def test_huge_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([0.5, -1.0, 1e9, 3.4e38, -1e200]) * rng.random() for _ in range(3)]) for i in range(40)]
    assert run(spark, rows, size=3, clusters=6, rounds=3) == plain(rows, 3, 6, 3)


def test_search_is_exact_with_ties():
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        points = rng.integers(-4, 5, (n, 2))  # many equal centroids and equal distances
        vectors = rng.integers(-5, 6, (500, 2))
        best, distance = centroids.Centroids(points).nearest(vectors)
        squares = ((vectors[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        assert (best == squares.argmin(axis=1)).all() and (distance == squares.min(axis=1)).all()
        many, _ = centroids.Centroids(points.astype(object)).nearest(vectors)
        assert (many == best).all()


def test_search_measures_fewer_than_all():
    rng = np.random.default_rng(4)
    points = rng.integers(0, 100, (40, 2)) * 50
    machine = centroids.Centroids(points)
    vectors = points[rng.integers(0, 40, 300)] + rng.integers(-3, 4, (300, 2))

    class Counted(np.ndarray):
        rows = 0

        def __getitem__(self, item):
            if isinstance(item, np.ndarray):
                Counted.rows += len(item)
            return np.asarray(super().__getitem__(item))

    machine.points = points.view(Counted)
    machine.nearest(vectors)
    assert Counted.rows < 300 * 40 * 0.6
