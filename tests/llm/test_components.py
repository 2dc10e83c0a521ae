"""Buckets whose members do not link: no link is lost, and pairs do not grow with the square."""

import random

import pytest
from pyspark.sql import functions as F

from gleanmill.llm.common import stage
from gleanmill.llm.components import components_in_buckets, prefix_members, size_class


def brute(sets, percent):
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared) and shared:
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: find(i) for i in sets}


def run(spark, sets, keys, percent):
    """Components and the number of pairs that were verified."""
    members = spark.createDataFrame([(k, i, len(sets[i]), 0) for k, i in keys], "key long, id long, size long, place long")
    pairs = []

    def verify(frame):
        rows = frame.collect()
        pairs.extend((r.a, r.b) for r in rows)
        judged = []
        for r in rows:
            shared = len(sets[r.a] & sets[r.b])
            judged.append((r.a, r.b, 100 * shared >= percent * (r.n_a + r.n_b - shared)))
        return stage(spark.createDataFrame(judged, "a long, b long, linked boolean"))

    def elements(ids):
        wanted = [r.id for r in ids.collect()]
        return spark.createDataFrame([(i, e) for i in wanted for e in sets[i]], "id long, element long")

    found = {r.node: r.component for r in components_in_buckets(members, verify, elements, percent).collect()}
    assert len(pairs) == len(set(pairs))
    return {i: found.get(i, i) for i in sets}, len(pairs)


def copies(count, private, size=120):
    """Sets with a common stock, some of its elements exchanged for ones of their own."""
    draw = random.Random(7)
    out = {}
    for i in range(count):
        own = private(i)
        out[i] = set(draw.sample(range(size), size - own)) | {1000 * (i + 1) + j for j in range(own)}
    return out


def test_near_misses_are_not_compared_pair_by_pair(spark):
    sets = copies(300, lambda i: 16 + i % 9)
    got, pairs = run(spark, sets, [(0, i) for i in sets], 80)
    assert got == brute(sets, 80)
    assert pairs < 5 * len(sets)


@pytest.mark.parametrize("percent", [80, 85])
def test_mixed_buckets_lose_no_link(spark, percent):
    sets = copies(120, lambda i: (i * 7) % 25)
    sets[120], sets[121] = set(sets[5]), set(list(sets[5])[:-4])
    sets[122] = {1, 2, 3}
    keys = [(i % 2, i) for i in sets] + [(9, i) for i in sets if i % 3 == 0]
    # sets of one bucket meet, so all must be reachable through common buckets
    keys += [(7, i) for i in sets]
    got, _ = run(spark, sets, keys, percent)
    assert got == brute(sets, percent)


def test_prefixes_meet_for_every_linked_pair(spark):
    draw = random.Random(3)
    sets = {}
    for i in range(80):
        base = set(draw.sample(range(60), draw.randint(1, 50)))
        sets[2 * i] = base
        sets[2 * i + 1] = set(draw.sample(sorted(base), max(1, len(base) - draw.randint(0, 6))))
    rows = spark.createDataFrame([(i, e) for i, s in sets.items() for e in s], "id long, element long")
    keys = {}
    for r in prefix_members(rows, 80).collect():
        keys.setdefault(r.id, {})[r.key] = (r.size, r.place)
    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                need = 80 * (len(sets[a]) + len(sets[b]))
                assert any(
                    all(180 * (n - i) >= need for n, i in (keys[a][k], keys[b][k])) for k in keys[a].keys() & keys[b].keys()
                )


def test_size_classes_rise_without_gaps(spark):
    got = [r.c for r in spark.range(1, 5000).orderBy("id").select(F.expr(size_class("id")).alias("c")).collect()]
    assert got[:63] == list(range(1, 64))
    assert all(0 <= b - a <= 1 for a, b in zip(got, got[1:]))


def test_counts_given_with_members_and_prefixes_made_once(spark, monkeypatch):
    import sys

    from gleanmill.llm import components

    staged = []
    monkeypatch.setattr(components, "stage", lambda rows: staged.append(sorted(rows.columns)) or stage(rows))
    sets = copies(60, lambda i: 16 + i % 9)
    real = components_in_buckets
    counted = lambda members, *rest: real(members.withColumn("m", F.lit(len(sets)).cast("long")), *rest)
    monkeypatch.setattr(sys.modules[__name__], "components_in_buckets", counted)
    got, _ = run(spark, sets, [(0, i) for i in sets], 80)
    assert got == brute(sets, 80)
    # the buckets of large groups are dealt once, then counted and joined
    assert staged.count(["id", "key", "place", "size"]) == 1


def test_no_round_without_anybody_waiting(spark, monkeypatch):
    from gleanmill.llm import components

    staged = []
    monkeypatch.setattr(components, "stage", lambda rows: staged.append(sorted(rows.columns)) or stage(rows))
    # two components per bucket, and too few members for anybody to wait after the first round
    sets = {i: set(range(100 * (i % 2), 100 * (i % 2) + 50)) | {1000 + i} for i in range(12)}
    got, _ = run(spark, sets, [(0, i) for i in sets], 80)
    assert got == brute(sets, 80)
    assert sum("turn" in columns for columns in staged) == 1
