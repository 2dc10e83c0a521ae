"""The prefix trie against a dictionary of all prefixes, and range searches against plain loops."""

import hashlib
import random
import zlib

import numpy as np

from gleanmill.llm import prefixes, ranges
from gleanmill.llm.common import prepared


def plain_trie(rebuilt):
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = lambda q: [p for p in nodes if len(p) == len(q) + 1 and p[: len(q)] == q]
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(path))))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children(path)),
            sum(not children(p) for p in under), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    head = lambda c: zlib.crc32(str(c).encode()) % 9
    return {c: own.get(c - c % 5, [])[: head(c)] + v[head(c) :] for c, v in own.items()}


def trie(spark, rows):
    prepared(spark)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, pos long, token string")
    turns = prefixes.spliced_turns(prefixes.numbered_turns(frame.repartition(3)))
    return sorted((tuple(r) for r in prefixes.prefix_trie(turns).collect()), key=repr)


def test_trie_of_odd_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in range(160):
        if c % 7:  # some are absent, so that others get no turns from them
            rows += [(c, t, rng.choice(("user", "assistant", None)), rng.choice(("a", "bé", None, ""))) for t in range(rng.randrange(1, 12))]
    rows += [(300 + c, t, "user", f"same {t}") for c in range(100) for t in range(3)]  # a large group of copies
    rows += [(None, 1, "user", "no id"), (3, None, "user", "before all"), (500, 0, "user", "x" * 10000), (503, 0, None, None)]
    rows += [(601, t, "user", f"long {t}") for t in range(300)]
    got = trie(spark, rows)
    assert got == plain_trie(plain_rebuilt(rows))
    assert any(d == 0 and n == len({r[0] for r in rows} - {None}) for _, d, _, n, *_ in got)


def test_small_and_empty_tables(spark):
    # equal turn numbers go by role first
    for rows in ([(7, 0, "u", "a")], [(0, 1, "b", "a"), (0, 1, "a", "a"), (5, 1, "a", "a"), (10, 1, "a", "a")], [(None, 0, "u", "a")]):
        assert trie(spark, rows) == plain_trie(plain_rebuilt(sorted(rows, key=str)))


def test_searches_over_many_levels(spark, monkeypatch, block=3):
    prepared(spark)
    monkeypatch.setattr(ranges, "BLOCK", block)
    monkeypatch.setattr(prefixes, "BLOCK", block)
    rng = random.Random(block)
    values = [-1] + [rng.choice((0, 3, 3, 4, 5, 9)) for _ in range(22)] + [7] * 7
    n = len(values)
    frame = spark.createDataFrame([(i, v, v * 3 % 11, 1) for i, v in enumerate(values)], "at long, v long, least long, w long")
    asks = [(i, d, side) for i in range(n) for d in (0, 1, 4, 8) for side in (True, False)]
    got = {tuple(r)[:3]: r["found"] for r in ranges.nearest_below(frame, spark.createDataFrame(asks, "start long, depth long, to_left boolean")).collect()}
    for i, d, side in asks:
        places = [j for j in (range(i, -1, -1) if side else range(i, n)) if values[j] < d]
        assert got[i, d, side] == (places[0] if places else None), (i, d, side)
    pairs = [(a, b) for a in range(0, n, 3) for b in range(a, n, 4)]
    totals = ranges.range_totals(frame, ["w"], spark.createDataFrame(pairs, "low long, high long")).collect()
    assert {(r["low"], r["high"]): (r["least"], r["w"]) for r in totals} == {
        (a, b): (min(v * 3 % 11 for v in values[a : b + 1]), b - a + 1) for a, b in pairs
    }


def test_sparse_table_of_one_block():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 255, 256):
        values = rng.integers(0, 4, n)
        table = ranges.sparse_table(values)
        low = rng.integers(0, n, 200)
        high = np.array([rng.integers(x, n) for x in low])
        assert (ranges.least_of(table, low, high) == [values[a : b + 1].min() for a, b in zip(low, high)]).all()
        depth = rng.integers(0, 6, 200)
        left = [next((j for j in range(a, -1, -1) if values[j] < d), -1) for a, d in zip(low, depth)]
        right = [next((j for j in range(a, n) if values[j] < d), n) for a, d in zip(low, depth)]
        assert (ranges.below_left(table, low, depth) == left).all()
        assert (ranges.below_right(table, low, depth) == right).all()
