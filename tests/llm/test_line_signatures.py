"""Line signatures as expressions, against plain Python; no Python on the executors; no shuffle files left behind."""

import random
import time

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from gleanmill.llm import components, lines
from gleanmill.llm.common import CLEANUP, prepared, stage


@pytest.mark.parametrize("step", [7, 64, 1 << 15])
def test_signatures_against_plain_python(spark, monkeypatch, step):
    monkeypatch.setattr(lines, "STEP", step)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdé😀 \r ") for _ in range(n)) for n in (0, 8, 9, 39, 40, 41, 500, 3000)]
    texts += ["abc" * 90, "x" * 300, "😀" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    signed = rows.select("i", lines.signature(F.col("line"), 38).alias("s"), F.array_distinct(lines.shingles(F.col("line"))).alias("all"))
    for r in signed.collect():
        text = texts[r.i]
        want = {xxh64_intdigest(text[k : k + 9].encode(), 42) for k in range(len(text) - 8)}
        assert {h % 2**64 for h in r["all"]} == want and len(r["all"]) == len(want)
        bands = {h >> 60 for h in want if h >> 60 < lines.BANDS}
        assert len(r.s["keys"]) == len(set(r.s["keys"])) == (len(bands) if len(text) >= 40 else 0)
        assert {h % 2**64 for h in r.s["few"]} == (want if len(want) <= 38 else set())


def test_bands_agree_as_the_similarity_says(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        # 400 shingles each, 356 of them in both: similarity 0.8
        own = lambda n: "".join(chr(rng.randrange(97, 123)) for _ in range(n))
        shared = own(364)
        pairs.append((shared + own(44), shared + own(44)))
    rows = spark.createDataFrame(pairs, "a string, b string")
    keys = rows.select(*(lines.signature(F.col(c), 38)["keys"].alias(c) for c in "ab"))
    agree = [r.n for r in keys.select(F.size(F.array_intersect("a", "b")).alias("n")).collect()]
    # 13 bands at 0.8**4 each
    assert abs(sum(agree) / len(agree) - 13 * 0.8**4) < 0.6 and agree.count(0) <= 3


def test_no_python_on_the_executors(spark, monkeypatch):
    prepared(spark)
    plans = []

    def seen(rows):
        plans.append(rows._jdf.queryExecution().toString())
        return stage(rows)

    monkeypatch.setattr(lines, "stage", seen)
    monkeypatch.setattr(components, "stage", seen)
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(300))
    # a bucket of more than HUBS members that do not all link, so that sets are dealt anew
    texts = [base[: 300 - 6 * k] + "".join(rng.choice("stuvwxyz") for _ in range(6 * k)) for k in range(24)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fates = lines.without_repeats(docs)
    plans.append(fates._jdf.queryExecution().toString())
    assert 0 < fates.count() < 24
    assert any("posexplode" in p and "line_a" not in p for p in plans)
    assert not [p for p in plans if "Arrow" in p or "Python" in p]


def test_staged_tables_leave_no_shuffle_files(spark):
    def files():
        manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        found = manager.getAllFiles()
        return {found.apply(k).getName() for k in range(found.size())}

    shuffled = lambda: {f for f in files() if f.startswith("shuffle_")}
    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    staged = stage(rows)
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    assert sorted(r.n for r in staged.collect()) == [142] + [143] * 6
    assert spark.conf.get(CLEANUP, None) == setting


def test_signature_in_steps_is_the_signature(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdé ") for _ in range(n)) for n in (8, 9, 39, 40, 60, 90, 200, 700)]
    texts += ["abc" * 90, "x" * 300, "Copyright 2024 by the authors. " * 12, "y" * 40_000 + "".join(rng.choice("abc") for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, line string")
    steps = lines.with_signature(rows, "line", 38)
    plan = steps._jdf.queryExecution().optimizedPlan().toString()
    # hashes are made in one place, and sorted and looked through outside lambdas
    assert plan.count("regexp_extract_all") <= 6 and "sort_array(_h" in plan
    got = {r.i: (sorted(r.s["keys"]), sorted(r.s["few"])) for r in steps.collect()}
    want = {r.i: (sorted(r.s["keys"]), sorted(r.s["few"])) for r in rows.select("i", lines.signature(F.col("line"), 38).alias("s")).collect()}
    assert got == want


def test_bands_hold_the_least_different_hashes(spark):
    text = "the same words, " * 4 + "then others of their own; " * 2
    hashes = sorted({xxh64_intdigest(text[k : k + 9].encode(), 42) for k in range(len(text) - 8)})
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    want = [[signed(h) for h in hashes if h >> 60 == k][:4] for k in range(lines.BANDS)]
    rows = spark.createDataFrame([(text,)], "line string")
    s, places = F.col("s"), F.col("places")
    placed = rows.select(F.sort_array(lines.unordered(F.col("line"))).alias("s")).select("s", lines.places_of(s).alias("places"))
    got = placed.select(lines.different_of_bands(lines.first_of_bands(s, places), s, places).alias("b")).first().b
    # unsigned order is signed order within a band
    assert got == want


def test_ids_that_repeat_with_other_lines(spark):
    prepared(spark)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    base = own(300)
    rows = [(1, base), (1, own(90)), (2, base[:290] + own(10)), (None, base[5:]), (3, own(300)), (3, own(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.first_doc or 0) for r in lines.line_fates(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 3), (3, 3)]
