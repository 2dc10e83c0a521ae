"""Late replies: a stream in parts gives what the batch job gives; run logs survive their writer."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanmill.sinks import tables as K
from gleanmill.sources import stored as S
from gleanmill.streaming import replies as R

DAY = datetime(2026, 1, 1)
PENDING = "key string, asked_at timestamp, rule struct<relevant:boolean,reason:string>"
REPLIES = "key string, replied_at timestamp, reply_text string"


def day(n, hours=0):
    return DAY + timedelta(days=n, hours=hours)


def test_stream_equals_batch(spark, tmp_path):
    asked = [
        [("in time", day(0), (True, "r")), ("bad, then good", day(0), (False, "r")), (None, day(0), (False, "null key")), ("never", day(0), (True, "kept"))],
        [("too late", day(1), (False, "dropped")), ("twice", day(1), (True, "r")), ("twice", day(4), (True, "again"))],
        [("end", day(30), (True, "r"))],
    ]
    answers = [
        [("in time", day(1), '{"relevant": false, "reason": "no"}'), ("in time", day(1, 1), '{"relevant": true}'), ("bad, then good", day(0), "sorry"), (None, day(0), "{}")],
        [("bad, then good", day(2), '{"relevant": true, "reason": "yes"}'), ("twice", day(2), '{"relevant": false}'), ("too late", day(3, 1), '{"relevant": true}')],
        [("end", day(30), "{}")],
    ]
    places = [str(tmp_path / name) for name in ("asked", "answers")]
    for place, parts, shape in zip(places, (asked, answers), (PENDING, REPLIES)):
        for part in parts:
            spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(place)

    def verdicts(reader):
        frames = [reader(shape).parquet(place) for place, shape in zip(places, (PENDING, REPLIES))]
        return R.reply_verdicts(R.answered_rows(*frames))

    batch = R.settled(verdicts(lambda shape: spark.read.schema(shape)))
    out = str(tmp_path / "out")
    assert R.read_replies(spark, out) is None
    for _ in range(2):  # a second run finds nothing new
        R.follow_replies(verdicts(lambda shape: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1)), out, str(tmp_path / "c"), every=None).awaitTermination()
    rows = lambda frame: sorted(map(tuple, frame.collect()), key=str)
    got = rows(R.read_replies(spark, out))
    assert got == rows(batch)
    assert {(k, a): (v, by, why) for k, a, v, by, why, _ in got} == {
        ("in time", day(0)): (False, "llm-drop", "no"), ("bad, then good", day(0)): (True, "llm-keep", "yes"), (None, day(0)): (False, "rule-drop", "null key"),
        ("never", day(0)): (True, "llm-error-keep", "kept"), ("too late", day(1)): (False, "rule-drop", "dropped"), ("twice", day(1)): (False, "llm-drop", ""),
        ("twice", day(4)): (True, "llm-error-keep", "again"), ("end", day(30)): (True, "llm-keep", ""),
    }


def test_run_logs_read_back(spark, tmp_path):
    logs = spark.createDataFrame([(1, 5, "a\n{b}"), (2, 5, None), (3, 6, "c")], "id long, configId long, message string").withColumn("startedAt", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    K.write_run_logs(logs.coalesce(1), str(tmp_path / "log"))
    folder = tmp_path / "log" / "7" / "2026-01-03"
    folder.mkdir(parents=True)
    (folder / "x.json").write_text('{\n  "id": 4,\n  "extra": {\n    "a": [1]\n  },\n  "message": "d"\n}\n')
    (folder / "y.json").write_text('{"id": 5')
    found = S.run_logs(spark, str(tmp_path))
    assert {(r.id, r.configId, r.date, r.message) for r in S.readable(found).collect()} == {
        (1, 5, "2026-01-02", "a\n{b}"), (2, 5, "2026-01-02", None), (3, 6, "2026-01-02", "c"), (4, 7, "2026-01-03", "d"),
    }
    assert found.where("_corrupt_record IS NOT NULL").count() == 1


def test_late_replies_land_in_many_files(spark, tmp_path, monkeypatch):
    from gleanmill.queries import store_queries as Q

    orders = [(k, "O", datetime(1994 + 2 * (k // 20) % 8, 1, 1), "1-URGENT") for k in range(40)]
    lines = [(k, 1 + k % 3, "R" if k % 2 else "N", at + timedelta(days=10 if k % 5 else 130)) for k, _, at, _ in orders] + [(99, 1, "N", datetime(1999, 6, 1))]
    orders.append((50, "F", datetime(1999, 6, 1), "5-LOW"))
    dealt = lambda frame: frame.repartition(2)
    dealt(spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string")).write.parquet(str(tmp_path / "orders.parquet"))
    dealt(spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp_ntz")).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(Q, "fresh_folder", lambda _, name: str(tmp_path / "landing" / name))
    got = {r.o_orderkey: (r.relevant, r.by, r.decided_at) for r in Q.q_late_replies(spark, str(tmp_path)).collect()}
    want = {}
    for (k, _, at, _), (_, n, flag, came) in zip(orders, lines):
        read = k % 5 and n % 3
        want[k] = (flag != "R", "llm-keep" if flag != "R" else "llm-drop", came) if read else (True, "llm-error-keep", at + timedelta(days=120))
    want.pop(50, None)
    assert got == want
    assert len(list((tmp_path / "landing" / "asked").glob("*.parquet"))) > Q.PARTS
