"""News archives, stores and streams over the given tables: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gleanmill.operators.verdicts import TTL_DAYS
from gleanmill.plans.export import taken_once
from gleanmill.queries.harvest_queries import FLAT, _flat
from gleanmill.queries.registry import query
from gleanmill.session import shared_dir, table
from gleanmill.sinks import tables as K
from gleanmill.sources import news as N
from gleanmill.streaming import feed, replies


def fresh_folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- news archive -----------------------------------------------------------

MONTHS = ("202601", "202602", "202603")


def write_news_archive(spark, folder: str, root: str) -> None:
    """documents as article files under a folder per month; some without title, without id, or damaged."""
    n = F.col("doc_id")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    title = F.when(n % 19 == 0, F.lit(" ")).otherwise(F.concat(F.when(n % 5 == 0, F.lit("DMZ & <")).otherwise(F.lit("R&D <")), text(n), F.lit(">")))
    article = F.struct(
        F.struct(
            F.when(n % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("AKR"), text(n))).alias("ContentID"),
            F.concat(F.element_at(F.array(*map(F.lit, MONTHS)), (n % 3 + 1).cast("int")), F.lpad(text(1 + n % 28), 2, "0")).alias("SendDate"),
            F.concat(text(n % 10), F.lit("1502")).alias("SendTime"),
        ).alias("Header"),
        F.struct(
            F.when(n % 46 == 0, F.lit("")).otherwise(F.concat(F.lit("https://news.example/"), text(n))).alias("Href"),
            F.when(n % 2 == 0, F.col("lang")).otherwise("").alias("Writer"),
        ).alias("Metadata"),
        F.struct(
            title.alias("Title"),
            F.concat(title, F.lit("\n\n"), F.when(n % 2 == 1, F.lit("(서울=연합뉴스) 김가나 기자 = 첫 줄\n")).otherwise(""), _flat(text(F.col("text")))).alias("Body"),
        ).alias("NewsContent"),
    )
    articles = table(spark, folder, "documents").select("doc_id", article.alias("a"))
    for k, month in enumerate(MONTHS):
        own = articles.where((n % 3 == k) & (n % 29 != 0)).select("a.*")
        own.write.format("xml").option("rootTag", "Feed").option("rowTag", "YNewsML").save(f"{root}/{month}")
        broken = F.regexp_replace(F.to_xml("a", {"rowTag": "YNewsML"}), "</Header>", "</Head>")
        articles.where((n % 3 == k) & (n % 29 == 0)).select(broken.alias("value")).write.mode("append").text(f"{root}/{month}")


NEWS_SQL = f"""
WITH d AS (SELECT *, doc_id AS n FROM documents WHERE doc_id % 3 = 1),
p AS (
  SELECT *, CASE WHEN n % 29 = 0 THEN 'unreadable' WHEN n % 19 = 0 THEN 'no title' WHEN n % 46 = 0 THEN 'no id' END AS problem,
    (CASE WHEN n % 5 = 0 THEN 'DMZ & <' ELSE 'R&D <' END) || n || '>' AS title
  FROM d)
SELECT problem, CASE WHEN n % 23 = 0 THEN '' ELSE 'AKR' || n END AS guid, title, 'https://news.example/' || n AS link,
  '2026-02-' || lpad((1 + n % 28)::VARCHAR, 2, '0') || ' 0' || (n % 10) || ':15:02' AS reg_dt,
  CASE WHEN n % 2 = 0 THEN lang ELSE '김가나' END AS writer,
  sha256((CASE WHEN n % 2 = 1 THEN '(서울=연합뉴스) 김가나 기자 = 첫 줄<br>' ELSE '' END) || {FLAT.replace("text", "coalesce(text, '')")}) AS content_sha256,
  CASE WHEN n % 5 = 0 THEN 'DMZ' ELSE '' END AS matched
FROM p WHERE problem IS NULL
UNION ALL
SELECT problem, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE problem IS NOT NULL"""


@query(NEWS_SQL)
def q_scan_news_month(spark, folder):
    """One month of an archive: its articles and its rejects."""
    root = fresh_folder(spark, "news")
    write_news_archive(spark, folder, root)
    scanned = N.scan_news_xml(spark, root, MONTHS[1], "part-*")
    good = N.articles_from_xml(scanned).select(
        F.lit(None).cast("string").alias("problem"), "guid", "title", "link", "reg_dt", "writer", F.sha2("content", 256).alias("content_sha256"),
        F.array_join("matched_keywords", ",").alias("matched"),
    )
    return good.unionByName(N.news_xml_errors(scanned).select("problem"), allowMissingColumns=True)


# ---- verdict store ----------------------------------------------------------

@query(f"""
WITH v AS (
  SELECT CASE WHEN o_custkey % 2 = 0 THEN 'news' ELSE 'publisher' END AS classifier, o_custkey::VARCHAR AS key,
    o_orderpriority AS value, o_orderdate + to_seconds(o_orderkey) AS decided_at FROM orders)
SELECT classifier, key, arg_max(value, decided_at) AS value, max(decided_at) AS decided_at FROM v GROUP BY ALL
HAVING classifier <> 'news' OR max(decided_at) >= TIMESTAMP '1998-12-01' - INTERVAL {TTL_DAYS} DAY""")
def q_verdict_store(spark, folder):
    """Orders flushed as verdicts in five deltas, full buckets merged, expired ones gone."""
    path, as_of = fresh_folder(spark, "verdicts"), F.to_timestamp(F.lit("1998-12-01"))
    orders = table(spark, folder, "orders")
    verdicts = orders.select(
        F.when(F.col("o_custkey") % 2 == 0, "news").otherwise("publisher").alias("classifier"), F.col("o_custkey").cast("string").alias("key"),
        F.col("o_orderpriority").alias("value"), F.lit("llm").alias("by"), F.lit("").alias("reason"),
        F.timestamp_add("SECOND", F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")).alias("decided_at"), (F.col("o_orderkey") % 5).alias("_part"),
    )
    for part in range(5):
        K.flush_verdicts(path, verdicts.where(F.col("_part") == part).drop("_part"), as_of)
        K.compact_verdicts(path, spark, as_of, most=3)
    return K.read_verdicts(spark, path, as_of).select("classifier", "key", "value", F.col("decided_at").cast("timestamp_ntz").alias("decided_at"))


# ---- tables that change -----------------------------------------------------

@query("""
SELECT o_orderkey, o_custkey % 5 AS origin_id, CASE WHEN o_orderkey % 11 = 0 THEN 'changed' WHEN o_orderkey % 3 = 0 THEN 'twice' ELSE o_orderpriority END AS value FROM orders""")
def q_upsert_table(spark, folder):
    """Two thirds of the orders inserted, half overwritten or added, some changed in place, the rest inserted."""
    path, n = fresh_folder(spark, "orders"), F.col("o_orderkey")
    rows = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("origin_id"), F.col("o_orderpriority").alias("value"))
    K.insert_new(rows.where(n % 3 != 1), path, "o_orderkey", buckets=4)
    K.upsert(rows.where((n % 3 == 0) | (n % 6 == 1)).withColumn("value", F.when(n % 3 == 0, "twice").otherwise(F.col("value"))), path, "o_orderkey", buckets=4)
    K.insert_new(rows, path, "o_orderkey", buckets=4)
    K.rewrite_changed(path, rows.where(n % 11 == 0).withColumn("value", F.lit("changed")), "o_orderkey", ["value"], buckets=4)
    return K.read_table(spark, path).select("o_orderkey", F.col("origin_id").cast("long").alias("origin_id"), "value")


# ---- stream dedupe ----------------------------------------------------------

PARTS = 4


@query(f"""
WITH e AS (SELECT event_id, user_id, event_id % {PARTS} AS part FROM events WHERE user_id % 10 <> 0)
SELECT user_id, part, min(event_id) AS event_id, part > min(part) OVER (PARTITION BY user_id) AS again FROM e GROUP BY user_id, part""")
def q_stream_offers(spark, folder):
    """Events arriving in four parts: each user's first event per part, unless a table has the user."""
    landing, stored, out = (fresh_folder(spark, name) for name in ("landing", "stored", "offers"))
    events = table(spark, folder, "events").select("event_id", "user_id", (F.col("event_id") % PARTS).alias("part"))
    for part in range(PARTS):
        events.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(landing)
    events.where("user_id % 10 = 0").select("user_id").distinct().write.parquet(stored)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    offers = feed.first_offers(stream, feed.stored_keys(spark, stored, "user_id", "long"), "user_id", ["event_id"])
    query_ = offers.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(
        lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")
    ).start()
    query_.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("user_id", "part", "event_id", "again")


# ---- replies that arrive later ----------------------------------------------

WAIT, LATE = "120 days", "12 hours"


def _era(at):
    """Parts in the order of time, as a landing folder gets them."""
    return F.least(F.greatest(F.floor((F.year(at) - 1993) / 2), F.lit(0)), F.lit(PARTS - 1))


@query("""
WITH r AS (SELECT l_orderkey, l_shipdate AS came, l_linenumber % 3 <> 0 AS ok, l_returnflag <> 'R' AS keep, l_shipdate::DATE || ' ' || l_linenumber AS why,
    CASE WHEN l_linenumber % 3 = 0 THEN 'sorry' ELSE '{"relevant":' || (l_returnflag <> 'R') || ',"reason":"' || l_shipdate::DATE || ' ' || l_linenumber || '"}' END AS reply FROM lineitem),
w AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 12 HOUR AS mark),
j AS (SELECT o.*, r.*, coalesce(ok, false) AS good FROM orders o LEFT JOIN r ON l_orderkey = o_orderkey AND came >= o_orderdate AND came <= o_orderdate + INTERVAL 120 DAY),
n AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY NOT good, CASE WHEN good THEN came END, reply) AS place FROM j)
SELECT o_orderkey, CASE WHEN good THEN keep ELSE o_orderstatus <> 'F' END AS relevant,
    CASE WHEN good THEN CASE WHEN keep THEN 'llm-keep' ELSE 'llm-drop' END WHEN o_orderstatus <> 'F' THEN 'llm-error-keep' ELSE 'rule-drop' END AS by,
    CASE WHEN good THEN why ELSE o_orderpriority END AS reason, CASE WHEN good THEN came ELSE o_orderdate + INTERVAL 120 DAY END AS decided_at
FROM n, w WHERE place = 1 AND (came IS NOT NULL OR o_orderdate + INTERVAL 120 DAY < mark)""")
def q_late_replies(spark, folder):
    """Orders wait for their lines as replies, four parts of each arriving in turn; the last ones still wait."""
    asked, answers, out = (fresh_folder(spark, name) for name in ("asked", "answers", "verdicts"))
    pending = table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("asked_at"),
        F.struct((F.col("o_orderstatus") != "F").alias("relevant"), F.col("o_orderpriority").alias("reason")).alias("rule"),
    )
    why = F.concat_ws(" ", F.date_format("l_shipdate", "yyyy-MM-dd"), F.col("l_linenumber").cast("string"))
    reply = F.to_json(F.struct((F.col("l_returnflag") != "R").alias("relevant"), why.alias("reason")))
    replied = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").cast("timestamp").alias("replied_at"),
        F.when(F.col("l_linenumber") % 3 == 0, "sorry").otherwise(reply).alias("reply_text"),
    )
    follow = lambda path, like: spark.readStream.schema(like.schema).parquet(path)
    for part in range(PARTS):
        pending.where(_era("asked_at") == part).write.mode("append").parquet(asked)
        replied.where(_era("replied_at") == part).write.mode("append").parquet(answers)
        # a part is as many files as its tasks make, so the stream takes what has come and goes on from its checkpoint
        met = replies.answered_rows(follow(asked, pending), follow(answers, replied), "o_orderkey", wait=WAIT, late=LATE)
        verdicts = replies.reply_verdicts(met, "o_orderkey", wait=WAIT)
        replies.follow_replies(verdicts, f"{out}/rows", f"{out}/checkpoint", every=None).awaitTermination()
    return replies.read_replies(spark, f"{out}/rows", "o_orderkey").select(
        "o_orderkey", "relevant", "by", "reason", F.col("decided_at").cast("timestamp_ntz").alias("decided_at")
    )


# ---- polls that deliver again -----------------------------------------------

@query("SELECT via, event_id, user_id FROM events, (SELECT unnest(['polls', 'stream']) AS via)")
def q_export_polls(spark, folder):
    """Events polled four times, each poll from an hour before the last one's end: each event is kept once."""
    landing, out = fresh_folder(spark, "polls"), fresh_folder(spark, "taken")
    events = table(spark, folder, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("modified_at"))
    first, last = events.agg(F.min(F.unix_seconds("modified_at")), F.max(F.unix_seconds("modified_at"))).first()
    first, last = first or 0, last or 0
    step = (last - first) // PARTS + 1
    second = F.unix_seconds("modified_at")
    for poll in range(PARTS):
        polled = events.where((second >= first + poll * step - 3600) & (second < first + (poll + 1) * step))
        polled.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    taken_once(stream, "event_id", back="2 hours").writeStream.option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").format("parquet").trigger(
        availableNow=True
    ).start().awaitTermination()
    streamed = spark.read.parquet(f"{out}/rows").withColumn("via", F.lit("stream"))
    polls = taken_once(spark.read.schema(events.schema).parquet(landing), "event_id").withColumn("via", F.lit("polls"))
    return polls.unionByName(streamed).select("via", "event_id", "user_id")
