"""Dedup, joins, roll-ups, numbering, change sets and loads over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import text as X
from gleanmill.functions import values as A
from gleanmill.operators import dedupe as U
from gleanmill.operators import frontier as W
from gleanmill.operators import joins as J
from gleanmill.operators import numbering as B
from gleanmill.operators import paging as L
from gleanmill.operators import rollups as G
from gleanmill.operators import verdicts as R
from gleanmill.plans import export, load
from gleanmill.queries.registry import query
from gleanmill.rules.cascades import menu_of
from gleanmill.session import table


def _s(name: str):
    return F.col(name).cast("string")


# ---- dedup ------------------------------------------------------------------

@query("SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS copies FROM documents GROUP BY text")
def q_keep_first(spark, folder):
    docs = table(spark, folder, "documents").withColumn("digest", F.sha2("text", 256))
    copies = U.first_per_key(docs, "digest", "doc_id").select("doc_id", "copies")
    return U.keep_first(docs, "digest", "doc_id").join(copies, "doc_id").select("doc_id", "lang", "copies")


@query("""
SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS is_first FROM documents""")
def q_flag_first(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return U.flag_first(docs, "digest", "doc_id").select("doc_id", "is_first")


@query("""
WITH f AS (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
w AS (SELECT o_custkey, string_agg(o_orderpriority, ',' ORDER BY k) AS matched FROM f GROUP BY 1)
SELECT w.o_custkey::VARCHAR AS source_id, matched, min(o_orderkey) AS seq, arg_min(o_orderstatus, o_orderkey) AS title
FROM orders JOIN w USING (o_custkey) GROUP BY 1, 2""")
def q_merge_keywords(spark, folder):
    items = table(spark, folder, "orders").select(
        F.lit("orders").alias("source"), _s("o_custkey").alias("source_id"), F.col("o_orderstatus").alias("title"),
        F.col("o_orderpriority").alias("matched_keyword"), F.col("o_orderkey").alias("seq"),
    )
    merged = U.merge_by_source_id(items)
    return merged.select("source_id", F.array_join("matched_keywords", ",").alias("matched"), "seq", "title")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def q_new_only(spark, folder):
    stored = table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return U.without_stored(table(spark, folder, "orders"), stored, "o_orderkey").select("o_orderkey")


@query("""
SELECT s_name AS name, 'supplier' AS kind FROM supplier
UNION ALL SELECT name, 'customer' FROM (SELECT replace(c_name, 'Customer', 'Supplier') AS name FROM customer)
    WHERE name NOT IN (SELECT s_name FROM supplier)""")
def q_set_fill(spark, folder):
    target = table(spark, folder, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    legacy = table(spark, folder, "customer").select(
        F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name"), F.lit("customer").alias("kind")
    )
    return U.fill_missing(target, legacy, "name")


@query("""
WITH l AS (SELECT user_id AS crawl, day(ts)::BIGINT AS page, event_id AS pos, props AS url_key FROM events WHERE event_type <> 'error'),
read AS (SELECT DISTINCT user_id AS crawl, day(ts)::BIGINT AS page FROM events),
first AS (SELECT *, row_number() OVER (PARTITION BY crawl, url_key ORDER BY page, pos) = 1 AS fresh FROM l),
pages AS (SELECT crawl, page, count(*) FILTER (fresh) AS n FROM read LEFT JOIN first USING (crawl, page) GROUP BY 1, 2),
stops AS (SELECT crawl, min(page) AS stop FROM pages WHERE n = 0 GROUP BY 1),
open AS (SELECT f.* FROM first f LEFT JOIN stops s USING (crawl) WHERE fresh AND (stop IS NULL OR page < stop)),
taken AS (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY crawl, page, pos) AS rn FROM open)
SELECT url_key, crawl, page, pos FROM taken WHERE rn = 1""")
def q_page_stop(spark, folder):
    return W.frontier(*_crawls(spark, folder))


def _crawls(spark, folder):
    """Links and pages: a user's days are the pages of one crawl, properties the listed urls; an error lists none."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("crawl"), F.dayofmonth("ts").cast("long").alias("page"),
        F.col("event_id").alias("pos"), F.col("props").alias("url_key"), "event_type",
    )
    return events.where("event_type <> 'error'").drop("event_type"), events.select("crawl", "page")


@query("""
WITH l AS (SELECT user_id AS crawl, day(ts)::BIGINT AS page, event_id AS pos, props AS url_key FROM events WHERE event_type <> 'error'),
read AS (SELECT DISTINCT user_id AS crawl, day(ts)::BIGINT AS page FROM events),
first AS (SELECT *, row_number() OVER (PARTITION BY crawl, url_key ORDER BY page, pos) = 1 AS fresh FROM l)
SELECT crawl, min(page) AS stop_page FROM (SELECT crawl, page, count(*) FILTER (fresh) AS n FROM read LEFT JOIN first USING (crawl, page) GROUP BY 1, 2) WHERE n = 0 GROUP BY 1""")
def q_stop_pages(spark, folder):
    return W.page_stops(*_crawls(spark, folder))


# ---- joins ------------------------------------------------------------------

@query("""
SELECT c_custkey AS key, max(o_orderkey) AS last_order, max(o_orderkey) IS NOT NULL AS found
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1""")
def q_match_miss(spark, folder):
    requested = table(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    stored = table(spark, folder, "orders").where("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("last_order")
    )
    return J.match_requested(requested, stored, "key", "last_order").select("key", "last_order", "found")


@query("""
SELECT c_custkey, n_nationkey IS NOT NULL AS has_origin, n_name AS origin_nm, r_name AS category_nm FROM customer
LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'NATION_3') n ON c_nationkey = n_nationkey
LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON n_regionkey = r_regionkey""")
def q_dim_join(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("origin_id"))
    origin = table(spark, folder, "nation").where("n_name <> 'NATION_3'").select(
        F.col("n_nationkey").alias("origin_id"), F.col("n_name").alias("origin_nm"), F.col("n_regionkey").alias("category_code")
    )
    category = table(spark, folder, "region").where("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("category_code"), F.col("r_name").alias("category_nm")
    )
    return J.join_dimensions(rows, origin, category, "c_custkey").select("c_custkey", "has_origin", "origin_nm", "category_nm")


@query("""
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM conversations WHERE role = 'assistant')
SELECT conv_id, position, u.turn AS asked, a.turn AS answered FROM u JOIN a USING (conv_id, position)""")
def q_positional(spark, folder):
    turns = table(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("asked"))
    answered = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("answered"))
    return J.zip_by_position(asked, answered, ["conv_id"], "asked", "answered")


_WORDS = ("DMZ", "접경 지역", "a&b(c)")


@query("""
WITH e AS (SELECT n_nationkey * 3 + w.i AS seq, n_name AS name, w.k AS keyword,
    'https://s.example/' || n_regionkey || '/q?w=' || replace(replace(url_encode(w.k), '%28', '('), '%29', ')') AS url
    FROM nation, (VALUES (0, 'DMZ'), (1, '접경 지역'), (2, 'a&b(c)')) w(i, k))
SELECT url, min(seq)::BIGINT AS seq, arg_max(name, seq) AS name, arg_max(keyword, seq) AS keyword FROM e GROUP BY url""")
def q_harvest_plan(spark, folder):
    """Start urls × keywords; equal urls keep the first place and the last values."""
    start = table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("long").alias("no"), F.col("n_name").alias("name"),
        F.concat(F.lit("https://s.example/"), _s("n_regionkey"), F.lit("/q?w={keyword}")).alias("url"),
        F.array(*[F.lit(w) for w in _WORDS]).alias("keywords"),
    )
    entries = J.expand_keywords(start).withColumn("seq", F.col("no") * len(_WORDS) + F.col("word_no"))
    return J.distinct_urls(entries.select("url", "seq", "name", "keyword"))


@query("""
SELECT n_name, k AS keyword, f AS field, (n_nationkey * 4 + i * 2 + j)::BIGINT AS request FROM nation JOIN region ON n_regionkey = r_regionkey,
    (VALUES (0, 'DMZ'), (1, 'MDL')) w(i, k), (VALUES (0, 'title'), (1, 'keyword')) p(j, f) WHERE r_name <> 'AFRICA'""")
def q_request_plan(spark, folder):
    region = table(spark, folder, "region").where("r_name <> 'AFRICA'").select(F.col("r_regionkey").alias("n_regionkey"))
    sources = table(spark, folder, "nation").join(region, "n_regionkey", "left_semi")
    plan = J.harvest_plan(sources, ("DMZ", "MDL"), ("title", "keyword"))
    request = (F.col("n_nationkey") * 4 + F.col("keyword_no") * 2 + F.col("field_no")).cast("long")
    return plan.select("n_name", "keyword", "field", request.alias("request"))


@query("""
WITH t AS (SELECT o_custkey, ceil(count(*) / 3.0)::BIGINT AS pages FROM orders GROUP BY 1),
e AS (SELECT o_custkey, unnest(generate_series(1, pages)) AS page FROM t),
c AS (SELECT DISTINCT o_custkey, o_orderkey % 4 + 1 AS page FROM orders WHERE o_orderstatus = 'F')
SELECT o_custkey, page FROM e WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.o_custkey = e.o_custkey AND c.page = e.page)""")
def q_capture_gap(spark, folder):
    orders = table(spark, folder, "orders")
    totals = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("total")).withColumn("page_size", F.lit(3))
    captured = orders.where("o_orderstatus = 'F'").select("o_custkey", (F.col("o_orderkey") % 4 + 1).alias("page"))
    return J.capture_gap(totals, captured)


@query("""
WITH t AS (SELECT l_suppkey, max(l_orderkey) + 3 AS total FROM lineitem GROUP BY 1),
c AS (SELECT DISTINCT l_suppkey, l_orderkey AS page FROM lineitem WHERE l_orderkey >= 1
      UNION ALL SELECT l_suppkey, total + 1 FROM t)
SELECT l_suppkey, first_page, last_page FROM (
  SELECT l_suppkey, coalesce(lag(page) OVER (PARTITION BY l_suppkey ORDER BY page), 0) + 1 AS first_page, page - 1 AS last_page FROM c)
WHERE first_page <= last_page""")
def q_capture_gaps(spark, folder):
    """Order numbers as pages of a supplier: long gaps stay one row each."""
    lines = table(spark, folder, "lineitem")
    totals = lines.groupBy("l_suppkey").agg((F.max("l_orderkey") + 3).alias("total")).withColumn("page_size", F.lit(1))
    return J.capture_gaps(totals, lines.select("l_suppkey", F.col("l_orderkey").alias("page")))


@query("""
SELECT p_partkey, CASE WHEN menu = 'BOOKS' AND regexp_full_match(isbn, '[0-9]{10}') THEN cover END AS cover_url FROM (
    SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END AS menu,
        lpad(p_partkey::VARCHAR, CASE WHEN p_size % 4 = 0 THEN 9 ELSE 10 END, '0') AS isbn, s_name || '.jpg' AS cover
    FROM part LEFT JOIN supplier ON s_suppkey = p_partkey)""")
def q_covers(spark, folder):
    width = F.when(F.col("p_size") % 4 == 0, 9).otherwise(10)
    books = table(spark, folder, "part").select(
        "p_partkey",
        F.when(F.col("p_type") == "ECONOMY", "BOOKS").otherwise("PAPERS").alias("menu_id"),
        F.when(width == 9, F.lpad(_s("p_partkey"), 9, "0")).otherwise(F.lpad(_s("p_partkey"), 10, "0")).alias("isbn"),
    )
    covers = table(spark, folder, "supplier").select(
        F.lpad(_s("s_suppkey"), 10, "0").alias("isbn"), F.concat("s_name", F.lit(".jpg")).alias("cover_url")
    )
    return J.join_covers(books, covers, "p_partkey").select("p_partkey", "cover_url")


@query("""
SELECT c_custkey, c_name AS name, CASE WHEN o.k IS NOT NULL THEN '' ELSE c_mktsegment END AS segment, o.k::VARCHAR AS extra
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o_custkey = c_custkey""")
def q_overlay(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment")).alias("fields")
    )
    details = (
        table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k"))
        .select("c_custkey", F.create_map(F.lit("segment"), F.lit(""), F.lit("extra"), F.col("k").cast("string")).alias("fields"))
    )
    out = J.overlay(rows, details, "c_custkey")
    return out.select("c_custkey", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("name", "segment", "extra")])


@query("""
WITH t AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'T' || d.doc_id END AS title_en,
    CASE WHEN d.doc_id % 2 = 0 THEN 'own' WHEN l.toxic = 1 THEN 'S' || d.doc_id END AS summary_en FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, title_en, summary_en, CASE WHEN title_en IS NOT NULL OR summary_en IS NOT NULL THEN 'Y' ELSE 'N' END AS flag FROM t""")
def q_translation_join(spark, folder):
    n = _s("doc_id")
    rows = table(spark, folder, "documents").select(
        "doc_id", F.lit(" ").alias("title_en"), F.when(F.col("doc_id") % 2 == 0, "own").alias("summary_en"), F.lit(None).cast("string").alias("author_en")
    )
    labels = table(spark, folder, "labels")
    translated = labels.where("quality = 1").select("doc_id", F.lit("title").alias("field"), F.concat(F.lit("T"), n).alias("text")).unionByName(
        labels.where("toxic = 1").select("doc_id", F.lit("summary").alias("field"), F.concat(F.lit("S"), n).alias("text"))
    )
    out = R.english_fields(rows, translated, "doc_id")
    return out.select("doc_id", "title_en", "summary_en", X.translated_flag("title_en", "summary_en").alias("flag"))


# ---- unions -----------------------------------------------------------------

@query("""
SELECT 'customer' AS source, c_custkey::VARCHAR AS source_id, c_name AS title, NULL::VARCHAR AS category, NULL::VARCHAR AS message FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name, NULL, NULL FROM supplier WHERE s_acctbal >= 0
UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name, p_type, NULL FROM part
UNION ALL SELECT 'customer', c_custkey::VARCHAR, NULL, NULL, 'negative' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, NULL, NULL, 'negative' FROM supplier WHERE s_acctbal < 0""")
def q_union_sources(spark, folder):
    """Three shapes to one, error rows beside the records."""
    def shaped(name, key, title, balance=None, category=None):
        rows = table(spark, folder, name)
        columns = [F.lit(name).alias("source"), _s(key).alias("source_id"), F.col(title).alias("title")]
        good = rows if balance is None else rows.where(F.col(balance) >= 0)
        items = good.select(*columns, *([F.col(category).alias("category")] if category else []))
        if balance is None:
            return items, None
        return items, rows.where(F.col(balance) < 0).select(*columns[:2], F.lit("negative").alias("message"))

    frames = [shaped("customer", "c_custkey", "c_name", "c_acctbal"), shaped("supplier", "s_suppkey", "s_name", "s_acctbal"), shaped("part", "p_partkey", "p_name", None, "p_type")]
    out = frames[2][0]
    for frame in [frames[0][0], frames[1][0], frames[0][1], frames[1][1]]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select("source", "source_id", "title", "category", "message")


# ---- roll-ups ---------------------------------------------------------------

@query("""
WITH b AS (SELECT p_brand AS publisher, count(*) AS n, min(p_partkey) AS first_seq, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY 1)
SELECT (row_number() OVER (ORDER BY n DESC, first_seq) - 1)::BIGINT AS rank, publisher, n, kind AS verdict,
    CASE WHEN kind = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END AS menu_id FROM b""")
def q_report_rollup(spark, folder):
    metas = _part_metas(spark, folder)
    ranked = G.publisher_rollup(metas).withColumn("down", -F.col("n"))
    return B.with_position(ranked, ["down", "first_seq"], name="rank").select("rank", "publisher", "n", "verdict", "menu_id")


def _part_metas(spark, folder):
    kind = F.when(F.col("p_type") == "ECONOMY", "book").otherwise("article")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("seq"),
        F.col("p_brand").alias("publisher"),
        F.col("p_name").alias("title"),
        _s("p_size").alias("publish_year"),
        F.concat(F.lit("P:"), _s("p_partkey")).alias("register_no"),
        menu_of(kind, F.lit("PRIVATE")).alias("menu_id"),
        F.struct(F.col("p_type").alias("verdict"), F.lit("pattern").alias("by")).alias("classification"),
        F.array(F.col("p_type")).alias("matched_keywords"),
    )


@query("""
WITH p AS (SELECT CASE WHEN p_type = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END AS menu, p_brand, p_name, p_size::VARCHAR AS year,
    '[P:' || p_partkey || '] ' || p_size || ' | ' || p_brand || ' → ' || p_type || '(패턴) | "' || p_name || '" | 키워드: ' || p_type AS line FROM part)
SELECT CASE menu WHEN 'PAPERS' THEN 6 ELSE 8 END AS section, count(*) AS n, min(line) AS first_line, max(line) AS last_line FROM p GROUP BY 1
UNION ALL SELECT 2, count(*), min(line), max(line) FROM (SELECT lpad(count(*)::VARCHAR, 5, ' ') || '건 | ' ||
    rpad(CASE WHEN arg_min(p_type, p_partkey) = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END, 12, ' ') || ' | ' ||
    CASE WHEN length(arg_min(p_type, p_partkey)) < 7 THEN rpad(arg_min(p_type, p_partkey), 7, ' ') ELSE arg_min(p_type, p_partkey) END
    || '/' || rpad('패턴', 10, ' ') || ' | ' || p_brand AS line FROM part GROUP BY p_brand)""")
def q_report_lines(spark, folder):
    """The status report's publisher and item lines, summed up per section."""
    lines = G.report_lines(_part_metas(spark, folder), "parts", 1, "2026-01-01 00:00:00")
    body = lines.where(F.col("section").isin(2, 4, 6, 8))
    return body.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))


@query("""
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'BOOKS' WHEN c_mktsegment = 'MACHINERY' THEN 'PUBLICATIONS' ELSE 'PAPERS' END AS menu_id, count(*) AS n FROM customer GROUP BY 1""")
def q_menu_counts(spark, folder):
    menu = F.when(F.col("c_mktsegment") == "BUILDING", "BOOKS").when(F.col("c_mktsegment") == "MACHINERY", "PUBLICATIONS").otherwise(F.col("c_mktsegment"))
    return G.menu_counts(table(spark, folder, "customer").select(menu.alias("menu_id")))


_NEW_SEGMENT = "CASE WHEN c_acctbal < 0 THEN 'HOUSEHOLD' WHEN c_acctbal > 9000 THEN 'BUILDING' ELSE c_mktsegment END"


def _segments(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", F.expr(_NEW_SEGMENT).alias("new_segment"))


@query(f"SELECT c_mktsegment, {_NEW_SEGMENT} AS new_segment, count(*) AS n FROM customer WHERE c_mktsegment <> {_NEW_SEGMENT} GROUP BY 1, 2")
def q_move_matrix(spark, folder):
    return G.move_matrix(_segments(spark, folder), "c_mktsegment", "new_segment")


@query(f"""
WITH c AS (SELECT c_name, {_NEW_SEGMENT} AS target FROM customer WHERE c_mktsegment <> {_NEW_SEGMENT}),
n AS (SELECT *, (row_number() OVER (PARTITION BY target ORDER BY c_name) - 1) // 40 AS chunk FROM c)
SELECT target, chunk::BIGINT AS chunk, count(*) AS n, 'UPDATE archive SET menu_id = ''' || target || ''', mdfcn_dt = SYSDATETIME' || chr(10) ||
    'WHERE remark = ''all'' AND register_no IN (' || string_agg('''' || c_name || '''', ', ' ORDER BY c_name) || ');' AS statement FROM n GROUP BY target, chunk""")
def q_change_script(spark, folder):
    rows = _segments(spark, folder)
    changed = J.change_set(
        rows.select("c_name", F.col("c_mktsegment").alias("menu")), rows.select("c_name", F.col("new_segment").alias("menu")), "c_name", ["menu"]
    )
    return G.in_list_script(changed.select("c_name", F.col("new_menu").alias("target")), "c_name", "target", "archive", "all", size=40)


@query(f"""
SELECT c_name AS register_no, 'UPDATE archive SET menu_id=''' || {_NEW_SEGMENT} || ''', category=''it''''s ' || c_custkey || ''', category_en=NULL, mdfcn_dt=SYSDATETIME WHERE register_no='''
    || c_name || ''';' AS statement FROM customer""")
def q_row_script(spark, folder):
    rows = _segments(spark, folder).select(
        F.col("c_name").alias("register_no"), F.col("new_segment").alias("menu_id"), F.concat(F.lit("it's "), _s("c_custkey")).alias("category")
    )
    return G.row_script(rows, "archive")


@query("""
SELECT user_id AS configId, strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS succeeded,
    sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS items, round(avg(json_extract_string(props, '$.k')::BIGINT + 1), 3) AS mean_seconds FROM events GROUP BY 1, 2""")
def q_run_log(spark, folder):
    k = F.get_json_object("props", "$.k").cast("long")
    start = F.date_trunc("second", F.col("ts").cast("timestamp"))
    logs = table(spark, folder, "events").select(
        F.col("user_id").alias("configId"), start.alias("startedAt"), F.timestamp_seconds(F.unix_timestamp(start) + k + 1).alias("endedAt"),
        k.alias("itemCount"), (F.col("event_type") != "error").alias("success"),
    )
    out = G.run_rollup(logs)
    return out.select("configId", F.date_format("day", "yyyy-MM-dd").alias("day"), "runs", "succeeded", "items", F.round("mean_seconds", 3).alias("mean_seconds"))


@query("""
WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS seen, count(*) FILTER (event_type = 'purchase') AS saved FROM events GROUP BY 1)
SELECT day, seen, saved, (sum(seen) OVER (ORDER BY day))::BIGINT AS total_seen, (sum(saved) OVER (ORDER BY day))::BIGINT AS total_saved FROM d""")
def q_daily_progress(spark, folder):
    rows = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return G.running_totals(rows, "day", {"seen": F.lit(True), "saved": F.col("event_type") == "purchase"})


def _recipes(spark, folder):
    hour = F.concat(F.lpad(_s("c_nationkey"), 2, "0"), F.lit(":00"))
    size = F.concat(F.lpad(F.length("c_mktsegment").cast("string"), 2, "0"), F.lit(":00"))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("enabled"), F.array(hour, size).alias("scheduleTime")
    )


_TIMES = "[lpad(c_nationkey::VARCHAR, 2, '0') || ':00', lpad(length(c_mktsegment)::VARCHAR, 2, '0') || ':00']"


@query(f"SELECT c_custkey AS id FROM customer WHERE c_acctbal > 0 AND list_contains({_TIMES}, '09:00')")
def q_due_recipes(spark, folder):
    return J.due_recipes(_recipes(spark, folder), "09:00").select("id")


@query(f"SELECT time, count(*) AS n FROM (SELECT unnest(list_distinct({_TIMES})) AS time FROM customer WHERE c_acctbal > 0) GROUP BY time")
def q_schedule_rollup(spark, folder):
    return G.schedule_rollup(_recipes(spark, folder))


# ---- numbering, pages, slices -----------------------------------------------

@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS rn FROM orders)
SELECT (rn // 900)::BIGINT AS batch_id, count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, sum(o_orderkey * (rn % 900 + 1))::BIGINT AS weighted FROM n GROUP BY 1""")
def q_batches(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    out = B.with_batches(rows, ["o_orderdate", "o_orderkey"], 900)
    return out.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"),
        F.sum(F.col("o_orderkey") * F.col("i")).alias("weighted"),
    )


@query("""
SELECT o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS position FROM orders""")
def q_position_within(spark, folder):
    """Three groups hold all rows: each is numbered by many tasks."""
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey")
    return B.with_position(rows, ["o_orderdate", "o_orderkey"], ["o_orderstatus"]).select("o_orderkey", "position")


@query("""
SELECT c_custkey, (SELECT count(*) FROM customer WHERE contains(lower(c_name), '#00000000')) AS total FROM customer
WHERE contains(lower(c_name), '#00000000') ORDER BY c_acctbal DESC, c_custkey LIMIT 4 OFFSET 4""")
def q_search_page(spark, folder):
    found = L.search(table(spark, folder, "customer"), "c_name", "#00000000")
    return L.newest_page(found, [F.desc("c_acctbal"), F.col("c_custkey")], page=2, size=4).select("c_custkey", "total")


@query("""
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') ORDER BY 1 LIMIT 50""")
def q_first_n(spark, folder):
    return L.first_rows(q_new_only(spark, folder), ["o_orderkey"], 50)


@query(r"""
SELECT doc_id, array_to_string([w for w in string_split_regex(text, '\s+') if w <> ''][:5], ' ') AS head, left(text, 200) AS cut,
    CASE WHEN n_chars % 120 < 15 OR n_chars % 120 = 15 THEN 10 WHEN n_chars % 120 <= 35 THEN 20 WHEN n_chars % 120 < 75 THEN 50 ELSE 100 END::BIGINT AS page_size FROM documents""")
def q_slice(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        F.array_join(F.slice(X.cleaned(F.split("text", r"\s+", -1)), 1, 5), " ").alias("head"),
        X.first_characters("text", 200).alias("cut"),
        A.nearest_allowed(F.col("n_chars") % 120).alias("page_size"),
    )


# ---- export and load --------------------------------------------------------

@query("""
SELECT o_orderkey, o_custkey AS origin_id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderdate >= TIMESTAMP '2000-01-01 00:00:00' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_since_export(spark, folder):
    origins = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("origin_id"))
    metas = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("origin_id"), F.col("o_orderdate").alias("modified_at"))
    got = export.modified_since(export.known_origins(metas, origins), "2000-01-01")
    return got.select("o_orderkey", "origin_id", F.date_format("modified_at", "yyyy-MM-dd").alias("day"))


@query("""
SELECT doc_id AS "originId", split_part(text, chr(10), 1) AS title, '' AS writer,
    CASE WHEN n_chars % 3 = 0 THEN '2025-06-13 15:30:00' WHEN n_chars % 3 = 1 THEN '2025-06-03 00:00:00' ELSE '1970-01-01 00:00:00' END AS "regDt",
    n_chars % 3 <> 2 AS "regDtParsed", CASE WHEN lang = 'en' THEN 'Y' ELSE 'N' END AS "trslYn",
    (1 + (n_chars % 2))::BIGINT AS files, (2 - n_chars % 2)::BIGINT AS "skippedFiles" FROM documents""")
def q_export_project(spark, folder):
    k = F.col("n_chars") % 3
    file = lambda name, path: F.struct(F.lit(name).alias("originalName"), F.lit(None).cast("string").alias("url"), path.alias("s3Path"), F.lit("file").alias("file_ty"))
    metas = table(spark, folder, "documents").select(
        F.col("doc_id").alias("origin_id"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("writer"),
        F.when(k == 0, " 2025.06.13 15:30 ").when(k == 1, "2025년 6월 3일").otherwise("어제").alias("writedate"),
        F.col("source").alias("currentUrl"), F.when(F.col("lang") == "en", "T").otherwise(" ").alias("title_en"), F.lit("").alias("content_text_en"),
        F.array(
            F.struct(F.lit("u").alias("url"), F.lit("").alias("caption"), F.lit("s3://b/x.do").alias("s3Path")),
            F.struct(F.lit("u").alias("url"), F.lit("").alias("caption"), F.when(F.col("n_chars") % 2 == 1, "s3://b/y.png").otherwise("s3://b/y.exe").alias("s3Path")),
        ).alias("img"),
        F.array(file("a.pdf", F.lit("s3://b/a.pdf")), file("none", F.lit(None).cast("string"))).alias("file"),
        F.timestamp_seconds(F.lit(0)).alias("modified_at"),
    )
    out = export.export_articles(metas)
    return out.select("originId", "title", "writer", "regDt", "regDtParsed", "trslYn", F.size("files").cast("long").alias("files"), F.col("skippedFiles").cast("long").alias("skippedFiles"))


@query("""
SELECT p_partkey AS "originId", 'P:' || p_partkey AS "dedupKey", CASE WHEN p_type = 'ECONOMY' THEN 'PAPERS' ELSE p_type END AS "menuId",
    CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size::VARCHAR END AS "publishYear", '' AS author, CASE WHEN p_brand LIKE '%1' THEN 'Y' ELSE 'N' END AS "trslYn",
    'X' AS "hasFile", 'Y' AS "useYn", 'admin' AS "rgtrId" FROM part""")
def q_export_archives(spark, folder):
    none = F.lit(None).cast("string")
    given = {
        "source": F.lit("part"), "registerNo": F.concat(F.lit("P:"), _s("p_partkey")),
        "menuId": F.when(F.col("p_type") != "ECONOMY", F.col("p_type")), "title": F.col("p_name"),
        "publishYear": F.when(F.col("p_size") % 2 == 0, "").otherwise(_s("p_size")),
        "titleEn": F.when(F.col("p_brand").like("%1"), "x").otherwise("  "),
    }
    rest = (
        "publisher publisherEn author authorEn category categoryEn subCategory subCategoryEn summary summaryEn linkUrl remark isbn coverUrl".split()
    )
    metas = table(spark, folder, "part").select(
        F.col("p_partkey").alias("origin_id"), *[v.alias(k) for k, v in given.items()], *[none.alias(c) for c in rest], F.timestamp_seconds(F.lit(0)).alias("modified_at")
    )
    return export.export_archives(metas).select("originId", "dedupKey", "menuId", "publishYear", "author", "trslYn", "hasFile", "useYn", "rgtrId")


def _order_metas(spark, folder):
    """Orders as article metas of their customer: equal priority, status and day repeat."""
    picture = F.struct(F.lit("u").alias("url"), F.lit("").alias("caption"), F.concat(F.lit("s3://b/"), _s("o_orderkey"), F.lit(".jpg")).alias("s3Path"))
    document = lambda ext: F.struct(
        F.lit("d").alias("originalName"), F.lit("v").alias("url"), F.concat(F.lit("s3://b/"), _s("o_orderkey"), F.lit(ext)).alias("s3Path"), F.lit("file").alias("file_ty")
    )
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("origin_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("title"),
        F.lit("c").alias("content"), F.col("o_orderstatus").alias("writer"),
        F.date_format("o_orderdate", "yyyy.MM.dd 10:30").alias("writedate"), F.lit("l").alias("currentUrl"),
        F.lit("").alias("title_en"), F.lit("").alias("content_text_en"),
        F.when(F.col("o_orderstatus") == "F", F.array(picture)).alias("img"),
        F.array(document(".pdf"), document(".do")).alias("file"),
    )


def _news_table(spark, folder):
    """Returned lines as the articles already loaded."""
    return table(spark, folder, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("news_id"), (F.col("l_suppkey") % 50).alias("origin_id"),
        F.when(F.col("l_linestatus") == "F", "1-URGENT").alias("title"), F.col("l_shipdate").alias("reg_dt"),
    )


_LOAD_SQL = """
WITH m AS (SELECT o_orderkey AS seq, o_custkey % 50 AS origin_id, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS title,
    o_orderstatus AS writer, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderstatus FROM orders),
known AS (SELECT DISTINCT l_suppkey % 50 AS origin_id, '1-URGENT' AS title, strftime(l_shipdate, '%Y-%m-%d') AS day FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'),
r AS (SELECT m.*, row_number() OVER (PARTITION BY origin_id, coalesce(title, ''), writer, day ORDER BY seq) AS rn,
    EXISTS (SELECT 1 FROM known k WHERE k.origin_id = m.origin_id AND k.title = m.title AND k.day = m.day) AS stored FROM m),
s AS (SELECT *, CASE WHEN rn > 1 THEN 'batch_duplicate' WHEN stored THEN 'table_duplicate' ELSE 'inserted' END AS status FROM r)
"""


@query(_LOAD_SQL + """
SELECT seq, status FROM s""")
def q_load_status(spark, folder):
    return load.judged_loads(_order_metas(spark, folder), _news_table(spark, folder)).select("seq", "status")


@query(_LOAD_SQL + """
SELECT count(*) AS total_meta, count(*) FILTER (status = 'inserted') AS inserted, count(*) FILTER (status <> 'inserted') AS skipped_duplicate,
    sum(CASE WHEN status = 'inserted' THEN CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS file_inserted,
    count(*) FILTER (status = 'inserted') AS file_skipped FROM s""")
def q_load_counters(spark, folder):
    return load.load_counters(load.judged_loads(_order_metas(spark, folder), _news_table(spark, folder)))


def _loaded(spark, folder):
    judged = load.judged_loads(_order_metas(spark, folder), _news_table(spark, folder))
    origin = table(spark, folder, "nation").where("n_name <> 'NATION_3'").select(
        F.col("n_nationkey").cast("long").alias("origin_id"), F.col("n_name").alias("origin_nm"), F.col("n_name").alias("origin_nm_en"), F.col("n_regionkey").alias("category_code")
    )
    category = table(spark, folder, "region").where("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("category_code"), F.col("r_name").alias("category_nm"), F.col("r_name").alias("category_nm_en")
    )
    return load.news_rows(judged, origin, category, _news_table(spark, folder), "2026-01-01 00:00:00")


_ROWS_SQL = _LOAD_SQL + """,
n AS (SELECT s.*, n_name, r_name, n_regionkey, (SELECT max(l_orderkey) FROM lineitem WHERE l_returnflag = 'R') + row_number() OVER (ORDER BY seq) AS news_id
    FROM s JOIN nation ON origin_id = n_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') ON n_regionkey = r_regionkey
    WHERE status = 'inserted' AND n_name <> 'NATION_3')
"""


@query(_ROWS_SQL + """
SELECT news_id::BIGINT AS news_id, title, n_name AS origin_nm, r_name AS category_nm, n_regionkey AS category_id, day || ' 00:00:00' AS reg_dt, 'N' AS trsl_yn FROM n""")
def q_load_articles(spark, folder):
    rows, _ = _loaded(spark, folder)
    return rows.select("news_id", "title", "origin_nm", "category_nm", "category_id", F.date_format("reg_dt", "yyyy-MM-dd HH:mm:ss").alias("reg_dt"), "trsl_yn")


@query(_ROWS_SQL + """,
f AS (SELECT news_id, 0 AS list_no, seq || '.jpg' AS name, 'image' AS ty FROM n WHERE o_orderstatus = 'F' UNION ALL SELECT news_id, 1, seq || '.pdf', 'file' FROM n)
SELECT row_number() OVER (ORDER BY news_id, list_no) + 7 AS file_id, news_id::BIGINT AS news_id, '/' || name AS file_path, ty AS file_ty, 0 AS sort_order FROM f""")
def q_load_files(spark, folder):
    rows, _ = _loaded(spark, folder)
    existing = table(spark, folder, "region").select((F.col("r_regionkey") + 3).cast("long").alias("file_id"))
    return load.news_file_rows(rows, existing, "2026-01-01 00:00:00").select("file_id", "news_id", "file_path", "file_ty", "sort_order")


@query(_LOAD_SQL + """
SELECT seq, origin_id FROM s WHERE status = 'inserted' AND (origin_id NOT IN (SELECT n_nationkey FROM nation) OR origin_id = 3)""")
def q_load_unknown_origin(spark, folder):
    _, missing = _loaded(spark, folder)
    return missing.select("seq", "origin_id")
