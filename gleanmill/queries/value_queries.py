"""Small value, listing and report operators, each on whole given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import text as X
from gleanmill.functions import urls as N
from gleanmill.functions import values as A
from gleanmill.operators import numbering as B
from gleanmill.operators import rollups as G
from gleanmill.plans import export as E
from gleanmill.plans import ingest as I
from gleanmill.queries.record_queries import _part_metas, _s
from gleanmill.queries.registry import query
from gleanmill.queries.store_queries import PARTS, fresh_folder
from gleanmill.rules import vocabulary as V
from gleanmill.rules.cascades import link_allowed
from gleanmill.session import table
from gleanmill.sinks import tables as K
from gleanmill.sources import bibliography as P
from gleanmill.sources import stored as S

# ---- values -----------------------------------------------------------------


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name,
    CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '-' WHEN 2 THEN '0' ELSE p_size::VARCHAR END AS vol,
    CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN '-' ELSE (p_partkey % 12)::VARCHAR END AS no FROM part)
SELECT p_partkey, CASE WHEN name <> '' THEN name || CASE WHEN vol IN ('', '0') THEN '' ELSE ' ' || vol || CASE WHEN no IN ('', '0') THEN '' ELSE '(' || no || ')' END END END AS label,
    CASE WHEN name <> '' THEN name || CASE WHEN vol = '' THEN '' ELSE ' ' || vol || CASE WHEN no = '' THEN '' ELSE '(' || no || ')' END END END AS plain FROM p""")
def q_volume_label(spark, folder):
    """Part names as journals; volumes and issues that are missing, dashes or zero."""
    n = F.col("p_partkey")
    name = F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.col("p_name")))
    vol = F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, "-").when(n % 4 == 2, "0").otherwise(_s("p_size"))
    no = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "0").when(n % 5 == 2, "-").otherwise((n % 12).cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey", X.volume_label(name, vol, no, absent=("0",)).alias("label"), X.volume_label(name, vol, no).alias("plain")
    )


@query(r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS path FROM pages),
q AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '.do?boardId=f' || page_id ELSE path END AS rest FROM p)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '/board/board' || rest ELSE rest END AS path FROM q""")
def q_session_path(spark, folder):
    """Paths of the pages, a third of them with a session, a fifth a board that lost its folder."""
    path = F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)
    board = F.concat(F.lit("/board.do?boardId=f"), _s("page_id"))
    bare = F.when(F.col("page_id") % 5 == 0, board).otherwise(path)
    sent = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/;jsessionid=A"), _s("page_id"), F.lit(".n1"), bare)).otherwise(bare)
    return table(spark, folder, "pages").select("page_id", N.session_path_strip(sent).alias("path"))


@query("""
SELECT page_id, (regexp_extract(url, '^https?://([^/:]+)', 1) <> 'm.ththth.example.net' OR contains(url, '/en/') OR contains(url, '/de/')) AND NOT contains(url, '/825') AS allowed FROM pages""")
def q_link_allowed(spark, folder):
    allowed = link_allowed("url", N.host_of("url"), "m.ththth.example.net", ("/en/", "/de/"), skip="/825")
    return table(spark, folder, "pages").select("page_id", allowed.alias("allowed"))


@query("""
WITH d AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS own FROM documents)
SELECT doc_id, CASE WHEN lang = 'en' THEN CASE WHEN coalesce(own, '') <> '' THEN own ELSE 'en ' || doc_id END ELSE 'en ' || doc_id END AS english,
    CASE WHEN lang = 'en' THEN '' WHEN coalesce(own, '') <> '' AND lang = 'fr' THEN own ELSE '' END AS french,
    'last ' || doc_id AS title, CASE WHEN doc_id % 4 = 0 THEN '' ELSE lang END AS lang_code, '' AS none FROM d""")
def q_lang_codes(spark, folder):
    """Entries by language, the first that is not blank, and coded items, the last of a code."""
    entry = lambda value, lang: F.struct(value.alias("_VALUE"), lang.alias("_lang"))
    item = lambda value, code: F.struct(value.alias("_VALUE"), F.lit(code).alias("_metaCode"))
    n = F.col("doc_id")
    own = F.when(n % 3 == 0, F.lit(" ")).otherwise(F.col("source"))
    entries = F.array(entry(own, F.col("lang")), entry(F.concat(F.lit("en "), _s("doc_id")), F.lit("en")), entry(F.lit("later"), F.lit("en")))
    items = F.array(
        item(F.lit("first"), "TI"), item(F.concat(F.lit(" <b>last "), _s("doc_id"), F.lit("</b>")), "TI"),
        item(F.when(n % 4 == 0, F.lit("  ")).otherwise(F.col("lang")), "LA"),
    )
    return table(spark, folder, "documents").select(entries.alias("e"), items.alias("i"), "doc_id").select(
        "doc_id", A.pick_by_lang("e", "en").alias("english"), A.pick_by_lang("e", "fr").alias("french"),
        A.coded("i", "TI").alias("title"), A.coded("i", "LA").alias("lang_code"), A.coded("i", "XX").alias("none"),
    )


@query("""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS step, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'late' ELSE json_extract_string(props, '$.k') END AS k,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE 2 + (event_id % 2 <> 0)::INT * 0 END::INT AS n FROM events""")
def q_config_reply(spark, folder):
    """Properties of the events as the first reply, their types as the second; some second replies are damaged."""
    second = F.to_json(F.struct(F.col("event_type").alias("step"), F.when(F.col("event_id") % 2 == 0, "late").alias("k")))
    broken = F.when(F.col("event_id") % 7 == 0, F.expr("left(s, length(s) - 1)")).otherwise(F.col("s"))
    merged = A.config_reply("props", "t")
    rows = table(spark, folder, "events").select("event_id", "props", second.alias("s")).select("event_id", "props", broken.alias("t")).select("event_id", merged.alias("m"))
    return rows.select("event_id", F.col("m")["step"].alias("step"), F.col("m")["k"].alias("k"), F.when(F.col("m").isNotNull(), F.size("m")).alias("n"))


@query("""
SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS wanted FROM part""")
def q_needs_detail(spark, folder):
    """Parts as list rows of an encyclopedia; summary, author, field or year may be missing or blank."""
    n = F.col("p_partkey")
    row = F.to_json(F.struct(
        F.when(n % 2 != 0, F.col("p_name")).alias("summary"), F.when(n % 3 != 0, F.col("p_brand")).otherwise("  ").alias("Writer_Name"),
        F.struct(F.when(n % 5 != 0, F.col("p_type")).alias("name")).alias("field"), F.when(n % 7 != 0, (1990 + F.col("p_size") % 30).cast("string")).alias("pubYear"),
    ))
    entries = table(spark, folder, "part").select("p_partkey", A.text_entries(A.json_entries(row)).alias("e"))
    return entries.select("p_partkey", P.needs_detail(F.col("e")).alias("wanted"))


# ---- stored records ---------------------------------------------------------

_LABELS = "CASE s " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.SOURCE_LABELS.items()) + " END"
_SOURCES = tuple(V.SOURCE_LABELS) + ("else",)


@query(f"""
WITH p AS (SELECT *, {list(_SOURCES)}[p_partkey % {len(_SOURCES)} + 1] AS s FROM part)
SELECT p_partkey AS seq, upper(s) || ':' || p_partkey AS register_no, {_LABELS} AS remark, CASE WHEN p_size % 3 = 0 THEN '{V.THEME_FALLBACK}' ELSE p_type END AS category,
    NULL::VARCHAR AS category_en, left(replace(p_name, ' ', '_'), 40) AS title_suffix, p_brand AS publisher, '2026-01-01' AS collected_at FROM p""")
def q_archive_record(spark, folder):
    """Parts as classified records of six known sources and an unknown one."""
    source = F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % len(_SOURCES) + 1).cast("int"))
    nothing = F.lit(None).cast("string")
    classified = table(spark, folder, "part").select(
        source.alias("source"), _s("p_partkey").alias("source_id"), F.lit("PAPERS").alias("menu_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
        F.when(F.col("p_size") % 3 != 0, F.col("p_type")).alias("theme"), F.concat(F.upper(source), F.lit(":"), _s("p_partkey")).alias("register_no"),
        F.array("p_type").alias("matched_keywords"), F.struct(F.lit("GOV").alias("verdict"), F.lit("dict").alias("by")).alias("classification"), F.col("p_partkey").alias("seq"),
        *[nothing.alias(c) for c in ("title_en", "publisher_en", "author", "author_en", "publish_year", "sub_category", "summary", "summary_en", "detail_url", "isbn", "cover_url", "item_hash")],
    )
    return I.archive_metas(classified, "2026-01-01").select("seq", "register_no", "remark", "category", "category_en", "title_suffix", "publisher", "collected_at")


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' WHEN page_id % 3 = 0 THEN '/b' || page_id ELSE '/a' || page_id || ',/b' || page_id END AS images,
    CASE WHEN page_id % 2 = 0 THEN '' ELSE '/f' || page_id END AS files, url AS title FROM pages""")
def q_file_listing(spark, folder):
    """Pages as metas whose picture and file lists are missing, or hold entries without a path."""
    n, path = F.col("page_id"), lambda p: F.concat(F.lit(p), _s("page_id"))
    one = lambda p: F.struct(F.col("url").alias("url"), p.alias("s3Path"))
    img = F.when(n % 4 != 0, F.array(one(F.when(n % 3 != 0, path("/a"))), one(path("/b")), one(F.lit(None).cast("string"))))
    file = F.array(one(F.when(n % 2 == 0, F.lit("")).otherwise(path("/f"))))
    metas = table(spark, folder, "pages").select("page_id", F.col("url").alias("title"), img.alias("img"), file.alias("file"))
    return E.file_listing(metas).select("page_id", "title", F.array_join("images", ",").alias("images"), F.array_join("files", ",").alias("files"))


@query("""
SELECT event_id AS id, user_id % 8 AS configId, strftime(ts, '%Y-%m-%d') AS date, json_extract_string(props, '$.k')::BIGINT AS itemCount, event_type <> 'error' AS success,
    CASE WHEN event_type = 'error' THEN 'line' || chr(10) || '{' || event_id || '}' END AS message FROM events""")
def q_run_log_files(spark, folder):
    """Events written as run logs, a folder per day and configuration, and read back."""
    root = fresh_folder(spark, "runs")
    logs = table(spark, folder, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 8).alias("configId"), F.col("ts").cast("timestamp").alias("startedAt"), F.get_json_object("props", "$.k").cast("long").alias("itemCount"),
        (F.col("event_type") != "error").alias("success"), F.when(F.col("event_type") == "error", F.concat(F.lit("line\n{"), _s("event_id"), F.lit("}"))).alias("message"),
    )
    K.write_run_logs(logs.repartition("configId", F.to_date("startedAt")), f"{root}/log")
    return S.readable(S.run_logs(spark, root)).select("id", "configId", "date", "itemCount", "success", "message")


# ---- list pages, at once and as they come -----------------------------------

ROWS = 20


@query(f"""
WITH p AS (SELECT *, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) AS spot, count(*) OVER (PARTITION BY p_brand) AS total FROM part)
SELECT via, p_brand AS crawl, spot // {ROWS} AS page, CASE WHEN p_brand = 'Brand#2' THEN 0 ELSE total // {ROWS} END AS total_pages, (spot % {ROWS})::INT AS pos,
    p_name AS title, p_partkey::VARCHAR AS id, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE '' END AS size FROM p, (SELECT unnest(['folder', 'stream']) AS via)""")
def q_list_pages(spark, folder):
    """JSON list pages of the parts, read as a folder and as a stream by one scan; the recipe names paths and fields."""
    root, out = fresh_folder(spark, "lists"), fresh_folder(spark, "rows")
    numbered = B.with_position(table(spark, folder, "part"), ["p_partkey"], ["p_brand"], "at").withColumn("page", F.floor(F.col("at") / ROWS))
    row = F.struct(F.col("at").alias("place"), F.struct(F.col("p_name").alias("t"), _s("p_partkey").alias("key"), F.when(F.col("p_size") % 2 == 0, _s("p_size")).alias("s")).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"])
    totals = table(spark, folder, "part").groupBy("p_brand").agg(F.floor(F.count(F.lit(1)) / ROWS).alias("pages"))
    # a page never holds more than its rows
    listed = numbered.groupBy("p_brand", "page").agg(rows.alias("rows")).join(totals, "p_brand")
    body = F.to_json(F.struct(F.struct(F.col("rows").alias("items"), F.struct(F.col("pages").alias("last")).alias("paging")).alias("data")))
    captures = listed.select(
        F.col("p_brand").alias("crawl"), "page", F.concat(F.lit("https://list.example/"), _s("page")).alias("page_url"), body.alias("body"), F.lit("data.items").alias("list_path"),
        F.when(F.col("p_brand") == "Brand#2", "data.nothing").otherwise("data.paging.last").alias("total_path"),
    )
    captures.repartition(PARTS).write.json(root)
    fields = F.create_map(*map(F.lit, ("title", "t", "id", "key", "size", "s")))

    def read(follow):
        found = S.ajax_rows(S.list_captures(spark, root, follow, files=1)).withColumn("f", S.list_fields(F.col("fields"), fields))
        return found.select("crawl", "page", "total_pages", "pos", *[F.col("f")[c].alias(c) for c in ("title", "id", "size")])

    read(True).writeStream.option("checkpointLocation", f"{out}/checkpoint").option("path", f"{out}/rows").format("parquet").trigger(availableNow=True).start().awaitTermination()
    streamed = spark.read.parquet(f"{out}/rows").withColumn("via", F.lit("stream"))
    return read(False).withColumn("via", F.lit("folder")).unionByName(streamed)


# ---- report -----------------------------------------------------------------


@query(f"""
WITH p AS (SELECT *, CASE WHEN p_type = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END AS menu FROM part),
t AS (SELECT count(*) AS n, count(*) FILTER (menu = 'PAPERS') AS papers, count(*) FILTER (menu = 'BOOKS') AS books, repeat('=', 100) AS bar, repeat('-', 100) AS dash FROM p),
b AS (SELECT p_brand, count(*) AS n, min(p_partkey) AS first_seq, arg_min(p_type, p_partkey) AS kind FROM p GROUP BY p_brand),
h AS (
  SELECT 0 AS section, unnest([bar, ' PARTS (origin 1) 아카이브 저장 현황 리포트', ' 생성: 2026-01-01 00:00:00 (KST)',
    ' 총 ' || n || '건 — 발간자료(PUBLICATIONS) 0 / 논문(PAPERS) ' || papers || ' / 단행본(BOOKS) ' || books,
    ' 분류기준: 단행본→BOOKS 고정, 발행기관 GOV(정부·지자체·국책연)→PUBLICATIONS, PRIVATE(학회·대학·민간)→PAPERS',
    ' 분류근거 표기: {", ".join(f"{k}={v}" for k, v in G.BY_LABELS.items())}', bar]) AS line, unnest(range(7)) AS rank FROM t
  UNION ALL SELECT 1, unnest(['', '■ 발행기관별 분류 요약 — ' || (SELECT count(*) FROM b) || '개 기관 (건수 내림차순)', dash]), unnest(range(3)) FROM t
  UNION ALL SELECT 3, unnest(['', '■ PUBLICATIONS ({V.MENU_LABELS["PUBLICATIONS"]}) — 0건', dash, '(없음)']), unnest(range(4)) FROM t
  UNION ALL SELECT 5, unnest(['', '■ PAPERS ({V.MENU_LABELS["PAPERS"]}) — ' || papers || '건', dash]), unnest(range(3)) FROM t
  UNION ALL SELECT 7, unnest(['', '■ BOOKS ({V.MENU_LABELS["BOOKS"]}) — ' || books || '건', dash]), unnest(range(3)) FROM t
  UNION ALL SELECT 9, unnest(['', bar, ' 끝 — 총 ' || n || '건', bar]), unnest(range(4)) FROM t)
SELECT section::INT AS section, rank, line FROM h
UNION ALL SELECT 2, row_number() OVER (ORDER BY n DESC, first_seq) - 1, lpad(n::VARCHAR, 5, ' ') || '건 | ' || rpad(CASE WHEN kind = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END, 12, ' ') || ' | '
    || CASE WHEN length(kind) < 7 THEN rpad(kind, 7, ' ') ELSE kind END || '/' || rpad('패턴', 10, ' ') || ' | ' || p_brand FROM b
UNION ALL SELECT CASE menu WHEN 'PAPERS' THEN 6 ELSE 8 END, 0, '[P:' || p_partkey || '] ' || p_size || ' | ' || p_brand || ' → ' || p_type || '(패턴) | "' || p_name || '" | 키워드: ' || p_type FROM p""")
def q_report_text(spark, folder):
    """Every line of the status report, headings included."""
    return G.report_lines(_part_metas(spark, folder), "parts", 1, "2026-01-01 00:00:00")


@query("""
SELECT row_number() OVER (ORDER BY p_brand, p_size::VARCHAR DESC, p_name) - 1 AS place, p_brand AS publisher, p_size::VARCHAR AS publish_year, p_name AS title FROM part""")
def q_report_order(spark, folder):
    """Place of every record in the report's order; records that tie share all that is returned."""
    ordered = G.report_order(_part_metas(spark, folder)).withColumn("_n", F.monotonically_increasing_id())
    return B.with_position(ordered, ["_n"], name="place").select("place", "publisher", "publish_year", "title")
