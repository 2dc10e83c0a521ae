import json
import os

import pytest
from pyspark.sql import functions as F

from gleanmill.operators import dedupe as U
from gleanmill.operators import joins as J
from gleanmill.operators import numbering as B
from gleanmill.operators import paging as L
from gleanmill.operators import rollups as G
from gleanmill.operators import verdicts as R
from gleanmill.plans import collect, export, ingest, load, reclassify
from gleanmill.rules import vocabulary as V
from gleanmill.schemas import BIB_SCHEMA, VERDICT
from gleanmill.sinks import tables as K
from gleanmill.sources import news as N
from gleanmill.sources import stored as T
from gleanmill.streaming import feed
from tests.test_sources import RSS, archive, write  # noqa: F401

REPLY = "classifier string, key string, reply_text string"
ARTICLE = "guid string, title string, link string, reg_dt string, writer string, content string, img_urls array<string>, matched_keywords array<string>, seq long"


def nothing(spark, schema):
    return spark.createDataFrame([], schema)


def article(n, guid, title, content="", words=("DMZ",)):
    return (guid, title, f"https://n.example/{n}", "2026-01-01 00:00:00", "", content, [f"https://i.example/{n}.jpg"], list(words), n)


def test_collect(spark):
    rows = spark.createDataFrame([
        article(1, "G1", "DMZ 평화의 길"),
        article(2, "G1", "DMZ 평화의 길 (종합)"),
        article(3, "", "스페인 접경 난민"),
        article(4, "G4", "접경 소식", words=()),
        article(5, "G5", "저장된 DMZ"),
        article(6, "G6", "스페인 접경 교훈"),
        article(7, "G7", "재판 선고", "군사분계선 이야기"),
        article(8, "G8", "파주 접경 사고"),
        article(9, "G9", "우크라 접경"),
    ], ARTICLE)
    stored = spark.createDataFrame([("G5",)], "identity string")
    store = spark.createDataFrame([("news", "G8", "false", "llm", "cached", None)], VERDICT)
    replies = spark.createDataFrame([
        ("news", "G1", '{"relevant": true, "reason": "길"}'), ("news", "G6", '{"relevant": "true", "reason": "교훈"}'),
        ("news", "https://n.example/3", '{"relevant": false}'), ("news", "G9", "no json"),
    ], REPLY)
    judged = collect.judged_articles(rows, stored, store, replies)
    got = {r.seq: (r.status, r.verdict and r.verdict.by, r.verdict and r.verdict.rule_by) for r in judged.collect()}
    assert got[1] == ("saved", "llm-keep", "anchor-keep")
    assert got[2][0] == "duplicate" and got[4][0] == "no_keyword" and got[5][0] == "existing"
    assert got[3] == ("irrelevant", "llm-drop", "rule-drop")
    assert got[6] == ("saved", "llm-keep", "rule-drop")
    assert got[7] == ("irrelevant", "trial-drop", "trial-drop")
    assert got[8] == ("irrelevant", "llm-cache", "anchor-keep")
    assert got[9] == ("irrelevant", "rule-drop", "rule-drop")
    summary = collect.collect_summary(judged).first()
    assert (summary.total_items, summary.keyword_matched, summary.skipped_duplicate, summary.saved, summary.skipped_irrelevant) == (9, 8, 2, 2, 4)
    assert (summary.llm_checked, summary.llm_dropped, summary.trial_dropped, summary.roundup_dropped) == (4, 1, 1, 0)
    counts = collect.preview_counts(judged).first()
    assert counts.llm_drop == 1
    metas = collect.article_metas(judged, 25, spark.createDataFrame([("G1", "title", "DMZ road"), ("G1", "content", " ")], "identity string, field string, text string"))
    by_id = {r.identity: r for r in metas.collect()}
    assert set(by_id) == {"G1", "G6"} and by_id["G1"].title_en == "DMZ road" and by_id["G6"].title_en == "" and by_id["G1"].img[0].url == "https://i.example/1.jpg"
    # only replies that could be read are stored for the next run
    new = R.new_verdicts(judged.where("verdict is not null"), "news", F.col("verdict_key"), "verdict", "relevant", F.current_timestamp())
    assert {r.key for r in new.collect()} == {"G1", "G6", "https://n.example/3"}
    prompts = {r.key: r.prompt for r in R.news_prompts(judged.where("status in ('saved', 'irrelevant')"), "지시").collect()}
    assert set(prompts) == {"G9"} and "제목: 우크라 접경" in prompts["G9"] and "매칭 키워드: DMZ" in prompts["G9"]


def test_collect_switches(spark):
    rows = spark.createDataFrame([article(1, "G1", "스페인 접경"), article(2, "G2", "DMZ"), article(3, "G3", "오늘", words=())], ARTICLE)
    empty, none = nothing(spark, VERDICT), nothing(spark, REPLY)
    by = lambda **kw: {r.seq: (r.status, r.verdict.by) for r in collect.judged_articles(rows, None, empty, none, **kw).where("seq < 3").collect()}
    assert by(enabled=False) == {1: ("irrelevant", "rule-drop"), 2: ("saved", "anchor-keep")}
    assert by(provider=False) == {1: ("irrelevant", "rule-drop"), 2: ("saved", "llm-off")}
    assert by() == {1: ("irrelevant", "rule-drop"), 2: ("saved", "llm-error-keep")}
    ungated = collect.judged_articles(rows, None, empty, none, keyword_gate=False, check_topic=False)
    assert {r.seq: r.status for r in ungated.collect()} == {1: "saved", 2: "saved", 3: "saved"}


def test_backfill(spark, archive):  # noqa: F811
    scanned = N.scan_news_xml(spark, archive)
    judged = collect.judged_articles(
        N.articles_from_xml(scanned), None, nothing(spark, VERDICT), nothing(spark, REPLY), keyword_gate=False, check_topic=False
    )
    assert sorted((r.seq.file, r.status) for r in judged.collect()) == [
        ("AKR20260305000100.xml", "saved"), ("AKR20260305000200.XML", "saved"), ("AKR20260401000100.xml", "duplicate"),
    ]
    s = collect.backfill_summary(scanned, N.news_xml_errors(scanned), judged).first()
    assert (s.parsed, s.keyword_matched, s.skipped_duplicate, s.saved) == (3, 3, 1, 2) and s.parse_errors >= 1


def bib(n, **over):
    base = dict(source="losi", source_id=f"S{n}", title="접경 연구", publisher="한국조경학회", author="가", publish_year="2020", category=None,
                sub_category="환경학회지", summary=None, detail_url="u", isbn=None, material_type="article", matched_keyword="DMZ",
                title_en=None, summary_en=None, author_en=None, seq=(0, 1, n))
    return tuple({**base, **over}.values())


def test_ingest(spark):
    items = spark.createDataFrame([
        bib(1), bib(2, source_id="S1", matched_keyword="MDL"), bib(3, source_id="S1"),
        bib(4, title="압록강 연구"), bib(5, publisher="경향신문사", title="DMZ 비무장지대"), bib(6, publisher=" (재) ", title="판문점"),
        bib(7, publisher="통일연구원", title="판문점", material_type="book", isbn="1234567890"),
        bib(8, publisher="모르는기관", title="군사분계선", material_type="book", isbn="1234567890", title_en="Line"),
        bib(9, source_id="OLD", title="판문점"), bib(10, title="애매한 제목", sub_category="주간", publisher="다라모임"),
    ], BIB_SCHEMA)
    stored = spark.createDataFrame([("LOSI:OLD",)], "register_no string")
    store = spark.createDataFrame([("topic", "접경 연구|한국조경학회", "true", "llm", "ok", None)], VERDICT)
    replies = spark.createDataFrame([
        ("publisher", "모르는기관", '{"verdict": "PRIVATE", "confidence": 0.9}'), ("academic", "애매한 제목|다라모임", '{"academic": false}'),
    ], REPLY)
    judged = ingest.judged_items(items, stored, store, replies)
    status = {r.source_id: r.status for r in judged.collect()}
    assert status == {"S1": "saved", "S4": "irrelevant", "S5": "non_academic", "S6": "unclassifiable", "S7": "saved", "S8": "saved", "OLD": "existing", "S10": "non_academic"}
    themes = spark.createDataFrame([(0, '[{"i": 1, "theme": "DMZ 관광"}, {"i": 2, "theme": "없는 주제"}, {"i": 99, "theme": "기타"}]')], "batch_id long, reply_text string")
    covers = spark.createDataFrame([("1234567890", " https://c ")], "isbn string, cover_url string")
    translations = spark.createDataFrame([("LOSI:S1", "title", "Border study"), ("LOSI:S8", "title", "ignored")], "register_no string, field string, text string")
    classified = ingest.classified_items(judged, store, replies, themes, covers, translations)
    metas = {r.source_id: r for r in ingest.archive_metas(classified, "2026-01-01 00:00:00").collect()}
    one, seven, eight = metas["S1"], metas["S7"], metas["S8"]
    assert (one.menu_id, one.matched_keywords, one.category, one.title_en, one.register_no) == ("PAPERS", ["DMZ", "MDL"], "DMZ 관광", "Border study", "LOSI:S1")
    assert (seven.menu_id, seven.cover_url, seven.category, seven.classification.by) == ("PUBLICATIONS", None, V.THEME_FALLBACK, "dict")
    assert (eight.menu_id, eight.cover_url, eight.title_en, eight.classification.by, eight.category) == ("BOOKS", "https://c", "Line", "llm", V.THEME_FALLBACK)
    assert one.remark == V.SOURCE_LABELS["losi"] and one.title_suffix == "접경_연구" and len(one.item_hash) == 8
    s = ingest.ingest_summary(items, judged, classified).first()
    assert (s.fetched, s.deduped, s.skipped_existing, s.dropped_irrelevant, s.dropped_non_academic, s.dropped_unclassifiable, s.saved) == (10, 8, 1, 1, 2, 1, 3)
    assert (s.publications, s.papers, s.books, s.translated, s.cover_fetched) == (1, 1, 1, 2, 1)
    rows = spark.createDataFrame([("모르는기관",), ("새기관",), ("통일연구원",)], "publisher string").withColumn("rule", ingest.institution_rule("publisher"))
    asked = R.publisher_prompts(rows, "rule", spark.createDataFrame([("publisher", "모르는기관", "GOV", "llm", "", None)], VERDICT), "판정")
    assert [r.key for r in asked.collect()] == ["새기관"]
    open_rows = judged.where("topic.by = 'llm-error-keep'")
    asked = R.bib_prompts(open_rows, "topic", "topic", "판정", {"저자": "author"}).collect()
    assert [r.key for r in asked] == ["애매한 제목|다라모임"] and "저자: 가" in asked[0].prompt


def test_reclassify_and_scripts(spark):
    metas = spark.createDataFrame([
        (3, "h1", "RISS:A1", "통일연구원", "PAPERS", None), (3, "h2", "RISS:U2", "대한건축학회", "BOOKS", "단행본"), (3, "h3", "KCI:X", "x", "PAPERS", None),
    ], "origin_id long, item_hash string, register_no string, publisher string, menu_id string, category string")
    empty, none = nothing(spark, VERDICT), nothing(spark, REPLY)
    out = reclassify.by_register(metas, empty, none)
    got = {r.register_no: (r.new_menu, r.new_category, r.new_category_en) for r in out.collect()}
    assert got == {"RISS:A1": ("PUBLICATIONS", "국내학술논문", "Domestic Academic Article"), "RISS:U2": ("BOOKS", "단행본", "Book")}
    assert [r.register_no for r in reclassify.changed(out).collect()] == ["RISS:A1"]
    themed = reclassify.by_theme(metas, spark.createDataFrame([("RISS:A1", "기타")], "register_no string, theme string"), empty, none)
    assert {r.register_no: r.new_category for r in themed.collect()} == {"RISS:A1": "기타", "RISS:U2": V.THEME_FALLBACK, "KCI:X": V.THEME_FALLBACK}
    assert [tuple(r) for r in G.move_matrix(out, "menu_id", "new_menu").collect()] == [("PAPERS", "PUBLICATIONS", 1)]
    assert "WHEN register_no LIKE 'RISS:T%' THEN '학위논문'" in G.category_case_script("archive", "x")


def test_load_twice(spark, tmp_path):
    metas = spark.createDataFrame([
        (1, 5, "제목", "2025.06.13 10:00", "w", [("u", "", "s3://b/1.jpg"), ("u", "", "s3://b/2.do"), ("u", "", None)], [("n", "v", "s3://b/3.pdf", "file")]),
        (2, 5, "제목", "2025-06-13", "w", None, None), (3, 5, "제목", "2025-06-13", "other", None, None), (4, 5, None, "bad", "w", None, None), (5, 9, "밖", "2025-06-13", "w", None, None),
    ], "seq long, origin_id long, title string, writedate string, writer string, img array<struct<url:string,caption:string,s3Path:string>>, file array<struct<originalName:string,url:string,s3Path:string,file_ty:string>>")
    metas = metas.withColumns({c: F.lit(None).cast("string") for c in ("content", "currentUrl", "title_en", "content_text_en")})
    origin = spark.createDataFrame([(5, "출처", "origin", 1)], "origin_id long, origin_nm string, origin_nm_en string, category_code int")
    category = spark.createDataFrame([(1, "분류", "cat")], "category_code int, category_nm string, category_nm_en string")
    news = spark.createDataFrame([(41, 5, "옛", "2020-01-01")], "news_id long, origin_id long, title string, d string").select("news_id", "origin_id", "title", F.to_timestamp("d").alias("reg_dt"))
    judged = load.judged_loads(metas, news)
    assert {r.seq: r.status for r in judged.collect()} == {1: "inserted", 2: "batch_duplicate", 3: "inserted", 4: "inserted", 5: "inserted"}
    rows, missing = load.news_rows(judged, origin, category, news, "now")
    got = {r.news_id: (r.title, str(r.reg_dt)[:10], r.origin_nm, r.category_nm) for r in rows.collect()}
    assert got == {42: ("제목", "2025-06-13", "출처", "분류"), 43: ("제목", "2025-06-13", "출처", "분류"), 44: (None, "1970-01-01", "출처", "분류")}
    assert [r.seq for r in missing.collect()] == [5]
    files = load.news_file_rows(rows, nothing(spark, "file_id long"), "now").orderBy("file_id").collect()
    assert [(r.file_id, r.news_id, r.file_path, r.sort_order) for r in files] == [(1, 42, "/1.jpg", 0), (2, 42, "/3.pdf", 0)]
    c = load.load_counters(judged).first()
    assert (c.total_meta, c.inserted, c.skipped_duplicate, c.file_inserted, c.file_skipped) == (5, 4, 1, 2, 1)
    path = str(tmp_path / "news")
    K.write_rows(rows.drop("img", "file"), path)
    again = load.judged_loads(metas, spark.read.parquet(path))
    # a null title never counts as already loaded
    assert {r.seq: r.status for r in again.collect()} == {1: "table_duplicate", 2: "batch_duplicate", 3: "table_duplicate", 4: "inserted", 5: "inserted"}


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "origin_id long, key string, v string")
    assert K.read_table(spark, path) is None
    assert K.insert_new(rows, path, "key", buckets=4).count() == 3
    assert K.insert_new(rows, path, "key", buckets=4).count() == 0
    K.upsert(spark.createDataFrame([(1, "a", "new"), (3, "c", "w")], rows.schema), path, "key", buckets=4)
    read = lambda: sorted((r.origin_id, r.key, r.v) for r in K.read_table(spark, path).collect())
    assert read() == [(1, "a", "new"), (1, "b", "y"), (2, "a", "z"), (3, "c", "w")]
    path2 = str(tmp_path / "t2")
    K.insert_new(rows, path2, "key")
    K.rewrite_changed(path2, spark.createDataFrame([(2, "a", "Z")], rows.schema), "key", ["v"])
    assert sorted((r.origin_id, r.key, r.v) for r in K.read_table(spark, path2).collect()) == [(1, "a", "x"), (1, "b", "y"), (2, "a", "Z")]


def test_rewrites_are_whole_or_nothing(spark, tmp_path, monkeypatch):
    path, shape = str(tmp_path / "t"), "origin_id long, key string, v string"
    frame = lambda *rows: spark.createDataFrame(rows, shape)
    read = lambda: sorted((r.origin_id, r.key, r.v) for r in K.read_table(spark, path).collect())
    K.insert_new(frame((1, "a", "x"), (1, "b", "y"), (2, "a", "z")), path, "key", buckets=2)
    before, news = read(), frame((1, "a", "new"), (2, "c", "w"))

    def dies(*_):
        raise RuntimeError("killed")

    for write in (lambda: K.upsert(news, path, "key", buckets=2), lambda: K.rewrite_changed(path, news, "key", ["v"], buckets=2)):
        with monkeypatch.context() as m:
            m.setattr(K, "_commit", dies)  # the new version is written, but not named
            with pytest.raises(RuntimeError, match="killed"):
                write()
        assert read() == before
    # a list of versions that was cut short does not count either
    (tmp_path / "t" / "_live" / "1").mkdir(parents=True)
    assert read() == before
    K.upsert(news, path, "key", buckets=2)
    assert read() == [(1, "a", "new"), (1, "b", "y"), (2, "a", "z"), (2, "c", "w")]
    # rows added later join the versions that are read
    assert K.insert_new(frame((1, "a", "no"), (1, "d", "d"), (3, "a", "e")), path, "key", buckets=2).count() == 2
    K.rewrite_changed(path, frame((1, "d", "D"), (9, "q", "unknown")), "key", ["v"], buckets=2)
    after = [(1, "a", "new"), (1, "b", "y"), (1, "d", "D"), (2, "a", "z"), (2, "c", "w"), (3, "a", "e")]
    assert read() == after
    assert K.vacuum(spark, path) > 0
    assert read() == after and K.vacuum(spark, path) == 0
    K.upsert(frame((4, "n", "first")), str(tmp_path / "fresh"), "key")
    assert K.read_table(spark, str(tmp_path / "fresh")).count() == 1


def test_verdict_flush(spark, tmp_path):
    path = str(tmp_path / "v")
    at = lambda d: F.to_timestamp(F.lit(d))
    rows = lambda *r: spark.createDataFrame([x[:5] for x in r], "classifier string, key string, value string, by string, reason string").withColumn("decided_at", at("2026-01-01"))
    assert K.flush_verdicts(path, rows().limit(0) if False else nothing(spark, VERDICT), at("2026-01-02")) is False
    assert not os.path.exists(path)
    assert K.flush_verdicts(path, rows(("news", "a", "true", "llm", "")), at("2026-01-02"))
    newer = rows(("news", "b", "true", "llm", ""), ("publisher", "p", "GOV", "llm", "")).withColumn("decided_at", at("2026-03-01"))
    assert K.flush_verdicts(path, newer, at("2026-03-02"))
    assert sorted((r.classifier, r.key) for r in K.read_verdicts(spark, path, at("2026-03-02")).collect()) == [("news", "b"), ("publisher", "p")]


def test_verdict_store_grows_by_deltas(spark, tmp_path):
    path = str(tmp_path / "v")
    at = lambda d: F.to_timestamp(F.lit(d))
    rows = lambda day, *r: spark.createDataFrame([(*x, "llm", "") for x in r], "classifier string, key string, value string, by string, reason string").withColumn("decided_at", at(day))
    K.flush_verdicts(path, rows("2026-01-01", *[("news", f"k{i}", "true") for i in range(300)], ("publisher", "p", "GOV")), at("2026-01-01"))
    files = lambda: {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    K.flush_verdicts(path, rows("2026-01-03", ("news", "k7", "false")), at("2026-01-03"))
    assert before <= files() and len(files() - before) == 1  # one key, one file, nothing rewritten
    read = lambda day: {(r.classifier, r.key): r.value for r in K.read_verdicts(spark, path, at(day)).collect()}
    want = read("2026-01-03")
    assert len(want) == 301 and want["news", "k7"] == "false"
    # a flush that fails on the way adds nothing
    broken = rows("2026-01-04", ("news", "x", "true")).withColumn("value", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception):
        K.flush_verdicts(path, broken, at("2026-01-04"))
    assert read("2026-01-03") == want
    for n in range(4):
        K.flush_verdicts(path, rows("2026-01-05", ("news", "k7", f"v{n}") if n == 3 else ("publisher", "p", "GOV")), at("2026-01-05"))
    # a compaction that dies before it deletes leaves the same verdicts
    want, removed = read("2026-01-05"), K.remove_folder
    K.remove_folder = lambda *_: (_ for _ in ()).throw(OSError("gone"))
    try:
        with pytest.raises(OSError):
            K.compact_verdicts(path, spark, at("2026-01-05"), most=2)
    finally:
        K.remove_folder = removed
    assert read("2026-01-05") == want
    untouched = {f for f in files() if "bucket=" in f}
    assert K.compact_verdicts(path, spark, at("2026-01-05"), most=2) == 2
    assert read("2026-01-05") == want and untouched & files()
    assert len(files()) < len(untouched)
    # expiry is by the verdict's own time, at the reader and at the next merge
    assert set(read("2030-01-01")) == {("publisher", "p")}


def test_small_sinks(spark, tmp_path):
    logs = spark.createDataFrame([(1, 5, 3, True)], "id long, configId long, itemCount long, success boolean").withColumn("startedAt", F.to_timestamp(F.lit("2026-01-02 03:04:05")))
    K.write_run_logs(logs, str(tmp_path / "log"))
    assert os.path.isdir(tmp_path / "log" / "configId=5" / "date=2026-01-02")
    K.write_dated_json(logs.select("id"), str(tmp_path / "d"), "n", "2026-01-02", "c")
    assert os.path.isdir(tmp_path / "d" / "name=n" / "day=2026-01-02" / "category=c")
    metas = spark.createDataFrame([
        (2, "나기관", "가", "2020", "R:2", "PAPERS", ("GOV", "llm"), ["DMZ"]), (1, "가기관", "나", "2019", "R:1", "PAPERS", ("PRIVATE", "dict"), []),
        (3, "나기관", "다", "2021", "R:3", "odd", None, []), (4, None, "라", "", "R:4", "BOOKS", ("PRIVATE", "default"), []), (5, "Alpha", "x", "2020", "R:5", "PAPERS", None, []),
    ], "seq long, publisher string, title string, publish_year string, register_no string, menu_id string, classification struct<verdict:string,by:string>, matched_keywords array<string>")
    K.write_sorted_text(G.report_lines(metas, "kci", 3, "2026-01-01 00:00:00"), str(tmp_path / "report"))
    names = sorted(n for n in os.listdir(tmp_path / "report") if n.endswith(".txt"))
    lines = "".join(open(tmp_path / "report" / n, encoding="utf-8").read() for n in names).split("\n")
    assert lines[0] == "=" * 100 and lines[3].startswith(" 총 5건 — 발간자료(PUBLICATIONS) 0 / 논문(PAPERS) 4 / 단행본(BOOKS) 1")
    assert lines[10].startswith("    2건 | PAPERS       | GOV    /LLM판정")
    papers = [x for x in lines if x.startswith("[R:")]
    assert papers == [
        '[R:1] 2019 | 가기관 → PRIVATE(사전) | "나"', '[R:3] 2021 | 나기관 → -(-) | "다"', '[R:2] 2020 | 나기관 → GOV(LLM판정) | "가" | 키워드: DMZ',
        '[R:5] 2020 | Alpha → -(-) | "x"', '[R:4] ---- | (발행기관 없음) → PRIVATE(기본값(PRIVATE)) | "라"',
    ]
    assert "(없음)" in lines and lines[-3] == " 끝 — 총 5건"
    assert [r.publisher for r in G.report_order(metas.where("menu_id = 'PAPERS'")).collect()] == ["가기관", "나기관", "Alpha"]


def test_export_shapes(spark):
    metas = spark.createDataFrame([(9, None, None, "", " ")], "origin_id long, registerNo string, menuId string, publishYear string, titleEn string")
    more = "source title publisher publisherEn author authorEn category categoryEn subCategory subCategoryEn summary summaryEn linkUrl remark isbn coverUrl".split()
    metas = metas.withColumns({c: F.lit(None).cast("string") for c in more}).withColumn("modified_at", F.timestamp_seconds(F.lit(0)))
    row = export.export_archives(metas).first()
    assert len(row) == 30 and (row.menuId, row.publishYear, row.dedupKey, row.trslYn, row.collectedAt) == ("PAPERS", None, "", "N", "1970-01-01 09:00:00")
    assert export.known_origins(metas, spark.createDataFrame([(8,)], "origin_id long")).count() == 0
    assert export.modified_since(metas, "2020-01-01", on=False).count() == 1 and export.modified_since(metas, "2020-01-01").count() == 0


def test_order_does_not_matter(spark):
    """Shuffled and repartitioned input gives the same rows: only seq counts."""
    rows = [("s", f"k{n % 7}", f"w{n % 3}", n) for n in range(60)]
    schema = "source string, source_id string, matched_keyword string, seq long"
    a = U.merge_by_source_id(spark.createDataFrame(rows, schema))
    b = U.merge_by_source_id(spark.createDataFrame(rows[::-1], schema).repartition(7))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.select(*a.columns).collect()))
    assert U.keep_first_narrow(spark.createDataFrame(rows, schema).repartition(5), ["source_id"], "seq").agg(F.sum("seq")).first()[0] == 21
    last = U.first_place_last_value(spark.createDataFrame(rows, schema), "source_id", "seq")
    assert {(r.source_id, r.seq, r.matched_keyword) for r in last.where("source_id = 'k0'").collect()} == {("k0", 0, "w2")}


def test_urls_of_one_short_digest_stay_apart(spark):
    rows = [
        ("riss", "0123456789ab", "http://r/x", "w1", 1), ("riss", "0123456789ab", "http://r/y", "w2", 2), ("riss", "0123456789ab", "http://r/x", "w3", 3),
        ("riss", "A1", "http://r/l?id=A1", "w1", 4), ("riss", "A1", "http://r/m?id=A1", "w2", 5), ("kci", "K", "http://k/1", "w1", 6), ("kci", "K", "http://k/2", "w2", 7),
    ]
    items = spark.createDataFrame(rows, "source string, source_id string, detail_url string, matched_keyword string, seq long")
    got = {r.seq: r.matched_keywords for r in U.merge_by_source_id(items).collect()}
    assert got == {1: ["w1", "w3"], 2: ["w2"], 4: ["w1", "w2"], 6: ["w1", "w2"]}
    records = [bib(k, source="riss", source_id="0123456789ab", detail_url=f"http://r/{k % 2}") for k in range(4)]
    decided = ingest.decisions(spark.createDataFrame(records, BIB_SCHEMA), None, spark.createDataFrame([], VERDICT), spark.createDataFrame([], REPLY))
    assert {r.seq.pos for r in decided.collect()} == {0, 1}


def test_positions_in_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 40).cast("string"))).alias("g"), ((F.col("id") * 7919) % 3001).alias("o"))
    got = B.with_position(rows, ["o"], ["g"]).toPandas().sort_values(["g", "o"])
    assert (got.groupby("g").cumcount().to_numpy() == got["position"].to_numpy()).all()
    whole = B.with_position(rows.select("o"), ["o"]).toPandas().sort_values("o")
    assert whole["position"].tolist() == list(range(3000))
    zipped = J.zip_arrays(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1)))
    assert [tuple(x) for x in spark.range(1).select(zipped).first()[0]] == [("a", 1), ("b", None)]


def test_a_page_without_links_stops_its_crawl(spark):
    from gleanmill.operators.frontier import frontier, page_stops

    links = spark.createDataFrame(
        [("a", 1, 0, "u1"), ("a", 3, 0, "u2"), ("b", 1, 0, "u1"), ("b", 2, 0, "u3")], "crawl string, page long, pos long, url_key string"
    )
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3)], "crawl string, page long")
    assert {tuple(r) for r in page_stops(links, pages).collect()} == {("a", 2), ("b", 3)}
    assert {r.url_key: (r.crawl, r.page) for r in frontier(links, pages).collect()} == {"u1": ("a", 1), "u3": ("b", 2)}
    assert {r.url_key for r in frontier(links).collect()} == {"u1", "u2", "u3"}


def test_expected_pages_in_blocks(spark):
    totals = spark.createDataFrame([("a", 10_001, 1), ("b", 0, 10), ("c", 25, 10)], "k string, total long, page_size long")
    pages = J.expected_pages(totals, block=1000)
    assert {r.k: (r.n, r.hi) for r in pages.groupBy("k").agg(F.count("page").alias("n"), F.max("page").alias("hi")).collect()} == {"a": (10001, 10001), "c": (3, 3)}


def test_hot_keys_are_dealt_out(spark):
    """A third of the rows share one key, a tenth has none: every row comes back, no partition is long."""
    from gleanmill.operators.lookup import attach

    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        rows = spark.range(0, 30_000, 1, 8).select(
            n.alias("seq"), F.when(n % 3 == 0, "hot").when(n % 10 == 1, None).otherwise(n.cast("string")).alias("k")
        )
        table = spark.range(0, 2000).select(F.when(n == 0, "hot").otherwise(n.cast("string")).alias("k"), (n + 1).alias("v"))
        out = attach(rows, table, "k", ["v"], ["seq"])
        plain = rows.join(table, "k", "left").select("seq", "k", "v")
        assert out.exceptAll(plain).count() == 0 and out.count() == 30_000
        sizes = [r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) < 3 * 30_000 / 16
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_article_rejection(spark):
    from gleanmill.operators.files import has_bad_attachment

    frame = spark.createDataFrame([(1, [("a.pdf",), ("view.do",)]), (2, [("a.pdf",)]), (3, None), (4, [("noext",)])], "id int, f array<struct<originalName:string>>")
    assert {r.id for r in frame.where(~has_bad_attachment(F.col("f"))).collect()} == {2, 3}


def test_search(spark):
    rows = spark.createDataFrame([(1, "Ab", "2026-01-01"), (2, "b", "2026-02-01"), (3, None, "2026-03-01")], "id long, name string, d string").withColumn("created_at", F.to_timestamp("d"))
    assert [r.id for r in L.search(rows, "name", "B").orderBy("id").collect()] == [1, 2]
    assert L.search(rows, start="2026-01-15").count() == 3
    assert L.search(rows, start="2026-02-01", end="2026-03-01").count() == 2
    page = L.newest_page(rows, [F.desc("created_at")], 2, 2).collect()
    assert [(r.id, r.total) for r in page] == [(1, 3)]


def items_of(spark, landing):
    from gleanmill.functions.urls import article_identity

    return N.articles_from_rss(N.rss_reader(spark.read, landing)).withColumn("identity", article_identity("guid", "link"))


def test_stream_reads_news_only(spark, tmp_path):
    """Rows a batch reads depend on what is new, not on the table's history."""
    landing, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp")
    item = "<item><title>DMZ {i}</title><link>https://n.example/{i}</link><guid>A{i}</guid></item>"
    verdicts = lambda: (nothing(spark, VERDICT), nothing(spark, REPLY))
    read = []
    for n in range(3):
        write(f"{landing}/{n}.xml", "<rss>" + "".join(item.format(i=i) for i in range(n * 20, n * 20 + 25)) + "</rss>")
        query = feed.poll(spark, landing, table, checkpoint, 25, verdicts, every=None)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
    stored = [r.identity for r in spark.read.parquet(table).collect()]
    assert sorted(stored) == sorted(f"A{i}" for i in range(65))
    # the last poll reads its 25 items and the 20 rows the poll before it stored
    assert read[2] <= read[1] <= 50


def test_stream_equals_batch(spark, tmp_path):
    landing, table, checkpoint = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "cp")
    os.makedirs(landing)
    write(f"{landing}/1.xml", RSS)
    replies = spark.createDataFrame([("news", "AKR5", '{"relevant": false}')], REPLY)
    verdicts = lambda: (nothing(spark, VERDICT), replies)
    run = lambda: feed.poll(spark, landing, table, checkpoint, 25, verdicts, every=None).awaitTermination()
    run()
    assert [r.identity for r in spark.read.parquet(table).collect()] == ["AKR1"]
    # the next poll sees the old item again and two new ones, one of them off topic
    more = RSS.replace("</channel>", "<item><title>비무장지대</title><link>https://n.example/4</link><guid>AKR4</guid></item><item><title>DMZ 게임</title><link>https://n.example/5</link><guid>AKR5</guid></item></channel>")
    write(f"{landing}/2.xml", more)
    run()
    assert sorted(r.identity for r in spark.read.parquet(table).collect()) == ["AKR1", "AKR4"]
    # a fresh checkpoint replays everything and adds nothing: history is the table
    feed.poll(spark, landing, table, str(tmp_path / "cp2"), 25, verdicts, every=None).awaitTermination()
    assert spark.read.parquet(table).count() == 2
    # a batch that is tried again adds nothing
    before = spark.read.parquet(table).count()
    offers = items_of(spark, landing).withColumn("again", F.lit(False))
    feed.batch_writer(table, 25, verdicts, checkpoint)(offers, 0)
    assert spark.read.parquet(table).count() == before
    # an unread reply kept nothing out: the dropped item is still judged each time, and batch agrees
    items = N.articles_from_rss(N.rss_reader(spark.read, landing)).withColumn("seq", F.struct("captured_at", "capture", "link"))
    judged = collect.judged_articles(items, None, *verdicts())
    assert {r.guid for r in judged.where("status = 'saved'").select("guid").collect()} == {"AKR1", "AKR4"}


def test_meta_files_read_back(spark, tmp_path):
    write(str(tmp_path / "news-crawler" / "articles" / "5" / "aa" / "meta.json"), json.dumps({"title": "T", "writedate": "2025-06-13 15:30", "img": [{"s3Path": "s3://b/x.png", "url": "u"}], "file": []}))
    row = export.export_articles(T.article_metas(spark, str(tmp_path))).first()
    assert (row.title, row.regDt, row.regDtParsed, row.files[0].file_path, row.files[0].mime_type, row.skippedFiles) == ("T", "2025-06-13 15:30:00", True, "/x.png", "image/png", 0)
