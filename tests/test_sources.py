import json
import os

import pytest
from pyspark.sql import functions as F

from gleanmill import schemas as S
from gleanmill.operators import joins as J
from gleanmill.sources import bibliography as B
from gleanmill.sources import news as N
from gleanmill.sources import stored as T

ARTICLE = """<?xml version="1.0" encoding="UTF-8"?>
<YNewsML><Header><Action>C</Action><ContentID>{id}</ContentID><SendDate>{date}</SendDate><SendTime>91502</SendTime></Header>
<Metadata><Urgency>4</Urgency><Category code="01"/><Category code="02"/><Href>https://news.example/{id}</Href><Writer>{writer}</Writer></Metadata>
<NewsContent><Title>{title}</Title><SubTitle>부제</SubTitle><Body><![CDATA[{title}
부제

(파주=연합뉴스) 김가나 기자 = DMZ 본문 & 둘째
끝]]></Body>
<AppendData mimetype="image/jpg"><Href>http://img.yna.co.kr/p/A_P4.jpg</Href></AppendData>
<AppendData mimetype="image/jpg"><Href>http://img.yna.co.kr/p/A_P2.jpg</Href></AppendData>
<AppendData mimetype=""><Href>http://img.yna.co.kr/p/B.jpg</Href></AppendData></NewsContent></YNewsML>"""


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def archive(tmp_path):
    root = str(tmp_path / "feed")
    write(f"{root}/202603/AKR20260305000100.xml", ARTICLE.format(id="AKR1", date="20260305", title="제목 하나", writer=""))
    write(f"{root}/202603/AKR20260305000200.XML", ARTICLE.format(id="AKR2", date="2026-bad", title="제목 둘", writer="이다라"))
    write(f"{root}/202604/AKR20260401000100.xml", ARTICLE.format(id="AKR1", date="20260401", title="제목 하나", writer=""))
    write(f"{root}/202604/AKR20260401000200.xml", ARTICLE.format(id="AKR4", date="20260401", title=" ", writer=""))
    write(f"{root}/202604/AKR20260401000300.xml", "<YNewsML><Header><ContentID>x</Head")
    write(f"{root}/202604/note.txt", "no xml")
    write(f"{root}/other/AKR20260401000900.xml", ARTICLE.format(id="AKR9", date="20260401", title="밖", writer=""))
    return root


def test_news_xml(spark, archive):
    scanned = N.scan_news_xml(spark, archive)
    rows = {(r.seq.month, r.seq.file): r for r in N.articles_from_xml(scanned).collect()}
    assert sorted(k[1] for k in rows) == ["AKR20260305000100.xml", "AKR20260305000200.XML", "AKR20260401000100.xml"]
    first = rows[("202603", "AKR20260305000100.xml")]
    assert first.content == "(파주=연합뉴스) 김가나 기자 = DMZ 본문 & 둘째<br>끝"
    assert (first.guid, first.title, first.writer, first.reg_dt) == ("AKR1", "제목 하나", "김가나", "2026-03-05 09:15:02")
    assert first.img_urls == ["https://img1.yna.co.kr/p/A_P4.jpg"]
    assert first.matched_keywords == ["DMZ"]
    second = rows[("202603", "AKR20260305000200.XML")]
    assert second.writer == "이다라" and second.reg_dt is not None
    assert N.articles_from_xml(N.scan_news_xml(spark, archive, month="202604")).count() == 1
    one_month = N.scan_news_xml(spark, archive, month="202604")
    assert all("/202604/" in name for name in one_month.inputFiles()) and len(one_month.inputFiles()) == 3
    # a damaged article does not take the others of its file with it
    parts = [ARTICLE.format(id=f"P{i}", date="20260501", title=f"제목 {i}", writer="").split("?>", 1)[1] for i in range(4)]
    parts[1] = parts[1].replace("</Header>", "</Head>")
    write(f"{archive}/202605/many.xml", "<Feed>" + "\n".join(parts) + "</Feed>")
    many = N.scan_news_xml(spark, archive, month="202605")
    assert sorted(r.guid for r in N.articles_from_xml(many).collect()) == ["P0", "P2", "P3"]
    assert [r.problem for r in N.news_xml_errors(many).collect()] == ["unreadable"]
    problems = {r.problem for r in N.news_xml_errors(scanned).collect()}
    assert "no title" in problems and len(problems) >= 1


RSS = """<rss><channel><title>feed</title>
<item><title>DMZ 소식</title><link>https://n.example/1</link><guid isPermaLink="false">AKR1</guid>
<description><![CDATA[<p>(서울=연합뉴스) 박마바 기자 = 첫 줄<br/>둘째</p><img src="https://i.example/x_P4.jpg">]]></description>
<pubDate>Thu, 9 Jul 2026 16:13:14 +0900</pubDate><enclosure url="https://i.example/x_P2.jpg"/></item>
<item><title>무관</title><link>https://n.example/2</link><guid>G2</guid><description>x</description><pubDate>bad</pubDate></item>
<item><title> </title><link>https://n.example/3</link></item>
</channel></rss>"""


def test_rss(spark, tmp_path):
    write(str(tmp_path / "rss" / "a.xml"), RSS)
    rows = {r.link: r for r in N.articles_from_rss(N.rss_reader(spark.read, str(tmp_path / "rss"))).collect()}
    assert set(rows) == {"https://n.example/1", "https://n.example/2"}
    one = rows["https://n.example/1"]
    assert (one.guid, one.reg_dt, one.writer) == ("AKR1", "2026-07-09 16:13:14", "박마바")
    assert one.content == "(서울=연합뉴스) 박마바 기자 = 첫 줄<br>둘째"
    assert one.img_urls == ["https://i.example/x_P4.jpg"] and one.matched_keywords == ["DMZ"]
    assert rows["https://n.example/2"].guid == "G2" and rows["https://n.example/2"].reg_dt is not None


KCI = """<MetaData><inputData/><outputData><result><total>2</total></result>
<record><journalInfo><journal-name>환경지</journal-name><publisher-name>환경학회</publisher-name><pub-year>2021</pub-year><volume>3</volume><issue>2</issue></journalInfo>
<articleInfo article-id="ART1"><article-categories>농학</article-categories><title-group><article-title lang="original"><![CDATA[DMZ 생태]]></article-title>
<article-title lang="english">DMZ ecology</article-title></title-group><abstract-group><abstract lang="original"> 초록 </abstract></abstract-group>
<author-group><author english="Ko, H">고하정(경희대학교)</author><author>김나</author></author-group><url>https://k.example/1</url></articleInfo></record>
<record><journalInfo/><articleInfo article-id=""><title-group><article-title lang="original">x</article-title></title-group></articleInfo></record></outputData></MetaData>"""
RISS = """<?xml version="1.0"?><record><head><totalcount>2</totalcount><Error>0</Error></head>
<metadata><riss.title>접경 연구</riss.title><riss.author>길희영| 정재상|</riss.author><riss.publisher>가대학교</riss.publisher><riss.pubdate>2020.02</riss.pubdate>
<riss.stitle>국토지</riss.stitle><riss.vol>5</riss.vol><riss.no>-</riss.no><url>http://r.example/link?id=A109</url></metadata>
<metadata><riss.title>무번호</riss.title><url>http://r.example/x</url></metadata></record>"""
NTIS = """<RESULT><TOTALHITS>1</TOTALHITS><RESULTSET><HIT><TermSn>9</TermSn><PublicationYm>201905</PublicationYm><ResearchPublicNo>TRKO1</ResearchPublicNo>
<PublicationAgency>국립생태원</PublicationAgency><ResultTitle><Korean>국가R&D와 <span class="search_word">DMZ</span></Korean><English>R&amp;D</English></ResultTitle>
<Keyword><Korean>생태; 습지;</Korean></Keyword><Abstract><Korean></Korean></Abstract><ManagerName>박다</ManagerName></HIT></RESULTSET></RESULT>"""
LOSI = json.dumps({"result": [{"totalCount": 1, "searchList": [{
    "lodID": "KDM1", "title": "DMZ &#183; 평화", "pubYear": "c2018", "publisher": "가나사", "journal": {"title": ""},
    "authorList": [{"name": "홍길동"}, {"name": "Hong"}, {"name": "홍길동"}], "keywordList": [{"name": f"k{i}"} for i in range(7)], "abstractCont": " ",
}]}]}, ensure_ascii=False)
KISTI = """<MetaData><resultSummary><TotalCount>1</TotalCount></resultSummary><recordList><record rownum="1"><item metaCode="CN" metaName="id">DIKO7</item>
<item metaCode="Title"><![CDATA[<b>DMZ</b> 논문]]></item><item metaCode="Title2">DMZ paper</item><item metaCode="Publisher"/><item metaCode="JournalName">저널</item>
<item metaCode="Pubdate">20170101</item><item metaCode="Author">가</item><item metaCode="Author">나</item></record></recordList></MetaData>"""
ENCY = json.dumps({"data": {"total_count": 1, "found": [{
    "EID": "e0012345", "headword": {"ko": "비무장지대"}, "writers": "x", "writer": "김바(1990), 이사", "Type": "지명", "nature": ["분단"], "lastModified": "2019-1-1", "요약": "요약문"}]}}, ensure_ascii=False)


def captured(spark, *rows):
    filled = [(s, n, 1, k, "DMZ", b) for n, (s, k, b) in enumerate(rows)]
    return spark.createDataFrame(filled, S.CAPTURE)


def test_six_services(spark):
    items, errors = B.harvest(captured(spark, ("kci", "title", KCI), ("riss", "U", RISS), ("ntis", "", NTIS), ("losi", "THESIS", LOSI), ("kisti", "ARTI", KISTI), ("encykorea", "", ENCY)))
    assert errors.count() == 0
    rows = {r.source_id: r for r in items.collect()}
    kci = rows["ART1"]
    assert (kci.title, kci.title_en, kci.author, kci.author_en, kci.sub_category, kci.summary) == ("DMZ 생태", "DMZ ecology", "고하정, 김나", "Ko, H", "환경지 3(2)", "초록")
    assert (kci.publish_year, kci.category, kci.material_type, kci.seq.pos) == ("2021", "농학", "article", 0)
    riss = rows["A109"]
    assert (riss.author, riss.publish_year, riss.sub_category, riss.material_type, riss.summary) == ("길희영, 정재상", "2020", "국토지 5", "book", None)
    assert any(k != "A109" and r.source == "riss" and len(k) == 12 for k, r in rows.items())
    ntis = rows["TRKO1"]
    assert (ntis.title, ntis.title_en, ntis.publish_year, ntis.sub_category, ntis.author, ntis.summary) == ("국가R&D와 DMZ", "R&D", "2019", "생태, 습지", "박다", None)
    losi = rows["KDM1"]
    assert (losi.title, losi.author, losi.publish_year, losi.sub_category, losi.summary, losi.material_type) == ("DMZ · 평화", "홍길동", "2018", "k0, k1, k2, k3, k4, k5, k6", None, "thesis")
    kisti = rows["DIKO7"]
    assert (kisti.title, kisti.publisher, kisti.publish_year, kisti.author, kisti.material_type, kisti.title_en) == ("DMZ 논문", "저널", "2017", "나", "thesis", "DMZ paper")
    ency = rows["E0012345"]
    assert (ency.title, ency.author, ency.publish_year, ency.sub_category, ency.summary) == ("비무장지대", "김바, 이사", "2019", "지명 / 분단", "요약문")
    assert (ency.publisher, ency.detail_url) == (B.ENCY_PUBLISHER, B.ENCY_ORIGIN + "/Article/E0012345")
    assert len(rows) == 7


def test_bad_envelopes(spark):
    bad = captured(
        spark, ("kci", "", "<error>key</error>"), ("riss", "A", "<record><head><Error>9</Error><ErrorMessage>no key</ErrorMessage></head></record>"),
        ("riss", "A", "<html>"), ("ntis", "", "<error>IP</error>"), ("ntis", "", "<RESULT><resMsg>denied</resMsg></RESULT>"),
        ("losi", "", '{"result":[{"error":[{"code":"E1","message":"bad"}]}]}'), ("losi", "", "oops"),
        ("kisti", "", "<MetaData><errorDetail><errorCode>E4103</errorCode><errorMessage>token</errorMessage></errorDetail></MetaData>"), ("encykorea", "", "{"),
    )
    items, errors = B.harvest(bad)
    assert items.count() == 0
    messages = sorted((r.source, r.request_no) for r in errors.collect())
    assert [n for _, n in messages] == [8, 0, 7, 5, 6, 3, 4, 1, 2] or len(messages) == 9
    assert {r.message for r in errors.collect()} >= {"[9]: no key", "[E1]: bad", "[E4103]: token", "error reply: denied"}
    long = captured(spark, ("kisti", "", "<html>" + "x" * 5000), ("losi", "ARTI", LOSI))
    assert [len(r.message) for r in B.kisti(long).collect()] == [len("MetaData missing: ") + 5006]
    assert [len(r.message) for r in B.kisti(long, error_chars=200).collect()] == [len("MetaData missing: ") + 200]
    assert [r.sub_category for r in B.losi(long, keywords=5).collect()] == ["k0, k1, k2, k3, k4"]


def test_ency_details_and_totals(spark):
    listed = json.dumps({"items": [{"eid": "E0000001", "title": "가"}, {"eid": "E0000002", "title": "나", "summary": "s", "writer": "w", "field": "f", "year": "2001"}]}, ensure_ascii=False)
    details = spark.createDataFrame([("e0000001", '{"article": {"summary": "상세", "title": ""}}'), ("E0000002", '{"article": {"summary": "무시"}}')], "eid string, body string")
    items, _ = B.split(B.encykorea(captured(spark, ("encykorea", "", listed)), details))
    rows = {r.source_id: r for r in items.collect()}
    # the overlaid title is blank, and a blank title drops the record
    assert set(rows) == {"E0000002"} and rows["E0000002"].summary == "s"
    totals = B.reported_totals(captured(spark, ("kci", "", KCI), ("riss", "U", RISS), ("ntis", "", NTIS), ("losi", "", LOSI), ("kisti", "", KISTI), ("encykorea", "", ENCY)))
    assert sorted((r.source, r.total) for r in totals.collect()) == [("encykorea", 1), ("kci", 2), ("kisti", 1), ("losi", 1), ("ntis", 1), ("riss", 2)]


def test_stop_rules(spark):
    frame = spark.createDataFrame([(1, 100, 250, 100), (3, 100, 250, 50), (1, 100, 0, 0)], "page long, page_size long, total long, records long")
    for source in J.STOP_RULES:
        assert [r[0] for r in frame.select(J.wants_next_page(source)).collect()] == [True, False, False]
    cap = spark.createDataFrame([(99, 100, 20000, 100), (100, 100, 20000, 100)], frame.schema)
    assert [r[0] for r in cap.select(J.wants_next_page("kisti")).collect()] == [True, False]


def test_stored_metas(spark, tmp_path):
    root = str(tmp_path)
    good = {"title": "가", "content": "c", "img": [{"url": "u", "s3Path": "s3://b/k.jpg"}, {"url": "v"}], "matchedKeywords": ["DMZ"]}
    write(f"{root}/news-crawler/articles/25/ab12cd34/meta.json", json.dumps(good, indent=2, ensure_ascii=False))
    write(f"{root}/news-crawler/articles/25/ffffffff/meta.json", '{"title": "cut')
    write(f"{root}/news-crawler/articles/7/00000000/meta.json", json.dumps({"title": "나"}))
    write(f"{root}/archive-crawler/items/3/0a0b0c0d_제목/meta.json", json.dumps({"registerNo": "KCI:1", "menuId": "PAPERS"}))
    metas = T.article_metas(spark, root)
    assert sorted((r.origin_id, r.item_hash, r.title) for r in metas.collect()) == [(7, "00000000", "나"), (25, "ab12cd34", "가")]
    assert T.article_metas(spark, root, 25, since="2020-01-01").count() == 1
    assert T.article_metas(spark, root, 25, since="2999-01-01").count() == 0
    archive = T.archive_metas(spark, root).first()
    assert (archive.origin_id, archive.item_hash, archive.registerNo) == (3, "0a0b0c0d", "KCI:1")
    from gleanmill.plans.export import file_listing

    listed = {r.title: (r.images, r.files) for r in file_listing(metas).collect()}
    assert listed == {"가": (["s3://b/k.jpg"], []), "나": ([], [])}
    keys = T.key_listing(spark, root, "archive-crawler")
    assert [r.key.rsplit("/", 1)[-1] for r in keys.collect()] == ["meta.json"]
    names = spark.createDataFrame([("f/202601010000",), ("f/2026",), ("g/202601010000",), ("f/202501010000",)], "key string")
    assert [r.stamp for r in T.failure_stamps(names, "f/").collect()] == ["202501010000", "202601010000"]


def test_recipes_and_lists(spark, tmp_path):
    root = str(tmp_path / "configs")
    step = {"id": "s1", "type": "ajaxListApi", "params": {"listPath": "r.list", "totalPagePath": "r.total", "detailUrlTemplate": "/v?i=${ID}", "listFields": {"writer": "W", "date": "D"}, "baseParams": {"a": "1"}}}
    write(f"{root}/1.json", json.dumps({"id": 1, "name": "old", "scheduleTime": ["09:00"], "enabled": True}))
    write(f"{root}/2.json", json.dumps({"id": 1, "name": "new", "scheduleTime": ["09:00", "12:00"], "enabled": True, "steps": [step]}, indent=1))
    write(f"{root}/3.json", "{bad")
    write(f"{root}/4.json", json.dumps({"id": 4, "scheduleTime": ["09:00"], "enabled": False}))
    recipes, bad = T.recipes(spark, root)
    rows = {r.id: r for r in recipes.collect()}
    assert rows[1].name == "new" and rows[1].steps[0].params.listFields == {"writer": "W", "date": "D"}
    assert [r.file_name for r in bad.collect()] == ["3.json"]
    assert [r.id for r in J.due_recipes(recipes, "09:00").collect()] == [1]
    body = json.dumps({"r": {"total": 3, "list": [{"ID": "7&", "W": "w"}, {"ID": "8", "D": "d"}]}})
    captures = spark.createDataFrame([("c", 1, "https://h.example/x/list", body, "r.list", "r.total"), ("c", 2, "https://h.example/x/list", "{}", "r.list", "r.total")], "crawl string, page int, page_url string, body string, list_path string, total_path string")
    listed = T.ajax_rows(captures)
    from gleanmill.functions.urls import url_template_from_map

    mapping = F.create_map(F.lit("writer"), F.lit("W"), F.lit("date"), F.lit("D"))
    out = listed.select("pos", "total_pages", url_template_from_map(F.lit("/v?i=${ID}"), F.col("fields"), F.col("page_url")).alias("url"), T.list_fields(F.col("fields"), mapping).alias("f")).orderBy("pos").collect()
    assert [(r.pos, r.total_pages, r.url, r.f) for r in out] == [
        (0, 3, "https://h.example/v?i=7%26", {"writer": "w", "date": ""}), (1, 3, "https://h.example/v?i=8", {"writer": "", "date": "d"}),
    ]


def test_verdict_files_and_logs(spark, tmp_path):
    write(str(tmp_path / "p.json"), json.dumps({"가기관": {"verdict": "GOV", "by": "llm", "decidedAt": "2026-01-02T03:04:05.000Z"}}, ensure_ascii=False))
    write(str(tmp_path / "n.json"), json.dumps({"AKR1": {"relevant": False, "reason": "r", "at": "bad"}}))
    rows = {r.classifier: r for r in T.verdict_files(spark, {"publisher": str(tmp_path / "p.json"), "news": str(tmp_path / "n.json")}).collect()}
    assert (rows["publisher"].key, rows["publisher"].value, rows["publisher"].decided_at is not None) == ("가기관", "GOV", True)
    assert (rows["news"].value, rows["news"].reason, rows["news"].decided_at) == ("false", "r", None)
    write(str(tmp_path / "log" / "5" / "2026-01-02" / "a.json"), json.dumps({"id": 1, "configId": 5, "startedAt": "2026-01-02T00:00:00Z", "endedAt": "2026-01-02T00:01:00Z", "itemCount": 3, "success": True}))
    log = T.run_logs(spark, str(tmp_path)).first()
    assert (log.configId, log.date, log.itemCount) == (5, "2026-01-02", 3)
    lines = spark.createDataFrame([(1, 'x,"RISS:A1,RISS:T2"'), (2, "RISS:A1 RISS:Z9")], "seq long, value string")
    assert {r.register_no: (r.seq.seq, r.seq.pos) for r in T.register_numbers(lines, "seq").collect()} == {"RISS:A1": (1, 0), "RISS:T2": (1, 1)}


def test_report_fields_are_cleaned_once(spark):
    plan = B.ntis(captured(spark, ("ntis", "", NTIS)))._jdf.queryExecution().optimizedPlan().toString()
    # 13 fields and the text of an error reply, however often they are read
    assert plan.count("<[^>]+>") <= 14
