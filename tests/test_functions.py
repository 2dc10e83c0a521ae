import datetime as dt

import pytest
from pyspark.sql import functions as F

from gleanmill.functions import dates as D
from gleanmill.functions import patterns as P
from gleanmill.functions import text as X
from gleanmill.functions import urls as N
from gleanmill.functions import values as A
from tests.conftest import evaluate


def test_word_edges_next_to_hangul(spark):
    rule = P.java(r"\bDMZ\b", True)
    assert evaluate(spark, ["DMZ를", "xdmz", "dmz", "DMZ_"], F.col("v").rlike(rule)) == [True, False, True, False]


def test_alternatives():
    assert P.alternatives(r"a|b(c|d)|[|]e|\|f") == ["a", "b(c|d)", "[|]e", r"\|f"]
    assert [P.is_literal(x) for x in ("ab", "a.b", "", "가 나", r"a\s")] == [True, False, False, True, False]


def test_wide_spaces(spark):
    assert evaluate(spark, ["　a　\xa0b "], X.strip_tags("v")) == ["a b"]
    assert evaluate(spark, ["　 \xa0"], X.is_blank("v")) == [True]
    assert evaluate(spark, ["a\n"], F.col("v").rlike(P.java("a$"))) == [False]


def test_entities(spark):
    got = evaluate(spark, ["&#65;&#x41;&amp;&copy;", "&#38;#60;&#60;", "&amp;lt; &#183;", "plain", None], X.decode_entities("v"))
    assert got == ["AA&&copy;", "&#60;<", "&lt; ·", "plain", ""]


def test_markup(spark):
    assert evaluate(spark, ['<b>a</b>  <span class="x">DMZ</span> c'], X.strip_tags("v")) == ["a DMZ c"]
    assert evaluate(spark, ['<span class="search_word">DMZ</SPAN> x<b>'], X.strip_highlight("v")) == ["DMZ x<b>"]
    assert evaluate(spark, ["R&D &amp; &#1; &#xF; &x;"], X.escape_bare_amp("v")) == ["R&amp;D &amp; &#1; &#xF; &amp;x;"]
    html = "<p>one<br/> two\xa0</p><FIGURE>x\ny</figure>\r\n&nbsp;\n&lt;&amp;lt;"
    assert evaluate(spark, [html], X.html_to_text("v")) == ["one<br>two<br><&lt;"]
    assert evaluate(spark, ["""<img a src='u1'><IMG src="u2" >"""], X.inline_images("v")) == [["u1", "u2"]]


def test_body(spark):
    body = F.col("v")
    got = evaluate(spark, ["T\n\nS\n T \nbody\nT", "T\nS", "", "x"], X.body_to_text(body, F.lit("T"), F.lit("S")))
    assert got == ["body<br>T", "", "", "x"]


def test_names(spark):
    assert evaluate(spark, ["가나|  나다 ||"], X.relist("v", r"\|")) == ["가나, 나다"]
    assert evaluate(spark, ["홍길동(경희대학교) "], X.drop_affiliation(F.col("v"))) == ["홍길동"]
    assert evaluate(spark, ["김 (a), 이/박;최"], X.people("v")) == ["김, 이, 박, 최"]
    names = F.split("v", ",")
    assert evaluate(spark, ["홍길동,Hong,홍길동", "Hong,Kim"], X.local_names(names)) == ["홍길동", "Hong, Kim"]
    assert evaluate(spark, ["(서울=연합뉴스) 박재하 노선웅 기자 = 내용", "기자"], X.byline_extract("v")) == ["박재하 노선웅", ""]
    assert evaluate(spark, ["기자명  홍 길동", "작성자 관리자"], X.writer_cleanup("v")) == ["홍 길동", "관리자"]


def test_labels(spark):
    vol = lambda j, v, n, absent: X.volume_label(F.lit(j), F.lit(v), F.lit(n), absent)
    got = evaluate(spark, ["x"], vol("J", "3", "2", ()), vol("J", "0", "2", ("0", "-")), vol("J", "3", "-", ("0", "-")), vol("", "3", "2", ()), vol("J", "", "2", ()))
    assert got == [("J 3(2)", "J", "J 3", None, "J")]
    assert evaluate(spark, ["  a b/c: \"d\"?__  x ", "가" * 50], X.title_suffix("v")) == ["a_b_c_d_x", "가" * 40]
    assert evaluate(spark, ["a\n\n b\t\tc  d"], X.text_cleanup("v")) == ["a <br> b c d"]
    assert evaluate(spark, ["a%20b+c%0A", "%E", None], X.keyword_sanitise("v")) == ["a b+c", None, ""]
    assert evaluate(spark, ["ab", "abcdef"], X.pad_left("v", 4), X.pad_right("v", 4)) == [("  ab", "ab  "), ("abcdef", "abcdef")]
    assert evaluate(spark, ["it's"], X.sql_literal("v")) == ["'it''s'"]
    assert evaluate(spark, ["dmz와 접경지역", "없음"], X.matched_keywords("v", ["DMZ", "접경", "접경지역"])) == [["DMZ", "접경", "접경지역"], []]


def test_urls(spark):
    got = evaluate(
        spark,
        ["http://A.com:80/a/../b?x=1&_csrf=2&y=a b#f", "https://x.com", "bad url", "https://x.com/p?a", "https://x.com/?JSESSIONID=1"],
        N.url_normalise("v"),
        N.url_origin("v"),
    )
    assert got == [
        ("http://a.com/b?x=1&y=a+b#f", "http://a.com"),
        ("https://x.com/", "https://x.com"),
        ("bad url", None),
        ("https://x.com/p?a=", "https://x.com"),
        ("https://x.com/", "https://x.com"),
    ]
    base = F.lit("https://x.com/a/b/c.html?z=1#f")
    got = evaluate(spark, ["../c?x", "//h/p", "/r", "?q=1", "#z", "mailto:x", "", "https://y.com?q", "d/./e"], N.url_resolve("v", base))
    assert got == [
        "https://x.com/a/c?x", "https://h/p", "https://x.com/r", "https://x.com/a/b/c.html?q=1",
        "https://x.com/a/b/c.html?z=1#z", "mailto:x", "https://x.com/a/b/c.html?z=1", "https://y.com/?q", "https://x.com/a/b/d/e",
    ]
    assert evaluate(spark, ["../x"], N.url_resolve("v", F.lit("nowhere"))) == [""]
    got = evaluate(spark, ["https://x.com/b?page=3&pg=1&page=9&q=%20", "https://x.com/b?q=1", "https://x.com/?nowPage=x"], N.next_page_url("v"))
    assert got == ["https://x.com/b?page=4&pg=4&q=+", None, None]
    assert evaluate(spark, ["https://x.com/b?maxPageItems=15&pagerOffset=0"], N.page_offset_url("v", F.lit(3))) == ["https://x.com/b?maxPageItems=15&pagerOffset=30"]
    assert evaluate(spark, ["a b~!'()*&가"], N.percent_encode("v")) == ["a%20b~!'()*%26%EA%B0%80"]


def test_templates(spark):
    got = evaluate(spark, ["goView(12,34) x", "none"], N.regex_template("v", r"goView\((\d+),(\d+)\)", "/v/${1}?b=${2}&c=${3}"))
    assert got == ["/v/12?b=34&c= x", "none"]
    frame = spark.createDataFrame([("7", "a b")], "IDX string, T string")
    assert frame.select(N.url_template("/v?i=${IDX}&t=${T}", ["IDX", "T"], F.lit("https://h/x/y"))).first()[0] == "https://h/v?i=7&t=a%20b"
    by_map = N.url_template_from_map(F.col("v"), F.create_map(F.lit("A"), F.lit("1&")), F.lit("https://h/x/y"))
    assert evaluate(spark, ["z?a=${A}&b=${B}"], by_map) == ["https://h/x/z?a=1%26&b="]
    got = evaluate(spark, ["fn_view(103, 'a, b', 1);", "javascript: go()"], N.call_name("v"), N.call_args("v"))
    assert got == [("fn_view", ["103", "a, b", "1"]), ("go", [])]
    assert evaluate(spark, ["/;jsessionid=AB12/board.do?boardId=f1", "/x"], N.session_path_strip("v")) == ["/board/board.do?boardId=f1", "/x"]
    got = evaluate(spark, ["u1 2x, u2 640w,u3"], N.srcset_parse("v"))[0]
    assert [tuple(r) for r in got] == [("u1", None, 2.0), ("u2", 640, None), ("u3", None, None)]
    assert evaluate(spark, ["/news/a b.pdf"], N.proxy_link("v")) == ["/scraper/media?path=%2Fnews%2Fa%20b.pdf"]


def test_pictures_and_keys(spark):
    got = evaluate(spark, ["http://h/x/a_P4.JPG?z", "a_P2.jpg", "x_w250_y_w250_"], N.image_base("v"), N.thumbnail_to_full("v"))
    assert got == [("a.JPG", "http://h/x/a_P4.JPG?z"), ("a.jpg", "a_P2.jpg"), ("x_w250_y_w250_", "x_w1597_y_w250_")]
    assert evaluate(spark, ["http://img.yna.co.kr/p.jpg"], N.image_url_fix("v")) == ["https://img1.yna.co.kr/p.jpg"]
    got = evaluate(spark, ["http://h/a.png", "data:x", "blob:y", "ftp://h/a.png", "https://h/a.svg?x", ""], N.image_url_allowed("v"))
    assert got == [True, False, False, False, False, False]
    keys = ["archive/ab.pdf", "/law/9f.hwp", "", "news-crawler/x.pdf", "archive", "archive/../law/x.pdf", "archive//x.pdf", "archive\\x.pdf"]
    problems = evaluate(spark, keys, N.object_key_problem("v", ["law", "archive"]))
    assert problems[:2] == [None, None] and all(problems[2:])
    assert evaluate(spark, ["news-crawler/a", "/news-crawler/../a", "x/a"], N.readable_key("v")) == [True, False, False]
    assert evaluate(spark, ["s3://b/k/x"], N.object_path("v"), N.object_bucket("v"), N.object_key("v")) == [("/k/x", "b", "k/x")]


@pytest.mark.parametrize(
    "text,full",
    [
        ("2025-06-13", "2025-06-13 00:00:00"),
        ("20250613", "2025-06-13 00:00:00"),
        ("2025.06.13", "2025-06-13 00:00:00"),
        ("2025/06/13", "2025-06-13 00:00:00"),
        ("2025-6-3", "2025-06-03 00:00:00"),
        ("2025.6.3", "2025-06-03 00:00:00"),
        ("2025/6/3", "2025-06-03 00:00:00"),
        ("2025-06-13 15:30:01", "2025-06-13 15:30:01"),
        ("2025-06-13 15:30", "2025-06-13 15:30:00"),
        ("2025.06.13 15:30:01", "2025-06-13 15:30:01"),
        ("2025.06.13 15:30", "2025-06-13 15:30:00"),
        ("2025/06/13 15:30:01", "2025-06-13 15:30:01"),
        ("2025/06/13 15:30", "2025-06-13 15:30:00"),
        ("2025년 6월 3일", "2025-06-03 00:00:00"),
        ("2025년 06월 13일", "2025-06-13 00:00:00"),
        ("2025.6.13 15:30", None),
        ("2025-13-40", None),
        ("2025-02-30", None),
        ("어제", None),
        (None, None),
    ],
)
def test_article_date(spark, text, full):
    assert evaluate(spark, [text], D.article_date("v"), D.article_date("v", keep_time=False)) == [
        (full, full and full[:10] + " 00:00:00")
    ]


def test_dates(spark):
    assert evaluate(spark, ["Thu, 9 Jul 2026 16:13:14 +0900", "9 Jul 2026 16:13:14 GMT", "x"], D.rfc822_to_zone("v")) == [
        "2026-07-09 16:13:14", "2026-07-10 01:13:14", None,
    ]
    assert evaluate(spark, ["20260305", "2026-0305"], D.send_datetime("v", F.lit("91502"))) == ["2026-03-05 09:15:02", None]
    listed = ["2025.01.01 ~ 2025.02.03", "Thursday, January 23, 2025", "2025-1-2 3:04", "march 5, 2025 11:56 am", "x"]
    assert evaluate(spark, listed, D.listed_date("v")) == ["20250203", "20250123", "20250102", "20250305", None]
    legacy = ["March 15, 2025 11:56 am", "입력 2025.03.26 06:56", "2025.3.16", "Thursday, January 23, 2025", "x"]
    assert evaluate(spark, legacy, D.legacy_date("v")) == ["20250315", "20250326", "20250316", "20250123", None]
    assert evaluate(spark, ["2025년 3월 4일 9시", "3월 4일 (월) 요일 9:00", "", "x"], D.korean_datetime("v", 2026)) == [
        "2025030409", "2026030409", "1", "2",
    ]
    assert evaluate(spark, ["c 1999.", "2001.02"], D.year_of("v"), D.year_of("v", True)) == [("1999", ""), ("2001", "2001")]
    assert evaluate(spark, ["AKR20260305038500504.xml", "x"], D.day_from_name("v")) == ["2026-03-05", ""]
    as_of = F.lit("2026-03-10")
    assert evaluate(spark, ["2026-03-03", "2026-03-02"], D.last_days("v", as_of)) == [True, False]
    assert evaluate(spark, ["2026", "2025", "2024", ""], D.this_year("v", as_of), D.since_last_year("v", as_of)) == [
        (True, True), (False, True), (False, False), (None, None),
    ]


def test_since():
    assert D.parse_since("2026-01-02") == dt.datetime(2026, 1, 2)
    assert D.parse_since("2026-01-02 03:04:05") == dt.datetime(2026, 1, 2, 3, 4, 5)
    assert D.parse_since(None) is None
    for bad in ("2026-1-2", "02/03/2026", "2026-13-01"):
        with pytest.raises(ValueError):
            D.parse_since(bad)


def test_values(spark):
    frame = spark.createDataFrame([(i,) for i in (7, 15, 35, 75, 100, 300)], "n long")
    assert [r[0] for r in frame.select(A.nearest_allowed("n").alias("r")).collect()] == [10, 10, 20, 100, 100, 100]
    record = '{"Head-Word":{"ko":"제목"},"writers":["a","b <i>c</i>"],"x":null,"y":" ","title":"t"}'
    got = evaluate(
        spark,
        [record],
        A.alias_pick(A.text_entries(A.json_entries("v")), ["headword"]),
        A.alias_pick(A.text_entries(A.json_entries("v")), ["x", "y", "writers"]),
        A.alias_pick(A.text_entries(A.json_entries("v")), ["none"]),
    )
    assert got == [("제목", "a, b c", "")]
    assert evaluate(spark, ['{"a":{"b":{"c":5}}}', "bad"], A.json_path("v", "a.b.c")) == ["5", None]
    assert evaluate(spark, ["123456789x", "1234567890123", "12", None], A.isbn_valid("v")) == [True, True, False, False]


def test_texts_of_any_depth(spark):
    deep = "5"
    for _ in range(20):
        deep = '{"a":' + deep + "}"
    records = [
        '{"title":{"a":{"b":{"c":"deep"}}}}', '{"title":[["x",[{"q":" ","name":{"ko":["<b>a</b> &amp;  b"]}}]],{"z":{"y":[true,1.50,null]}}]}',
        '{"title":{"name":{"ko":{"a":" "}},"text":{"b":{"c":{"d":"t"}}}}}', '{"title":{"ko":"flat"}}', '{"title":' + deep + "}", "bad",
    ]
    got = evaluate(spark, records, A.alias_pick(A.text_entries(A.json_entries("v")), ["title"]))
    assert got == ["deep", "x, a & b, true, 1.5", "t", "flat", "5", ""]
    looks = ['{"title":"[abc]"}', '{"title":"{a: [1]"}', '{"title":"[1] and [2]"}', '{"title":[]}', '{"title":{"x":[{},[]]}}', '{"title":"[[\\"x\\"], {\\"b\\": 1}]"}']
    assert evaluate(spark, looks, A.alias_pick(A.text_entries(A.json_entries("v")), ["title"])) == ["[abc]", "{a: [1]", "[1] and [2]", "", "", "x, 1"]


def test_files(spark):
    got = evaluate(spark, ["s3://b/a.JPG?x", "a.hwp", "a.do", "a"], A.file_kind("v"), A.mime_type("v"), A.mime_type("v", A.OFFICE_OVERRIDES))
    octet = A.UNKNOWN_MIME
    assert got == [("image", "image/jpeg", "image/jpeg"), ("file", octet, "application/x-hwp"), (None, octet, octet), (None, octet, octet)]
    assert evaluate(spark, ["a.pdf", "view.do", "noext", ".hidden"], A.attachment_problem("v")) == [None, "script", "no extension", "no extension"]
    url, title = F.lit("https://x/y/z.do"), F.lit("t/ t")
    headers = ['attachment; filename="%EA%B1%B0.pdf"', "x; filename*=UTF-8''a%20b.hwp", 'filename="' + "가.pdf".encode().decode("latin-1") + '"', 'filename="가나.pdf"', ""]
    assert evaluate(spark, headers, A.filename_resolve("v", F.lit(""), url, title)) == ["거.pdf", "ab.hwp", "가.pdf", "가나.pdf", "t_t.pdf"]
    assert evaluate(spark, ["보고서 1.hwp", "다운로드"], A.filename_resolve(F.lit(""), "v", F.lit("https://x/y/z.pdf?q"), title)) == ["보고서1.hwp", "z.pdf"]


def test_replies(spark):
    replies = ['ok {"relevant": "False","reason":"r"} .', '{"relevant":false}', "none", '{"relevant":true}', '{"reason":"x"}']
    got = evaluate(spark, replies, A.relevant_unless_false("v"), A.only_true("v"))
    assert [(a.ok, a.value, b.value) for a, b in got] == [
        (True, False, False), (True, False, False), (False, True, False), (True, True, True), (True, True, False),
    ]
    got = evaluate(spark, ['{"academic":false}', '{"academic":"false"}'], A.unless_boolean_false("v"))
    assert [r.value for r in got] == [False, True]
    got = evaluate(spark, ['{"verdict":"GOV","confidence":0.85}', '{"verdict":"GOV","confidence":0.3}', "x"], A.institution_reply("v"))
    assert [tuple(r) for r in got] == [("GOV", "llm"), ("PRIVATE", "llm-lowconf"), ("PRIVATE", "default")]
    got = evaluate(spark, ['so: [{"i":1,"theme":"a"},{"i":"2","theme":"b"}]', "none"], A.reply_rows("v"))
    assert [[tuple(x) for x in r] if r else r for r in got] == [[("1", "a"), ("2", "b")], None]
    assert evaluate(spark, ['{"a":1,"b":2}', "bad"], A.config_reply("v", F.lit('{"a":"z"}'))) == [{"a": "z", "b": "2"}, None]


def test_blank_runs_are_found_as_by_the_plain_class(spark):
    import random

    from gleanmill.functions.patterns import BLANK_RUN, WIDE_SPACES, java

    rng = random.Random(5)
    some = [*map(chr, WIDE_SPACES), *" " * 20, *"\t\n\r\x0b\f\x1c\x85\x00\x7f​", *"ab!~가😀é" * 4]
    texts = [("".join(rng.choice(some) for _ in range(rng.randrange(30))),) for _ in range(2000)]
    both = spark.createDataFrame(texts, "t string").select(
        F.regexp_replace("t", BLANK_RUN, " ").alias("got"), F.regexp_replace("t", java(r"\s+"), " ").alias("want")
    )
    assert both.where("got <> want").count() == 0
