import json

from gleanmill.functions.urls import host_of
from gleanmill.pages import content as P
from gleanmill.pages import extract as E
from gleanmill.pages.tree import Selector, parse

PAGE = """<html><head><title>t</title><style>p{}</style></head><body>
<nav id="menu"><a href="/n">n</a></nav>
<div class="box main" data-x="a-b"><h1> A  title </h1>
<p>one <b>two</b><br>three</p><p style="display: none">gone</p><script>var x</script>
<table><thead><tr><th>h1</th><th>h2</th></tr></thead><tbody><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></tbody></table>
<figure class="f"><img src="/i_w250_.jpg"><figcaption>cap</figcaption></figure><img src="data:x"><img src="v.svg">
<ul><li><a href="a.pdf?f=1">x</a><li><a href="b.do">y</a></ul></div>
<div id="cookie-bar">accept</div><p>""" + "long " * 40 + """</p></body></html>"""


def texts(selector):
    return [" ".join(n.text().split()) for n in Selector(selector).all(parse(PAGE))]


def test_selectors():
    assert texts("div.box h1") == ["A title"]
    assert texts("div.main[data-x] > h1, title") == ["t", "A title"]
    assert texts("#menu a") == ["n"]
    assert texts("[data-x^='a'] li:nth-of-type(2) a") == ["y"]
    assert texts("tbody tr:first-child td") == ["a", "b"]
    assert texts(".none") == []


def test_block_text():
    box = Selector("div.box").all(parse(PAGE))
    assert P.tidy(P.block_text(box)) == "A title <br> one two <br> three <br> h1 h2 <br> a b <br> c <br> cap <br> x <br> y"
    assert "gone" in P.block_text(box, visible_only=False)


def test_clean():
    html = P.clean_html(parse(PAGE), keep_media=False, paragraph_chars=100)
    assert "..." not in P.clean_html(parse(PAGE), keep_media=False)
    assert "<nav" not in html and "accept" not in html and "<img" not in html and "<script" not in html
    assert ("long " * 40)[:100] + "..." in html and 'style="' not in html
    # an element without text and children counts as empty, a picture too
    assert "<img" not in P.clean_html(parse(PAGE), keep_media=True)
    assert "<video>v</video>" in P.clean_html(parse("<p><video>v</video>"), keep_media=True)


def test_jobs(spark):
    pages = spark.createDataFrame([(1, "https://h.example/d/p.html", PAGE), (2, "https://h.example/q", "<h1></h1>")], "page_id long, url string, html string")
    assert E.page_links(pages).count() == 3
    assert [tuple(r) for r in E.selected_links(pages, "li").orderBy("pos").collect()] == [(1, 0, "a.pdf?f=1"), (1, 1, "b.do")]
    rows = [(r.row_no, list(r.cells)) for r in E.page_tables(pages).orderBy("row_no").collect()]
    assert rows == [(0, ["h1", "h2"]), (1, ["a", "b"]), (2, ["c"])]
    targets = [
        {"name": "title", "type": "uniqueText", "selector": "h1"},
        {"name": "content", "type": "duplicatedText", "selector": "div.box p"},
        {"name": "content", "type": "uniqueText", "selector": "th"},
        {"name": "img", "type": "images", "selector": "img", "containerSelector": "figure", "captionSelector": "figcaption"},
        {"name": "file", "type": "file", "selector": "li a", "customTransform": {"pattern": r"^(\w)\.do$", "output": "/get/${1}${2}"}},
        {"name": "none", "type": "file", "selector": ".none"},
        {"name": "opt", "type": "file", "selector": ".none", "optional": True},
        {"name": "writer-list", "type": "uniqueText", "selector": "h1"},
        {"name": "thumb", "type": "thumbnail", "selector": "figure img"},
        {"name": "author", "type": "author", "selector": "ul"},
        {"name": "nobody", "type": "author", "selector": ".none"},
        {"name": "when", "type": "writedate", "selector": ".none"},
    ]
    recipes = spark.createDataFrame([(7, "h.example", json.dumps(targets))], "recipe_id long, host string, targets string")
    got = {r.page_id: r.fields for r in E.extract_fields(pages.withColumn("host", host_of("url")), recipes).collect()}
    first = got[1]
    assert first["title"] == "A title"
    # a selected box is read even if it is hidden itself
    assert first["content"] == "one two <br> three <br> goneh1 h2"
    assert json.loads(first["img"]) == [{"url": "https://h.example/i_w250_.jpg", "caption": "cap"}]
    assert [f["url"] for f in json.loads(first["file"])] == ["https://h.example/d/a.pdf?f=1", "https://h.example/get/b"]
    assert "none" not in first and first["opt"] == "[]" and "writer-list" not in first and "writer" not in first
    assert json.loads(first["thumb"]) == [{"url": "/i_w1597_.jpg"}]
    assert (first["author"], first["nobody"], first["when"]) == ("x, y", P.NO_AUTHOR, P.NO_DATE)
    assert [r.page_id for r in E.with_title(E.extract_fields(pages.withColumn("host", host_of("url")), recipes)).collect()] == [1]


def test_finished_fields_and_lists(spark):
    row = (1, 7, "https://H.example/a?_csrf=1&b=2", {"writer": "기자명 홍길동", "writedate": "2025.01.01 ~ 2025.02.03", "date2": "어제", "title": "t"})
    got = E.finished_fields(spark.createDataFrame([row], "page_id long, recipe_id long, url string, fields map<string,string>")).first()
    assert got.fields == {"writer": "홍길동", "writedate": "20250203", "date2": "어제", "title": "t"}
    assert got.current_url == "https://h.example/a?b=2" and len(got.item_hash) == 8
    html = "<ul><li><a href='/1'>x</a> <i>kim</i></li><li><a href='/2'>y</a> <i> lee  b</i></li></ul>"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    values = E.list_values(pages, json.dumps([{"name": "writer-list", "selector": "li i"}, {"name": "title", "selector": "a"}]))
    joined = E.selected_links(pages, "li").join(values, ["page_id", "pos"]).orderBy("pos")
    assert [(r.href, r.name, r.value) for r in joined.collect()] == [("/1", "writer", "kim"), ("/2", "writer", "lee b")]


def test_accumulate_and_registry(spark):
    fields = {}
    for value in (["a"], "b"):
        E.accumulate(fields, "l", value)
    for value in ({"x": 1, "y": 1}, {"x": 2}):
        E.accumulate(fields, "d", value)
    for value in ("t", None):
        E.accumulate(fields, "p", value)
    assert fields == {"l": ["a", "b"], "d": {"x": 2, "y": 1}, "p": ["t", None]}
    E.register_target("count", lambda root, t, url: str(len(t["chosen"].all(root))))
    assert E.TARGETS["count"](parse("<p><p>"), {"chosen": Selector("p")}, "") == "2"
    E.TARGETS.pop("count")
    values = spark.createDataFrame([(1, "t", 1, "b"), (1, "t", 0, "a")], "page_id long, name string, target_no int, value string")
    assert [tuple(r) for r in E.same_name_text(values).collect()] == [(1, "t", "ab")]
