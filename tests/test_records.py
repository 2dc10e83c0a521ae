import json

from gleanmill.functions import values as A
from tests.conftest import evaluate

PLAIN = [
    '{"a":{"x":[["y"],{"q":1,"name":"<b>z</b> &amp;  &lt;"}],"b":{"c":[]}},"Ab-C":" u\\u00a0 v ","ab_c":2,"n":null,"t":true,"제목":{"ko":" ","b":"w","b":"v"}}'.replace("\\u00a0", " "),
    '{"a":"","d":"1996-01-02","e":{"k":"[1] {"},"f":-12,"f":"\\"q\\" \\\\ \\n"}', "{}",
]
RARE = ['{"a":1.50}', '{"a":-0}', '{"a":{"b":"&#65;"}}', '{"a":"[1, 2]"}', '{"a":"\\u0041"}', "{'a':1}", '{"İ":1}', "[1]", "bad", '{"a":NaN}', '{"a":1', "", None]


def test_record_texts_read_plainly_equal_the_expressions(spark):
    read = evaluate(spark, PLAIN + RARE, A.record_texts("v"), A.text_entries(A.json_entries("v")))
    assert [a for a, _ in read] == [b for _, b in read]
    # plain records take the small reader, rare forms are left to the expressions
    assert all(A._record_texts(r) is not None for r in PLAIN) and all(A._record_texts(r) is None for r in RARE)


def test_picks_prefer_order_then_exact_spelling(spark):
    texts = A.record_texts("v")
    got = evaluate(spark, ['{"ab":"1","a-b":"2","c":" ","c_":"3"}', "bad"], *[A.alias_pick(texts, names) for names in (["a-b"], ["x", "A b"], ["c"], ["c", "c_"])])
    assert got == [("2", "1", "", "3"), ("", "", "", "")]


def test_encykorea_reads_aliases_of_any_shape(spark):
    from gleanmill.sources import bibliography as B

    record = {"ID": "e0000007", "Head-Word": {"name": {"ko": "T"}}, "authors": ["Kim(1990)", "Lee"], "요약": {"value": [{"text": "s"}, 1.5]}, "year": 1999}
    body = json.dumps({"data": {"found": [record, {"id": "none", "title": "x"}]}}, ensure_ascii=False)
    frame = spark.createDataFrame([("encykorea", 1, 1, "", "k", body), ("encykorea", 2, 1, "", "k", "{")], "source string, request_no int, page int, kind string, keyword string, body string")
    got = B.encykorea(frame).orderBy("request_no").select("source_id", "title", "author", "publish_year", "summary", "message").collect()
    assert [tuple(r) for r in got] == [("E0000007", "T", "Kim, Lee", "1999", "s, 1.5", None), (None, None, None, None, None, "bad reply: {")]
