"""Harvest scans over captures and files that Spark makes of the given tables.

Every service gets replies in its own envelope, a page of twenty records each;
some pages are error replies and some are no reply of the service at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.queries.registry import query
from gleanmill.session import table
from gleanmill.sources import bibliography as B

PAGE = 20
S = F.lit


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _flat(value: Column) -> Column:
    """Whole text on one line, between marks so that nothing is trimmed."""
    return F.concat(S("T "), F.regexp_replace(value, r"[\x00-\x20\x7F]+", " "), S(" ."))


def _ascii(value: Column) -> Column:
    return F.concat(S("T "), F.regexp_replace(value, "[^!-~]+|[<>&]", " "), S(" ."))


def _replies(rows: DataFrame, number: str, source: str, kind: str, record: Column, reply, failed: str) -> DataFrame:
    """Captures (schemas.CAPTURE) of pages of records, error replies and foreign pages among them."""
    page = F.floor(F.col(number) / PAGE).cast("int")
    pages = rows.select(page.alias("request_no"), F.struct(F.col(number), record.alias("r")).alias("o")).groupBy("request_no").agg(
        F.sort_array(F.collect_list("o")).alias("o")
    )
    marks = F.array_join(F.transform("o", lambda o: F.md5(o[number].cast("string").cast("binary"))), " ")
    body = (
        F.when(F.col("request_no") % 7 == 3, S(failed))
        .when(F.col("request_no") % 11 == 5, F.concat(S("<html>busy "), marks))
        .otherwise(reply(F.transform("o", lambda o: o["r"])))
    )
    return pages.select(
        S(source).alias("source"), "request_no", S(1).alias("page"), S(kind).alias("kind"), S("DMZ").alias("keyword"), body.alias("body")
    )


def _xml(value: Column, root: str) -> Column:
    return F.to_xml(value, {"rowTag": root})


def _shape(read: DataFrame) -> DataFrame:
    return read.select(
        "source", "request_no", F.col("seq.pos").cast("long").alias("pos"), "source_id", "title", "title_en", "author", "author_en",
        "publisher", "publish_year", "category", "sub_category", "summary", "detail_url", "material_type", "matched_keyword", "message",
    )


def kci_replies(spark, folder) -> DataFrame:
    lang = lambda name, value: F.struct(value.alias("_VALUE"), S(name).alias("_lang"))
    author = lambda name, english: F.struct(name.alias("_VALUE"), english.alias("_english"))
    n = F.col("doc_id")
    record = F.struct(
        F.struct(
            F.col("lang").alias("journal-name"), F.col("source").alias("publisher-name"), _text(1990 + n % 30).alias("pub-year"),
            _text(n % 12).alias("volume"), F.when(n % 3 > 0, _text(n % 4)).alias("issue"),
        ).alias("journalInfo"),
        F.struct(
            F.when(n % 17 == 0, S("")).otherwise(_text(n)).alias("_article-id"),
            F.struct(F.array(lang("original", F.concat(S("R&D <"), _text(n), S(">"))), lang("english", F.concat(S("No. "), _text(n)))).alias("article-title")).alias("title-group"),
            F.struct(F.array(lang("original", _flat(F.col("text")))).alias("abstract")).alias("abstract-group"),
            F.struct(F.array(author(F.concat(S("Kim "), F.col("lang"), S("(univ)")), F.concat(S("K. "), F.col("lang"))), author(S("Lee"), S(None).cast("string"))).alias("author")).alias("author-group"),
        ).alias("articleInfo"),
    )
    reply = lambda rs: _xml(F.struct(F.struct(F.struct(_text(F.size(rs)).alias("total")).alias("result"), rs.alias("record")).alias("outputData")), "MetaData")
    return _replies(table(spark, folder, "documents"), "doc_id", "kci", "title", record, reply, "<MetaData><inputData/></MetaData>")


def _sql(source: str, relation: str, number: str, dropped: str, failed: str, foreign: str, kind: str, fields: dict[str, str]) -> str:
    """Records straight from the table, and the message of every page that has none."""
    names = (
        "source_id", "title", "title_en", "author", "author_en", "publisher", "publish_year", "category", "sub_category", "summary",
        "detail_url",
    )
    picked = ", ".join(f"({fields.get(n, 'NULL')})::VARCHAR AS {n}" for n in names)
    return f"""
WITH o AS (SELECT *, {number} AS n, CAST({number} // {PAGE} AS INT) AS request_no FROM {relation}),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY request_no ORDER BY n) - 1 AS BIGINT) AS pos FROM o)
SELECT '{source}' AS source, request_no, pos, {picked}, {kind} AS material_type, 'DMZ' AS matched_keyword, NULL::VARCHAR AS message
FROM p WHERE request_no % 7 <> 3 AND request_no % 11 <> 5 AND NOT ({dropped})
UNION ALL
SELECT '{source}', request_no, NULL, {", ".join(["NULL"] * len(names))}, NULL, 'DMZ',
  CASE WHEN request_no % 7 = 3 THEN '{failed}' ELSE '{foreign}' || string_agg(md5(n::VARCHAR), ' ' ORDER BY n) END
FROM p WHERE request_no % 7 = 3 OR request_no % 11 = 5 GROUP BY request_no"""


FLAT = "'T ' || regexp_replace(text, '[\\x00-\\x20\\x7F]+', ' ', 'g') || ' .'"
KCI_SQL = _sql(
    "kci", "documents", "doc_id", "n % 17 = 0", "outputData missing: ", "outputData missing: busy ", "'article'",
    {
        "source_id": "n", "title": "'R&D <' || n || '>'", "title_en": "'No. ' || n", "author": "'Kim ' || lang || ', Lee'",
        "author_en": "'K. ' || lang", "publisher": "source", "publish_year": "1990 + n % 30",
        "sub_category": "lang || ' ' || (n % 12) || CASE WHEN n % 3 > 0 THEN '(' || (n % 4) || ')' ELSE '' END", "summary": FLAT,
    },
)


@query(KCI_SQL)
def q_scan_kci(spark, folder):
    return _shape(B.kci(kci_replies(spark, folder)))


def riss_replies(spark, folder) -> DataFrame:
    n = F.col("o_orderkey")
    record = F.struct(
        F.concat(S("Order "), _text(n)).alias("riss.title"), F.concat(S("A| "), F.col("o_orderstatus"), S(" |")).alias("riss.author"),
        F.col("o_orderstatus").alias("riss.publisher"), F.date_format("o_orderdate", "yyyy.MM").alias("riss.pubdate"),
        F.col("o_orderpriority").alias("riss.stitle"), _text(n % 5).alias("riss.vol"),
        F.when(n % 4 == 1, "-").otherwise(_text(n % 4)).alias("riss.no"),
        F.concat(S("http://r.example/link?x=1"), F.when(n % 3 > 0, F.concat(S("&id=A"), _text(n))).otherwise(F.concat(S("&key="), _text(n)))).alias("url"),
    )
    reply = lambda rs: _xml(F.struct(F.struct(_text(F.size(rs)).alias("totalcount"), S("0").alias("Error")).alias("head"), rs.alias("metadata")), "record")
    failed = "<record><head><Error>9</Error><ErrorMessage>no key</ErrorMessage></head></record>"
    return _replies(table(spark, folder, "orders"), "o_orderkey", "riss", "U", record, reply, failed)


RISS_SQL = _sql(
    "riss", "orders", "o_orderkey", "false", "[9]: no key", "head missing: <html>busy ", "'book'",
    {
        "source_id": "CASE WHEN n % 3 > 0 THEN 'A' || n ELSE left(md5('http://r.example/link?x=1&key=' || n), 12) END",
        "title": "'Order ' || n", "author": "'A, ' || o_orderstatus", "publisher": "o_orderstatus", "publish_year": "year(o_orderdate)",
        "sub_category": "o_orderpriority || CASE WHEN n % 5 > 0 THEN ' ' || (n % 5) || CASE WHEN n % 4 > 1 THEN '(' || (n % 4) || ')' ELSE '' END ELSE '' END",
        "detail_url": "'http://r.example/link?x=1' || (CASE WHEN n % 3 > 0 THEN '&id=A' ELSE '&key=' END) || n",
    },
)


@query(RISS_SQL)
def q_scan_riss(spark, folder):
    return _shape(B.riss(riss_replies(spark, folder)))


def ntis_replies(spark, folder) -> DataFrame:
    n = F.col("doc_id")
    two = lambda korean, english: F.struct(korean.alias("Korean"), english.alias("English"))
    absent = S(None).cast("string")
    record = F.struct(
        _text(n).alias("TermSn"), F.when(n % 2 == 0, F.concat(S("TRKO"), _text(n))).alias("ResearchPublicNo"), S("201905").alias("PublicationYm"),
        F.col("source").alias("PublicationAgency"), two(F.concat(S("R&D [DMZ] "), _text(n)), S("R&D")).alias("ResultTitle"),
        two(S("a; b;"), absent).alias("Keyword"), two(_ascii(F.col("text")), absent).alias("Abstract"), S("Park").alias("ManagerName"),
    )

    def reply(rs: Column) -> Column:
        # as the service sends it: bare ampersands and highlighted words
        clean = _xml(F.struct(_text(F.size(rs)).alias("TOTALHITS"), F.struct(rs.alias("HIT")).alias("RESULTSET")), "RESULT")
        return F.replace(F.replace(clean, S("&amp;"), S("&")), S("[DMZ]"), S('<span class="search_word">DMZ</span>'))

    return _replies(table(spark, folder, "documents"), "doc_id", "ntis", "", record, reply, "<error>IP denied</error>")


NTIS_SQL = _sql(
    "ntis", "documents", "doc_id", "false", "error reply: IP denied", "bad reply: <html>busy ", "'report'",
    {
        "source_id": "(CASE WHEN n % 2 = 0 THEN 'TRKO' ELSE '' END) || n", "title": "'R&D DMZ ' || n", "title_en": "'R&D'", "author": "'Park'",
        "publisher": "source", "publish_year": "2019", "category": "'연구보고서'", "sub_category": "'a, b'",
        "summary": "regexp_replace('T ' || regexp_replace(text, '[^!-~]+|[<>&]', ' ', 'g') || ' .', ' +', ' ', 'g')",
    },
)


@query(NTIS_SQL)
def q_scan_ntis(spark, folder):
    return _shape(B.ntis(ntis_replies(spark, folder)))


def losi_replies(spark, folder) -> DataFrame:
    n = F.col("p_partkey")
    named = lambda *values: F.array(*[F.struct(v.alias("name")) for v in values])
    words = F.transform(F.sequence(S(1), F.col("p_size").cast("int")), lambda k: F.struct(F.concat(S("k&#"), (64 + k).cast("string"), S(";")).alias("name")))
    record = F.struct(
        F.concat(S("KDM"), _text(n)).alias("lodID"), F.concat(F.col("p_name"), S(" &#183; &lt;b&gt;")).alias("title"), S("c2018").alias("pubYear"),
        F.col("p_brand").alias("publisher"), F.struct(F.when(n % 2 == 0, F.col("p_type")).otherwise("").alias("title")).alias("journal"),
        named(F.col("p_type"), S("홍길동"), S("홍길동")).alias("authorList"), words.alias("keywordList"), S(" ").alias("abstractCont"),
    )

    def reply(rs: Column) -> Column:
        inner = F.struct(F.size(rs).alias("totalCount"), rs.alias("searchList"))
        # the service wraps its result in a list or not
        return F.when(F.col("request_no") % 2 == 0, F.to_json(F.struct(inner.alias("result")))).otherwise(F.to_json(F.struct(F.array(inner).alias("result"))))

    failed = '{"result":[{"error":[{"code":"E1","message":"bad key"}]}]}'
    return _replies(table(spark, folder, "part"), "p_partkey", "losi", "BOOK", record, reply, failed)


LOSI_SQL = _sql(
    "losi", "part", "p_partkey", "false", "[E1]: bad key", "bad reply: <html>busy ", "'book'",
    {
        "source_id": "'KDM' || n", "title": "p_name || ' · <b>'", "author": "'홍길동'", "publisher": "p_brand", "publish_year": "2018",
        "sub_category": "CASE WHEN n % 2 = 0 THEN p_type ELSE array_to_string(list_transform(range(1, p_size + 1), lambda k: 'k' || chr(CAST(64 + k AS INT))), ', ') END",
    },
)


@query(LOSI_SQL)
def q_scan_losi(spark, folder):
    return _shape(B.losi(losi_replies(spark, folder)))


def kisti_replies(spark, folder) -> DataFrame:
    n = F.col("p_partkey")
    item = lambda code, value: F.struct(S(code).alias("_metaCode"), value.alias("_VALUE"))
    record = F.struct(F.array(
        item("CN", F.concat(F.when(n % 3 == 0, S("DIKO")).otherwise(S("JAKO")), _text(n))), item("Title", F.concat(S("<b>"), F.col("p_name"), S("</b>  part"))),
        item("Title2", F.col("p_brand")), item("Publisher", F.when(n % 2 == 0, F.col("p_brand")).otherwise("")), item("JournalName", F.col("p_type")),
        item("Pubdate", F.concat(_text(2000 + F.col("p_size")), S("0101"))), item("Author", S("first")), item("Author", S("second")),
    ).alias("item"))
    reply = lambda rs: _xml(F.struct(F.struct(_text(F.size(rs)).alias("TotalCount")).alias("resultSummary"), F.struct(rs.alias("record")).alias("recordList")), "MetaData")
    failed = "<MetaData><errorDetail><errorCode>E4103</errorCode><errorMessage>token</errorMessage></errorDetail></MetaData>"
    return _replies(table(spark, folder, "part"), "p_partkey", "kisti", "ARTI", record, reply, failed)


KISTI_SQL = _sql(
    "kisti", "part", "p_partkey", "false", "[E4103]: token", "MetaData missing: <html>busy ",
    "CASE WHEN n % 3 = 0 THEN 'thesis' ELSE 'article' END",
    {
        "source_id": "(CASE WHEN n % 3 = 0 THEN 'DIKO' ELSE 'JAKO' END) || n", "title": "p_name || ' part'", "title_en": "p_brand",
        "author": "'second'", "publisher": "CASE WHEN n % 2 = 0 THEN p_brand ELSE p_type END", "publish_year": "2000 + p_size",
        "sub_category": "p_type",
    },
)


@query(KISTI_SQL)
def q_scan_kisti(spark, folder):
    return _shape(B.kisti(kisti_replies(spark, folder)))


def ency_replies(spark, folder) -> DataFrame:
    n = F.col("o_orderkey")
    record = F.struct(
        F.concat(S("e"), F.lpad(_text(n), 7, "0")).alias("EID"),
        F.struct(F.struct(F.concat(S("Entry "), _text(n)).alias("ko")).alias("name")).alias("headword"),
        F.concat(S("Kim(1990), "), F.col("o_orderstatus")).alias("writer"), F.col("o_orderstatus").alias("Type"),
        F.array(F.col("o_orderpriority"), S("")).alias("nature"), _text(F.col("o_orderdate")).alias("lastModified"),
        F.struct(F.array(F.struct(F.struct(F.concat(S("deep "), _text(n)).alias("text")).alias("content")), F.struct(F.struct(S("more").alias("text")).alias("content"))).alias("value")).alias("요약"),
    )
    reply = lambda rs: F.to_json(F.struct(F.struct(F.size(rs).alias("total_count"), rs.alias("found")).alias("data")))
    return _replies(table(spark, folder, "orders"), "o_orderkey", "encykorea", "", record, reply, "{")


ENCY_SQL = _sql(
    "encykorea", "orders", "o_orderkey", "false", "bad reply: {", "bad reply: <html>busy ", "'article'",
    {
        "source_id": "'E' || lpad(n::VARCHAR, 7, '0')", "title": "'Entry ' || n", "author": "'Kim, ' || o_orderstatus",
        "publisher": "'한국학중앙연구원'", "publish_year": "year(o_orderdate)", "sub_category": "o_orderstatus || ' / ' || o_orderpriority",
        "summary": "'deep ' || n || ', more'", "detail_url": "'https://encykorea.aks.ac.kr/Article/E' || lpad(n::VARCHAR, 7, '0')",
    },
)


@query(ENCY_SQL)
def q_scan_encykorea(spark, folder):
    return _shape(B.encykorea(ency_replies(spark, folder)))


REPLIES = {"kci": kci_replies, "riss": riss_replies, "ntis": ntis_replies, "losi": losi_replies, "kisti": kisti_replies, "encykorea": ency_replies}
REPLY_SQL = {"kci": KCI_SQL, "riss": RISS_SQL, "ntis": NTIS_SQL, "losi": LOSI_SQL, "kisti": KISTI_SQL, "encykorea": ENCY_SQL}


@query(
    "SELECT source, count(*) FILTER (WHERE message IS NULL) AS items, count(message) AS errors, sum(length(message))::BIGINT AS message_chars,"
    " count(DISTINCT source_id) AS ids FROM (" + " UNION ALL ".join(f"SELECT * FROM ({sql})" for sql in REPLY_SQL.values()) + ") GROUP BY source"
)
def q_scan_all(spark, folder):
    """All six services of one capture table at once."""
    captures = None
    for replies in REPLIES.values():
        own = replies(spark, folder)
        captures = own if captures is None else captures.unionByName(own)
    failed = F.col("message").isNotNull()
    return B.harvest_rows(captures).groupBy("source").agg(
        F.count_if(~failed).alias("items"), F.count_if(failed).alias("errors"), F.sum(F.length("message")).alias("message_chars"),
        F.count_distinct("source_id").alias("ids"),
    )
