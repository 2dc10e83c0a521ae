"""Text, URL, key, date, JSON and page expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanmill.functions import dates as D
from gleanmill.functions import text as X
from gleanmill.functions import urls as N
from gleanmill.functions import values as A
from gleanmill.operators.dedupe import merge_images
from gleanmill.operators.files import file_rows
from gleanmill.pages import extract as E
from gleanmill.queries.registry import query
from gleanmill.schemas import ARTICLE_META
from gleanmill.sources.stored import page_captures, parse_metas, readable, register_numbers
from gleanmill.session import spread, table


_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _sql_trim(value: str) -> str:
    return _TRIM.format(value)


def _sql_entities(value: str) -> str:
    for old, new in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&apos;", "chr(39)"), ("&amp;", "'&'")):
        value = f"replace({value}, '{old}', {new})"
    return value


_LINES = r"""[l for l in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split_regex({0}, '\r?\n')] if l <> '']"""


@query(rf"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<figure[\s\S]*?</figure>', chr(10), 'gi'),
    '<br\s*/?>', chr(10), 'gi'), '<[^>]+>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, {_sql_entities("t")} AS t FROM a)
SELECT page_id, array_to_string({_LINES.format("t")}, '<br>') AS content FROM b""")
def q_html_to_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.html_to_text("html").alias("content"))


@query(rf"""
WITH a AS (SELECT doc_id, {_sql_trim("split_part(text, chr(10), 1)")} AS title, text, lang FROM documents),
b AS (SELECT doc_id, title, {_LINES.format("title || chr(10) || lang || chr(10) || text")} AS l, lang FROM a),
c AS (SELECT doc_id, l, list_position([x <> title AND x <> lang for x in l], true) AS p FROM b)
SELECT doc_id, CASE WHEN p IS NULL THEN '' ELSE array_to_string(l[p:], '<br>') END AS content FROM c""")
def q_body_text(spark, folder):
    title = X.trimmed(F.substring_index("text", "\n", 1))
    body = F.concat_ws("\n", title, "lang", "text")
    return table(spark, folder, "documents").select("doc_id", X.body_to_text(body, title, "lang").alias("content"))


@query(rf"""
SELECT page_id, {_sql_trim(r"regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')")} AS plain,
    length(regexp_replace(html, '<span\b[^>]*>|</span>', '', 'gi')) AS kept FROM pages""")
def q_strip_tags(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", X.strip_tags("html").alias("plain"), F.length(X.strip_highlight("html")).cast("long").alias("kept")
    )


_NAMED = "html"
for _old, _new in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&apos;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
    _NAMED = f"replace({_NAMED}, '{_old}', {_new})"


@query(rf"""
SELECT page_id, chr((33 + page_id % 90)::INT) || '-' || chr((945 + page_id % 24)::INT) || {_NAMED} AS decoded,
    replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '&amp;amp;', '&amp;'), '&amp;lt;', '&lt;'),
        '&amp;gt;', '&gt;'), '&amp;quot;', '&quot;'), '&amp;apos;', '&apos;') AS escaped FROM pages""")
def q_entities(spark, folder):
    built = F.concat(
        F.lit("&#"), (33 + F.col("page_id") % 90).cast("string"), F.lit(";-&#x"), F.hex(945 + F.col("page_id") % 24), F.lit(";"), "html"
    )
    return table(spark, folder, "pages").select(
        "page_id", X.decode_entities(built).alias("decoded"), X.escape_bare_amp("html").alias("escaped")
    )


@query(r"""
SELECT doc_id, regexp_replace(left(regexp_replace(regexp_replace(regexp_replace(split_part(text, chr(10), 1),
    '[/\\:*?"''<>|#%&{}\[\]`^~\s]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 40), '_+$', '') AS suffix FROM documents""")
def q_title_suffix(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.title_suffix(F.substring_index("text", "\n", 1)).alias("suffix")
    )


@query(r"""
SELECT doc_id, trim(regexp_extract(text, '\. ([A-Z][a-z]+ [a-z]+) (?:the|of|la|le) ', 1)) AS writer FROM documents""")
def q_regex_extract(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.byline_extract("text", r"\. ([A-Z][a-z]+ [a-z]+) (?:the|of|la|le) ").alias("writer")
    )


@query(r"""
WITH p AS (SELECT conv_id, turn, [x for x in [regexp_replace(regexp_replace(n, '\([^)]*\)', '', 'g'), '^\s+|\s+$', '', 'g')
    for n in string_split_regex(text, '[,;|/]+')] if x <> ''] AS names FROM conversations),
q AS (SELECT *, [n for n in names if regexp_matches(n, '[éèêç]')] AS accented FROM p)
SELECT conv_id, turn, array_to_string(names, ', ') AS people,
    (SELECT string_agg(n, ', ' ORDER BY i) FROM (SELECT n, min(i) AS i FROM (SELECT unnest(CASE WHEN len(accented) > 0 THEN accented ELSE names END) AS n,
        generate_subscripts(CASE WHEN len(accented) > 0 THEN accented ELSE names END, 1) AS i) GROUP BY n)) AS local FROM q""")
def q_authors(spark, folder):
    names = X.cleaned(F.transform(F.split("text", "[,;|/]+", -1), lambda n: F.regexp_replace(n, r"\([^)]*\)", "")))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.people("text").alias("people"),
        F.nullif(X.local_names(names, "[éèêç]"), F.lit("")).alias("local"),
    )


@query(rf"""
SELECT doc_id, {_sql_trim(r"regexp_replace(regexp_replace(regexp_replace(text, '\s*[\r\n]+\s*', ' <br> ', 'g'), '\t+', ' ', 'g'), ' {{2,}}', ' ', 'g')")} AS tidy,
    md5({_sql_trim(r"regexp_replace(text, '\s+', ' ', 'g')")}) AS one_line FROM documents""")
def q_text_cleanup(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", X.text_cleanup("text").alias("tidy"), F.md5(X.one_line("text")).alias("one_line")
    )


_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"


@query(rf"""
WITH u AS (SELECT page_id, url, {_ORIGIN} AS origin, {_PATH} AS path, regexp_extract(url, '#.*$') AS frag,
    CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) ELSE '' END AS query FROM pages)
SELECT page_id, origin, origin || path || (CASE WHEN query IN ('', 'ref=x') THEN '' ELSE '?' || replace(query, '&ref=x', '') END) || frag AS normal,
    CASE WHEN query LIKE 'page=%' THEN origin || path || '?page=3&ref=x' || frag END AS next_page,
    replace(replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '&', '%26'), '#', '%23') AS encoded,
    origin || regexp_extract(path, '^(.*/)', 1) || 'x/' || page_id || '.html?q=1' AS resolved,
    CASE WHEN contains(query, 'page=2') THEN origin || path || '?page=2&ref=x&pagerOffset=20' WHEN query <> '' THEN origin || path || '?' || query || '&pagerOffset=20'
        ELSE origin || path || '?pagerOffset=20' END || frag AS third_page
FROM u""")
def q_url(spark, folder):
    relative = F.concat(F.lit("./y/../x/"), F.col("page_id").cast("string"), F.lit(".html?q=1"))
    return table(spark, folder, "pages").select(
        "page_id",
        N.url_origin("url").alias("origin"),
        N.url_normalise("url", ("ref",)).alias("normal"),
        N.next_page_url("url").alias("next_page"),
        N.percent_encode("url").alias("encoded"),
        N.url_resolve(relative, "url").alias("resolved"),
        N.page_offset_url("url", F.lit(3)).alias("third_page"),
    )


@query("""
SELECT doc_id, left(md5(source || ':' || doc_id), 8) AS item_hash, left(md5(text), 12) AS url_key,
    CASE WHEN doc_id % 2 = 0 THEN 'D' || doc_id ELSE left(md5(split_part(text, chr(10), 1) || chr(10) || text), 16) END AS verdict_key FROM documents""")
def q_item_key(spark, folder):
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" D"), F.col("doc_id").cast("string")))
    return table(spark, folder, "documents").select(
        "doc_id",
        N.item_key(F.concat("source", F.lit(":"), F.col("doc_id").cast("string"))).alias("item_hash"),
        N.item_key("text", 12).alias("url_key"),
        N.verdict_key(own, F.substring_index("text", "\n", 1), "text").alias("verdict_key"),
    )


@query(r"""
SELECT page_id, regexp_replace(url, '://([a-z.-]+)\.example\.([a-z]+)/([a-z]+)/', '//\2/\1?lang=\3&n=') AS templated,
    'goView' AS call, page_id || '|a, b|' || regexp_extract(url, '[0-9]+') AS args FROM pages""")
def q_regex_template(spark, folder):
    onclick = F.concat(F.lit("javascript: goView("), F.col("page_id").cast("string"), F.lit(", 'a, b',"), F.regexp_extract("url", "[0-9]+", 0), F.lit(");"))
    return table(spark, folder, "pages").select(
        "page_id",
        N.regex_template("url", r"://([a-z.-]+)\.example\.([a-z]+)/([a-z]+)/", "//${2}/${1}?lang=${3}&n=").alias("templated"),
        N.call_name(onclick).alias("call"),
        F.array_join(N.call_args(onclick), "|").alias("args"),
    )


@query("""
WITH s AS (SELECT page_id, unnest([url, url || '&w', 'x.jpg']) AS url, unnest([NULL, (100 + page_id % 7)::BIGINT, NULL]) AS width,
    unnest([(1 + page_id % 3)::DOUBLE, NULL, NULL]) AS density FROM pages)
SELECT page_id, url, width, density FROM s""")
def q_srcset(spark, folder):
    text = F.concat(
        "url", F.lit(" "), (1 + F.col("page_id") % 3).cast("string"), F.lit("x, "), "url", F.lit("&w  "),
        (100 + F.col("page_id") % 7).cast("string"), F.lit("w,x.jpg"),
    )
    rows = table(spark, folder, "pages").select("page_id", N.srcset_parse(text).alias("s"))
    return rows.select("page_id", F.inline("s"))


@query(r"""
WITH p AS (SELECT page_id, url, regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\s+|\s+$', '', 'g') AS title,
    regexp_extract(url, '^[a-z]+://[^/]+[^?#]*/([^/?#]*)', 1) AS base FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'reporta' || page_id || '.pdf' WHEN 1 THEN 'f' || page_id || 'é.hwp'
    WHEN 2 THEN CASE WHEN contains(right(base, 5), '.') THEN base ELSE regexp_replace(title, '[\s,+/\\:*?"<>|]+', '_', 'g') || '.pdf' END
    ELSE 'link' || page_id || '.docx' END AS name FROM p""")
def q_filename(spark, folder):
    n = F.col("page_id").cast("string")
    kind = F.col("page_id") % 4
    header = (
        F.when(kind == 0, F.concat(F.lit("attachment; filename=\"x.bin\"; filename*=UTF-8''report%20a"), n, F.lit(".pdf")))
        .when(kind == 1, F.concat(F.lit('attachment; filename="f'), n, F.lit('%C3%A9.hwp"')))
        .otherwise("inline")
    )
    link = F.when(kind == 3, F.concat(F.lit(" link "), n, F.lit(".docx "))).otherwise("download")
    title = X.trimmed(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    url = F.regexp_replace("url", r"\?[^#]*", "")
    return table(spark, folder, "pages").select("page_id", A.filename_resolve(header, link, url, title).alias("name"))


_SHAPES = ("yyyy-MM-dd", "yyyyMMdd", "yyyy.MM.dd", "yyyy/M/d", "yyyy-MM-dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy'년' M'월' d'일'", "d MMM yyyy")


@query("""
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS k, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate AS d FROM orders)
SELECT o_orderkey, CASE WHEN k < 7 THEN day || ' 00:00:00' END AS article_date,
    CASE WHEN k IN (0, 2, 4, 5) THEN replace(day, '-', '') END AS listed,
    CASE WHEN k IN (0, 2) THEN replace(day, '-', '') WHEN k = 4 OR k = 5 THEN replace(day, '-', '') END AS legacy,
    CASE WHEN k = 7 THEN '' ELSE day[:4] END AS year,
    strftime(d + INTERVAL 10 HOUR, '%Y-%m-%d %H:%M:%S') AS published,
    day || ' 09:07:05' AS sent, replace(day, '-', '') || '09' AS weather, day AS from_name FROM o""")
def q_dates(spark, folder):
    k, date = F.col("o_orderkey") % 8, F.col("o_orderdate")
    printed = F
    for n, shape in enumerate(_SHAPES[:-1]):
        printed = printed.when(k == n, F.date_format(date, shape))
    printed = printed.otherwise(F.date_format(date, _SHAPES[-1]))
    compact = F.date_format(date, "yyyyMMdd")
    rfc = F.concat(F.date_format(date, "E, d MMM yyyy"), F.lit(" 01:00:00 +0000"))
    spoken = F.concat(F.date_format(date, "yyyy'년' M'월' d'일'"), F.lit(" (월) 요일 9시"))
    rows = table(spark, folder, "orders").select("o_orderkey", printed.alias("p"), compact.alias("c"), rfc.alias("r"), spoken.alias("s"))
    return rows.select(
        "o_orderkey",
        D.article_date("p").alias("article_date"),
        D.listed_date("p").alias("listed"),
        D.legacy_date("p").alias("legacy"),
        D.year_of("p", anchored=True).alias("year"),
        D.rfc822_to_zone("r").alias("published"),
        D.send_datetime("c", F.lit("90705")).alias("sent"),
        D.korean_datetime("s", 2026).alias("weather"),
        D.day_from_name(F.concat(F.lit("AKR"), "c", F.lit("0001.xml"))).alias("from_name"),
    )


@query("""
SELECT o_orderkey, o_orderdate::DATE >= DATE '2001-06-15' - INTERVAL 7 DAY AS week, year(o_orderdate) = 2001 AS this_year,
    year(o_orderdate) >= 2000 AS since_last_year FROM orders
WHERE o_orderdate::DATE >= DATE '2001-06-15' - INTERVAL 7 DAY OR year(o_orderdate) >= 2000""")
def q_refresh_window(spark, folder):
    as_of = F.lit("2001-06-15").cast("date")
    rows = table(spark, folder, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    flags = rows.select(
        "o_orderkey",
        D.last_days("o_orderdate", as_of).alias("week"),
        D.this_year("y", as_of).alias("this_year"),
        D.since_last_year("y", as_of).alias("since_last_year"),
    )
    return flags.where("week or since_last_year")


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{9,}')) AS token,
    generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{9,}'), 1) - 1 AS pos FROM documents)
SELECT token, min((doc_id, pos)).doc_id AS doc_id FROM (SELECT token, {'doc_id': doc_id, 'pos': pos} AS p, doc_id, pos FROM t) GROUP BY token""".replace(
    "min((doc_id, pos)).doc_id", "min(p).doc_id"))
def q_token_extract(spark, folder):
    lines = table(spark, folder, "documents").select("doc_id", "text")
    found = register_numbers(lines, "doc_id", "text", "[A-Z][a-z]{9,}")
    return found.select(F.col("register_no").alias("token"), "seq.doc_id")


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS total, event_type AS name,
    event_type || ', ' || user_id AS people, 't' || json_extract_string(props, '$.k') AS title,
    event_type || ', [{' || user_id || '}], "q" & <x> y, 7' AS deep FROM events""")
def q_alias_pick(spark, folder):
    record = F.concat(
        F.lit('{"Total_Count": '), F.get_json_object("props", "$.k"), F.lit(', "count": null, "Entry-Name": " '), "event_type",
        F.lit('", "headword": " ", "authors": ["'), "event_type", F.lit('", {"x": 1, "name": "<b>'), F.col("user_id").cast("string"),
        F.lit('</b>"}], "term": {"en": "e", "kr": "t'), F.get_json_object("props", "$.k"),
        # five levels, brackets and quotes inside texts, an empty preferred key on the way
        F.lit('"}, "Body-Text": {"a": [[{"ko": {"value": ["'), "event_type", F.lit('"]}}, [{"name": " ", "b": {"c": [["[{'), F.col("user_id").cast("string"),
        F.lit('}]"]]}}]], {"text": {"x": "\\"q\\" &amp;  &lt;x&gt; <i>y</i>", "z": []}}, 7], "d": {}}}'),
    )
    # the flattened entries are computed once and read by four picks
    rows = spread(table(spark, folder, "events").select("event_id", "event_type", "user_id", "props"))
    rows = rows.select("event_id", A.record_texts(record).alias("e"))
    e = F.col("e")
    return rows.select(
        "event_id",
        A.alias_pick(e, ("count", "totalCount")).alias("total"),
        A.alias_pick(e, ("headword", "entryName")).alias("name"),
        A.alias_pick(e, ("writer", "Authors")).alias("people"),
        A.alias_pick(e, ("headword", "term")).alias("title"),
        A.alias_pick(e, ("bodyText",)).alias("deep"),
    )


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS inner_value, event_type AS kind, NULL::VARCHAR AS missing FROM events""")
def q_json_path(spark, folder):
    body = F.concat(F.lit('{"a": {"b": '), "props", F.lit(', "t": "'), "event_type", F.lit('"}}'))
    return table(spark, folder, "events").select(
        "event_id",
        A.json_path(body, "a.b.k").alias("inner_value"),
        A.json_path(body, "a.t").alias("kind"),
        A.json_path(body, "a.x.y").alias("missing"),
    )


@query("""
SELECT doc_id, split_part(text, chr(10), 1) AS title, md5(text) AS digest, 2 AS keywords FROM documents WHERE lang <> 'es'""")
def q_meta_scan(spark, folder):
    """Documents as stored meta texts; those of one language are cut off and must be left out."""
    docs = table(spark, folder, "documents").select(
        "doc_id",
        F.to_json(F.struct(
            F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"),
            F.array(F.lit("a"), F.lit("b")).alias("matchedKeywords"), F.col("lang").alias("unknown"),
        )).alias("body"),
        "lang",
    )
    cut = F.when(F.col("lang") == "es", F.concat(F.lit('{"title": "x", "content": '), F.substring("body", 1, 20))).otherwise(F.col("body"))
    metas = readable(parse_metas(docs.select("doc_id", cut.alias("body")), "body", ARTICLE_META))
    return metas.select("doc_id", "title", F.md5("content").alias("digest"), F.size("matchedKeywords").alias("keywords"))


# ---- files and pictures -----------------------------------------------------

_KINDS = ("jpg", "pdf", "do", "hwp", "PNG", "zipx", "csv")


def _stored_path():
    ext = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("page_id") % 7 + 1).cast("int"))
    tail = F.when(F.col("page_id") % 4 == 0, "?x=1.doc").otherwise("")
    return F.concat(F.lit("s3://bucket/a/"), F.col("page_id").cast("string"), F.lit("."), ext, tail)


@query("""
WITH p AS (SELECT page_id, lower((['jpg', 'pdf', 'do', 'hwp', 'PNG', 'zipx', 'csv'])[page_id % 7 + 1]) AS ext FROM pages)
SELECT page_id, CASE WHEN ext IN ('jpg', 'png') THEN 'image' WHEN ext IN ('pdf', 'hwp', 'csv') THEN 'file' END AS kind,
    CASE ext WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'pdf' THEN 'application/pdf' WHEN 'csv' THEN 'text/csv'
        ELSE 'application/octet-stream' END AS mime,
    CASE WHEN ext = 'do' THEN 'script' WHEN page_id % 5 = 0 THEN 'no extension' END AS problem FROM p""")
def q_file_kind(spark, folder):
    ext = A.extension(_stored_path())
    name = F.when((F.col("page_id") % 5 == 0) & (ext != "do"), "noext").otherwise(F.concat(F.lit("n."), ext))
    return table(spark, folder, "pages").select(
        "page_id", A.file_kind(_stored_path()).alias("kind"), A.mime_type(_stored_path()).alias("mime"), A.attachment_problem(name).alias("problem")
    )


@query("""
WITH p AS (SELECT page_id, 'PYH' || page_id AS b FROM pages),
u AS (SELECT page_id, 0 AS pos, 'https://img1.yna.co.kr/a/' || b || '_P4.jpg' AS url FROM p
    UNION ALL SELECT page_id, 1, 'https://h.example/' || b || '_b.JPG?x' FROM p
    UNION ALL SELECT page_id, 2, 'https://h.example/t/' || b || '_c_P1.jpg' FROM p WHERE page_id % 2 = 1)
SELECT page_id, pos::BIGINT AS pos, url FROM u""")
def q_image_urls(spark, folder):
    b = F.concat(F.lit("PYH"), F.col("page_id").cast("string"))
    inline = F.array(
        F.concat(F.lit("http://img.yna.co.kr/a/"), b, F.lit("_P4.jpg")),
        F.concat(F.lit("http://img.yna.co.kr/a/"), b, F.lit("_P2.jpg")),
        F.lit("data:image/png;base64,AA"),
        F.concat(F.lit("https://h.example/"), b, F.lit("_b.JPG?x")),
        F.concat(F.lit("https://h.example/"), b, F.lit(".svg")),
    )
    enclosure = F.when(F.col("page_id") % 2 == 1, F.concat(F.lit("https://h.example/t/"), b, F.lit("_c_P1.jpg"))).otherwise(
        F.concat(F.lit("http://img.yna.co.kr/a/"), b, F.lit("_P1.jpg"))
    )
    kept = F.filter(merge_images(inline, enclosure), N.image_url_allowed)
    rows = table(spark, folder, "pages").select("page_id", F.posexplode(F.transform(kept, lambda u: N.image_url_fix(u))).alias("pos", "url"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS hrefs FROM pages),
l AS (SELECT page_id, unnest(hrefs) AS href, generate_subscripts(hrefs, 1) AS i FROM h),
f AS (SELECT page_id, i, (CASE WHEN starts_with(href, '/') THEN href ELSE '/' || href END) || CASE i % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.pdf' ELSE '.do' END AS path FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS n FROM f WHERE i % 3 <> 2)
SELECT page_id, n::BIGINT AS sort_order, path AS file_path, CASE i % 3 WHEN 0 THEN 'image' ELSE 'file' END AS file_ty,
    CASE i % 3 WHEN 0 THEN 'image/png' ELSE 'application/pdf' END AS mime_type,
    regexp_extract(split_part(path, '?', 1), '[^/]*$') AS file_name,
    '/scraper/media?path=' || replace(replace(replace(replace(replace(url_encode(path), '%21', '!'), '%27', chr(39)), '%28', '('), '%29', ')'), '%2A', '*') AS download_url FROM k""")
def q_file_rows(spark, folder):
    """Links as stored files: accepted ones keep their order inside the page's list."""
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    ext = lambda i: F.when((i + 1) % 3 == 0, ".png").when((i + 1) % 3 == 1, ".pdf").otherwise(".do")
    items = F.transform(
        hrefs,
        lambda h, i: F.struct(
            F.concat(F.lit("s3://bucket"), F.when(F.startswith(h, F.lit("/")), h).otherwise(F.concat(F.lit("/"), h)), ext(i)).alias("s3Path"),
            h.alias("url"),
            F.lit("").alias("originalName"),
        ),
    )
    rows = table(spark, folder, "pages").select("page_id", F.inline(file_rows(items, name_field=True)))
    return rows.select("page_id", F.col("sort_order").cast("long").alias("sort_order"), "file_path", "file_ty", "mime_type", "file_name", "download_url")


@query(rf"""
WITH k AS (SELECT page_id, regexp_replace({_PATH}, '^/+', '') AS key FROM pages)
SELECT page_id, key, CASE WHEN key = '' THEN 'empty' WHEN NOT contains(key, '/') THEN 'one segment'
    WHEN regexp_matches(key, '(^|/)\.{{0,2}}(/|$)') THEN 'bad segment' WHEN split_part(key, '/', 1) NOT IN ('en', 'fr') THEN 'prefix' END AS problem,
    starts_with(key, 'en/') AS readable, '/' || key AS object_path FROM k""")
def q_key_manifest(spark, folder):
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    rows = table(spark, folder, "pages").select("page_id", path.alias("path"))
    return rows.select(
        "page_id",
        N.clean_key("path").alias("key"),
        N.object_key_problem("path", ("en", "fr")).alias("problem"),
        N.readable_key("path", "en/").alias("readable"),
        N.object_path(F.concat(F.lit("s3://bucket/"), N.clean_key("path"))).alias("object_path"),
    )


@query("""
WITH p AS (SELECT p_partkey, lpad(p_partkey::VARCHAR, 9, '0') || (['X', '7', '1234', 'y', ''])[p_size % 5 + 1] AS isbn FROM part)
SELECT p_partkey, isbn, regexp_full_match(isbn, '[0-9]{9}[0-9Xx]|[0-9]{13}') AS valid FROM p""")
def q_isbn(spark, folder):
    tail = F.element_at(F.array(*[F.lit(t) for t in ("X", "7", "1234", "y", "")]), (F.col("p_size") % 5 + 1).cast("int"))
    rows = table(spark, folder, "part").select("p_partkey", F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), tail).alias("isbn"))
    return rows.select("p_partkey", "isbn", A.isbn_valid("isbn").alias("valid"))


# ---- pages ------------------------------------------------------------------

_RECIPE = """[{"name": "title", "type": "uniqueText", "selector": "title"},
 {"name": "head", "type": "uniqueText", "selector": "article h1"},
 {"name": "menu", "type": "list", "selector": "nav li"}]"""


def _charrefs(value: str) -> str:
    for name, code in (("copy", 169), ("middot", 183), ("lt", 60), ("gt", 62), ("quot", 34), ("nbsp", 160), ("amp", 38)):
        value = f"replace({value}, '&{name};', chr({code}))"
    return value


@query(rf"""
WITH t AS (SELECT page_id, {_charrefs("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title,
    {_charrefs("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS head FROM pages)
SELECT page_id, {_sql_trim(r"regexp_replace(title, '\s+', ' ', 'g')")} AS title, {_sql_trim(r"regexp_replace(head, '\s+', ' ', 'g')")} AS head FROM t
WHERE {_sql_trim("title")} <> ''""")
def q_page_fields(spark, folder):
    """Recipe targets of each page's host; one recipe per host of the pages."""
    pages = page_captures(spark, f"{folder}/pages.parquet")
    recipes = pages.select("host").distinct().select(F.xxhash64("host").alias("recipe_id"), "host", F.lit(_RECIPE).alias("targets"))
    got = E.with_title(E.extract_fields(pages, recipes))
    return got.select("page_id", F.col("fields")["title"].alias("title"), F.col("fields")["head"].alias("head"))


@query(None)
def q_page_text(spark, folder):
    pages = table(spark, folder, "pages")
    seen = E.page_text(pages, "body", visible_only=True)
    full = E.page_text(pages, "body", visible_only=False).withColumnRenamed("text", "full_text")
    return seen.join(full, "page_id").select("page_id", X.text_cleanup("text").alias("text"), F.length("full_text").alias("full_length"))


@query(None)
def q_page_clean(spark, folder):
    return E.page_clean(table(spark, folder, "pages"))


@query(r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS hrefs FROM pages)
SELECT page_id, unnest(hrefs) AS href, (generate_subscripts(hrefs, 1) - 1)::BIGINT AS pos FROM h""")
def q_page_links(spark, folder):
    return E.page_links(table(spark, folder, "pages")).select("page_id", "href", F.col("pos").cast("long").alias("pos"))


@query(r"""
WITH n AS (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages),
h AS (SELECT page_id, regexp_extract_all(nav, '<li><a href="([^"]*)"', 1) AS hrefs FROM n)
SELECT page_id, unnest(hrefs) AS href, (generate_subscripts(hrefs, 1) - 1)::BIGINT AS pos FROM h""")
def q_selected_links(spark, folder):
    links = E.selected_links(table(spark, folder, "pages"), "nav li")
    return links.select("page_id", "href", F.col("pos").cast("long").alias("pos"))
