"""Six bibliographic services to one record shape.

Input is a table of captured responses (schemas.CAPTURE): one row per page of a
request.  Each service reads a page once and gives one frame of records and
problems: a bad envelope becomes a row with a message instead of silent nulls,
with the whole reply unless ``error_chars`` asks for its start.  ``split`` parts
the frame into items and errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill import schemas as S
from gleanmill.functions.dates import year_of
from gleanmill.functions.text import (
    blank_to_null,
    cleaned,
    decode_entities,
    drop_affiliation,
    escape_bare_amp,
    local_names,
    people,
    relist,
    strip_highlight,
    strip_tags,
    text_of,
    trimmed,
    volume_label,
)
from gleanmill.functions.urls import riss_id
from gleanmill.functions.values import alias_pick, coded, json_entries, member, pick_by_lang, record_texts
from gleanmill.operators.once import evaluated_once
from gleanmill.rules.cascades import article_or_thesis
from gleanmill.session import cut_lineage

KEEP = ["request_no", "page", "kind", "keyword"]


def _captures(captures: DataFrame, source: str) -> DataFrame:
    return captures.where(F.col("source") == source)


def _seq(pos: str = "pos") -> Column:
    return F.struct("request_no", "page", F.col(pos).alias("pos"))


def _shown(body: Column | str, most: int | None) -> Column:
    """The reply an error row quotes: all of it, or its first characters."""
    whole = F.col(body) if isinstance(body, str) else body
    return whole if most is None else F.left(whole, F.lit(most))


def _bib(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    """Project onto the common record, fields not given being null; a problem has its message alone."""
    known = F.col("message").isNull()
    made = {"source": F.lit(source), "matched_keyword": F.col("keyword"), "seq": _seq(), **{k: F.when(known, v) for k, v in fields.items()}}
    own = [made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in S.BIB_FIELDS.items()]
    return rows.select(*KEEP, "message", *own).where("message IS NOT NULL OR title <> '' AND source_id <> ''")


def _records(parsed: DataFrame, problem: Column, records: Column) -> DataFrame:
    """A row per record of a good page, one row per page with a problem.

    The whole reply is judged once, not once for each of its records.
    """
    judged = evaluated_once(parsed, "_problem", problem)
    found = F.col("_problem").isNull()
    opened = judged.select(*KEEP, F.col("_problem").alias("message"), F.posexplode_outer(F.when(found, records)).alias("pos", "r"))
    return opened.where("message IS NOT NULL OR r IS NOT NULL")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and errors of what the services read."""
    items = rows.where("message IS NULL").select(*S.BIB_FIELDS)
    return items, rows.where("message IS NOT NULL").select("source", *KEEP, "message")


def _root(body: Column, tag: str) -> Column:
    """An XML response has the expected root; parsing would only give nulls."""
    return body.rlike(rf"(?s)^\s*(?:<\?xml.*?\?>\s*)?<{tag}[\s>]") & body.rlike(rf"(?s)</{tag}\s*>\s*\z")


# ---- the six services -------------------------------------------------------

def kci(captures: DataFrame, error_chars: int | None = None) -> DataFrame:
    # the root element is not part of the schema
    parsed = evaluated_once(_captures(captures, "kci"), "x", F.from_xml("body", S.KCI_RESPONSE))
    good = _root(F.col("body"), "MetaData") & F.col("x.outputData").isNotNull()
    problem = F.when(~F.coalesce(good, F.lit(False)), F.concat(F.lit("outputData missing: "), _shown(strip_tags("body"), error_chars)))
    rows = _records(parsed, problem, F.col("x.outputData.record"))
    info, journal = F.col("r.articleInfo"), F.col("r.journalInfo")
    titles, abstracts = info["title-group"]["article-title"], info["abstract-group"]["abstract"]
    authors = info["author-group"]["author"]
    names = cleaned(F.transform(authors, lambda a: F.coalesce(a["_VALUE"], F.lit(""))))
    english = cleaned(F.transform(authors, lambda a: F.coalesce(a["_english"], F.lit(""))))
    return _bib(
        rows, "kci",
        source_id=trimmed(info["_article-id"]),
        title=pick_by_lang(titles, "original"),
        publisher=trimmed(journal["publisher-name"]),
        author=F.coalesce(F.array_join(F.transform(names, drop_affiliation), ", "), F.lit("")),
        publish_year=trimmed(journal["pub-year"]),
        category=blank_to_null(info["article-categories"]),
        sub_category=volume_label(journal["journal-name"], journal["volume"], journal["issue"]),
        summary=blank_to_null(pick_by_lang(abstracts, "original")),
        detail_url=blank_to_null(info["url"]),
        material_type=F.lit("article"),
        title_en=blank_to_null(pick_by_lang(titles, "english")),
        summary_en=blank_to_null(pick_by_lang(abstracts, "english")),
        author_en=blank_to_null(F.array_join(english, ", ")),
    )


def riss(captures: DataFrame, error_chars: int | None = None) -> DataFrame:
    parsed = evaluated_once(_captures(captures, "riss"), "x", F.from_xml("body", S.RISS_RESPONSE))
    has_head = _root(F.col("body"), "record") & F.col("x.head").isNotNull()
    code = F.coalesce("x.head.Error", F.lit("0"))
    problem = F.when(
        ~F.coalesce(has_head, F.lit(False)), F.concat(F.lit("head missing: "), _shown("body", error_chars))
    ).when(code != "0", F.concat(F.lit("["), code, F.lit("]: "), text_of("x.head.ErrorMessage")))
    rows = _records(parsed, problem, F.col("x.metadata"))
    r = lambda name: F.col("r")[name]
    url = trimmed(r("url"))
    own_id = riss_id(url)
    kinds = F.when(F.col("kind") == "T", "thesis").when(F.col("kind") == "U", "book").otherwise("article")
    return _bib(
        rows, "riss",
        source_id=F.when(url == "", "").when(own_id != "", own_id).otherwise(F.left(F.md5(url), F.lit(12))),
        title=trimmed(r("riss.title")),
        publisher=trimmed(r("riss.publisher")),
        author=relist(r("riss.author"), r"\|"),
        publish_year=year_of(trimmed(r("riss.pubdate")), anchored=True),
        sub_category=volume_label(r("riss.stitle"), r("riss.vol"), r("riss.no"), ("0", "-")),
        detail_url=url,
        isbn=blank_to_null(r("riss.isbn")),
        material_type=kinds,
    )


def ntis(captures: DataFrame, error_chars: int | None = None) -> DataFrame:
    repaired = strip_highlight(escape_bare_amp("body"))
    parsed = evaluated_once(evaluated_once(_captures(captures, "ntis"), "xml", repaired), "x", F.from_xml("xml", S.NTIS_RESPONSE))
    is_result = _root(F.col("xml"), "RESULT")
    parsed_any = F.coalesce("x.TOTALHITS", "x.resMsg").isNotNull() | F.col("x.RESULTSET").isNotNull()
    problem = (
        F.when(_root(F.col("xml"), "error"), F.concat(F.lit("error reply: "), strip_tags("xml")))
        .when(~is_result | ~F.coalesce(parsed_any, F.lit(False)), F.concat(F.lit("bad reply: "), _shown("body", error_chars)))
        .when(text_of("x.resMsg") != "", F.concat(F.lit("error reply: "), F.col("x.resMsg")))
    )
    rows = _records(parsed, problem, F.col("x.RESULTSET.HIT"))
    r = lambda name: F.col("r")[name]
    # the fields are read more than once, by the filter on blank records and by tests for blanks, too
    fields = {
        **{name: r(name) for name in (
            "ResearchPublicNo", "TermSn", "PublicationAgency", "Manager", "ManagerName", "PublicationYear", "PublicationYm", "DocUrl",
        )},
        "keyword": r("Keyword")["Korean"], "title": r("ResultTitle")["Korean"], "title_en": r("ResultTitle")["English"],
        "summary": r("Abstract")["Korean"], "summary_en": r("Abstract")["English"],
    }
    rows = evaluated_once(rows, "_p", F.struct(*[strip_tags(field).alias(name) for name, field in fields.items()]))
    p = lambda name: F.col("_p")[name]
    either = lambda a, b: F.when(p(a) != "", p(a)).otherwise(p(b))
    return _bib(
        rows, "ntis",
        source_id=either("ResearchPublicNo", "TermSn"),
        title=p("title"),
        publisher=p("PublicationAgency"),
        author=either("Manager", "ManagerName"),
        publish_year=year_of(either("PublicationYear", "PublicationYm"), anchored=True),
        category=F.lit("연구보고서"),
        sub_category=blank_to_null(relist(p("keyword"), ";")),
        summary=blank_to_null(p("summary")),
        detail_url=blank_to_null(p("DocUrl")),
        material_type=F.lit("report"),
        title_en=blank_to_null(p("title_en")),
        summary_en=blank_to_null(p("summary_en")),
    )


def losi(captures: DataFrame, error_chars: int | None = None, keywords: int | None = None) -> DataFrame:
    """JSON whose ``result`` may be an object or a list; ``keywords`` limits those that stand for a missing journal."""
    body = F.col("body")
    wrap = F.coalesce(
        F.get_json_object(body, "$.result[0]"), F.get_json_object(body, "$.result"), body
    )
    parsed = evaluated_once(_captures(captures, "losi"), "w", F.when(F.try_parse_json("body").isNotNull(), wrap))
    error = F.coalesce(F.get_json_object("w", "$.error"), F.get_json_object("body", "$.error"))
    first = F.coalesce(F.get_json_object(error, "$[0]"), error)
    problem = F.when(F.col("w").isNull(), F.concat(F.lit("bad reply: "), _shown("body", error_chars))).when(
        error.isNotNull(),
        F.concat(
            F.lit("["), text_of(F.get_json_object(first, "$.code")), F.lit("]: "),
            F.coalesce(F.get_json_object(first, "$.message"), _shown(error, error_chars)),
        ),
    )
    listed = F.from_json(F.get_json_object("w", "$.searchList"), S.LOSI_LIST)
    rows = _records(parsed, problem, listed)
    r = lambda name: F.col("r")[name]
    plain = lambda c: trimmed(decode_entities(c))
    names = cleaned(F.transform(r("authorList"), lambda a: decode_entities(a["name"])))
    words = cleaned(F.transform(r("keywordList"), lambda k: decode_entities(k["name"])))
    kinds = F.when(F.col("kind") == "THESIS", "thesis").when(F.col("kind") == "BOOK", "book").otherwise("article")
    return _bib(
        rows, "losi",
        source_id=trimmed(r("lodID")),
        title=plain(r("title")),
        publisher=plain(r("publisher")),
        author=F.coalesce(local_names(names), F.lit("")),
        publish_year=year_of(r("pubYear")),
        sub_category=F.coalesce(
            F.nullif(plain(r("journal")["title"]), F.lit("")), blank_to_null(F.array_join(words if keywords is None else F.slice(words, 1, keywords), ", "))
        ),
        summary=blank_to_null(r("abstractCont")),
        detail_url=blank_to_null(r("url")),
        material_type=kinds,
    )


def kisti(captures: DataFrame, error_chars: int | None = None) -> DataFrame:
    parsed = evaluated_once(_captures(captures, "kisti"), "x", F.from_xml("body", S.KISTI_RESPONSE))
    good = _root(F.col("body"), "MetaData") & (
        F.col("x.resultSummary").isNotNull() | F.col("x.recordList").isNotNull() | F.col("x.errorDetail").isNotNull()
    )
    code = F.col("x.errorDetail.errorCode")
    problem = F.when(
        ~F.coalesce(good, F.lit(False)), F.concat(F.lit("MetaData missing: "), _shown("body", error_chars))
    ).when(text_of(code) != "", F.concat(F.lit("["), code, F.lit("]: "), text_of("x.errorDetail.errorMessage")))
    rows = _records(parsed, problem, F.col("x.recordList.record"))
    f = lambda name: coded(F.col("r")["item"], name)
    or_else = lambda a, b: F.coalesce(F.nullif(f(a), F.lit("")), F.nullif(f(b), F.lit("")))
    optional = lambda name: F.nullif(f(name), F.lit(""))
    return _bib(
        rows, "kisti",
        source_id=f("CN"),
        title=f("Title"),
        publisher=F.coalesce(or_else("Publisher", "JournalName"), F.lit("")),
        author=f("Author"),
        publish_year=year_of(F.concat(f("Pubyear"), F.lit(" "), f("Pubdate"))),
        sub_category=or_else("JournalName", "Keyword"),
        summary=optional("Abstract"),
        detail_url=or_else("ContentURL", "FulltextURL"),
        isbn=optional("ISBN"),
        material_type=article_or_thesis("kind", f("DBCode"), f("CN"), f("Degree")),
        title_en=optional("Title2"),
        summary_en=optional("Abstract2"),
        author_en=optional("Author2"),
    )


# Names under which the encyclopedia may answer.
ENCY_PUBLISHER = "한국학중앙연구원"
ENCY_ORIGIN = "https://encykorea.aks.ac.kr"
WRAPPERS = ("data", "result", "response")
LIST_KEYS = ("items", "articles", "results", "list", "rows", "records", "contents", "articleList", "searchList")
TOTAL_KEYS = ("totalCount", "totalcount", "total", "count", "totalItems", "totalElements", "recordCount", "전체건수")
EID_KEYS = ("eid", "EID", "id", "articleId", "articleID", "entryId", "sourceId")
URL_KEYS = ("url", "link", "detailUrl", "articleUrl")
TITLE_KEYS = (
    "title", "titleKo", "titleKr", "headword", "entryName", "articleName", "name", "subject", "label", "hname", "term", "표제어",
)
AUTHOR_KEYS = ("writer", "writerName", "author", "authorName", "authors", "contributor", "contributors", "집필자")
DIGEST_KEYS = ("summary", "contentSummary", "contentsSummary", "contentSummaryText", "요약", "내용요약")
SUMMARY_KEYS = DIGEST_KEYS + (
    "definition", "abstract", "description", "desc", "content", "body", "text", "articleBody", "explanation", "정의",
)
FIELD_KEYS = ("field", "fieldName", "category", "categoryName", "mainCategory", "classification", "분야")
TYPE_KEYS = ("type", "typeName", "articleType", "kind", "유형")
NATURE_KEYS = ("nature", "character", "property", "성격")
YEAR_KEYS = (
    "publishYear", "pubYear", "year", "writeYear", "createdYear", "lastModified", "modifiedDate", "updateDate", "revisionDate",
)
ARTICLE_WRAPPERS = ("article", "item", "record", "detail", "content", "data", "result")


def _unwrap(body: Column) -> Column:
    return F.coalesce(*[F.get_json_object(body, f"$.{key}") for key in WRAPPERS], body)


def ency_article(body: Column) -> Column:
    """The object of a detail reply: first of a list, a known wrapper, or the reply itself."""
    wrapped = [
        F.when(F.startswith(inner, F.lit("{")), inner)
        for inner in (F.get_json_object(body, f"$.{key}") for key in ARTICLE_WRAPPERS)
    ]
    return F.coalesce(F.get_json_object(body, "$[0]"), *wrapped, body)


def ency_records(payload: Column) -> Column:
    """Record list of a payload: a list itself, a known key, or the first list inside."""
    as_list = lambda c: F.when(F.startswith(F.ltrim(c), F.lit("[")), F.from_json(c, "array<string>"))
    members = F.from_json(payload, "map<string,string>")
    any_list = F.try_element_at(
        F.filter(F.map_values(members), lambda v: F.startswith(v, F.lit("[")) & F.from_json(v, "array<string>").isNotNull()),
        F.lit(1),
    )
    named = [as_list(F.get_json_object(payload, f"$.{key}")) for key in LIST_KEYS]
    return F.coalesce(as_list(payload), *named, F.from_json(any_list, "array<string>"))


def ency_total(payload: Column) -> Column:
    entries = json_entries(payload)
    return member(entries, TOTAL_KEYS).try_cast("long")


def ency_eid(entries: Column) -> Column:
    own = F.upper(F.regexp_extract(alias_pick(entries, EID_KEYS), r"(?i)E\d{7}", 0))
    by_url = F.upper(F.regexp_extract(alias_pick(entries, URL_KEYS), r"(?i)/Article/(E\d{7})", 1))
    return F.when(own != "", own).otherwise(by_url)


def encykorea(captures: DataFrame, details: DataFrame | None = None, error_chars: int | None = None) -> DataFrame:
    """Schema-tolerant JSON; ``details`` (eid, body) overlays list rows that need it."""
    parsed = evaluated_once(
        _captures(captures, "encykorea"), "payload", F.when(F.try_parse_json("body").isNotNull(), _unwrap(F.col("body")))
    )
    problem = F.when(F.col("payload").isNull(), F.concat(F.lit("bad reply: "), _shown("body", error_chars)))
    rows = _records(parsed, problem, ency_records(F.col("payload")))
    rows = evaluated_once(rows.select(*KEEP, "message", "pos", record_texts("r").alias("_e")), "e", F.col("_e")).withColumn("eid", ency_eid(F.col("e")))
    if details is not None:
        wanted = evaluated_once(details, "_d", record_texts(ency_article(F.col("body")))).select(
            F.upper("eid").alias("eid"), "_d"
        )
        late = F.coalesce("_d", F.array().cast("array<struct<k:string,nk:string,v:string>>"))
        kept = F.filter("e", lambda x: ~F.exists(late, lambda y: y["k"] == x["k"]))
        overlaid = F.when(needs_detail(F.col("e")), F.concat(kept, late)).otherwise(F.col("e"))
        joined = rows.join(wanted, "eid", "left")
        rows = evaluated_once(joined, "_o", overlaid).withColumn("e", F.col("_o"))
    e = F.col("e")
    # the picks are read more than once, by the filter on blank records, too
    keys = {
        "url": URL_KEYS, "title": TITLE_KEYS, "author": AUTHOR_KEYS, "year": YEAR_KEYS, "field": FIELD_KEYS, "type": TYPE_KEYS,
        "nature": NATURE_KEYS, "summary": SUMMARY_KEYS,
    }
    picks = F.struct(F.col("eid"), *[alias_pick(e, names).alias(pick) for pick, names in keys.items()])
    rows = evaluated_once(rows, "_p", picks)
    p = lambda pick: F.col("_p")[pick]
    return _bib(
        rows, "encykorea",
        source_id=p("eid"),
        title=p("title"),
        publisher=F.lit(ENCY_PUBLISHER),
        author=people(p("author")),
        publish_year=year_of(p("year")),
        category=blank_to_null(p("field")),
        sub_category=blank_to_null(F.array_join(F.filter(F.array(p("type"), p("nature")), lambda t: t != ""), " / ")),
        summary=blank_to_null(p("summary")),
        detail_url=F.when(p("url") != "", p("url")).otherwise(F.concat(F.lit(ENCY_ORIGIN + "/Article/"), p("eid"))),
        material_type=F.lit("article"),
    )


def needs_detail(entries: Column) -> Column:
    """The list row lacks a summary of its own, an author, a field or a year."""
    return (
        (alias_pick(entries, DIGEST_KEYS) == "")
        | (people(alias_pick(entries, AUTHOR_KEYS)) == "")
        | (alias_pick(entries, FIELD_KEYS) == "")
        | (year_of(alias_pick(entries, YEAR_KEYS)) == "")
    )


SERVICES = {"kci": kci, "riss": riss, "ntis": ntis, "losi": losi, "kisti": kisti, "encykorea": encykorea}


def harvest_rows(captures: DataFrame, sources: tuple[str, ...] = tuple(SERVICES), error_chars: int | None = None) -> DataFrame:
    """What all services read, records and problems in one frame."""
    rows = None
    for source in sources:
        read = SERVICES[source](captures, error_chars=error_chars)
        rows = read if rows is None else rows.unionByName(read)
    return rows


def harvest(captures: DataFrame, sources: tuple[str, ...] = tuple(SERVICES)) -> tuple[DataFrame, DataFrame]:
    """All services in one record frame, and their errors in one error frame; replies are parsed once for both."""
    return split(cut_lineage(harvest_rows(captures, sources)))


def reported_totals(captures: DataFrame) -> DataFrame:
    """Total each page of a response claims: source, request_no, page, total."""
    body = F.col("body")
    number = lambda tag: F.regexp_extract(body, rf"<{tag}>\s*(\d+)\s*</{tag}>", 1).try_cast("long")
    total = (
        F.when(F.col("source") == "kci", number("total"))
        .when(F.col("source") == "riss", number("totalcount"))
        .when(F.col("source") == "ntis", number("TOTALHITS"))
        .when(F.col("source") == "kisti", number("TotalCount"))
        .when(
            F.col("source") == "losi",
            F.coalesce(F.get_json_object(body, "$.result[0].totalCount"), F.get_json_object(body, "$.result.totalCount")).try_cast("long"),
        )
        .when(F.col("source") == "encykorea", ency_total(_unwrap(body)))
    )
    return captures.select("source", "request_no", "page", total.alias("total"))
