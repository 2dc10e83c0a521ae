"""Explicit schemas, as DDL: nothing is inferred from captured XML or JSON."""

from __future__ import annotations


def _ddl(text: str) -> str:
    return " ".join(text.split())


# ---- scans ------------------------------------------------------------------

NEWS_XML = _ddl(
    """
    Header struct<Action:string, ServiceType:string, ContentID:string, SendDate:string, SendTime:string>,
    Metadata struct<Urgency:string, Category:array<struct<_code:string>>, Credit:string, Source:string,
                    Href:string, Writer:string, Desk:struct<_code:string, _VALUE:string>, DeliCode:string>,
    NewsContent struct<LangType:string, Title:string, SubTitle:string, Body:string,
                       AppendData:array<struct<_mimetype:string, Title:string, Caption:string, FileName:string, Href:string>>>,
    _corrupt_record string
    """
)

RSS_ITEM = _ddl(
    """
    title string, link string, guid struct<_VALUE:string, _isPermaLink:string>, description string,
    pubDate string, enclosure struct<_url:string, _type:string>, _corrupt_record string
    """
)

_KCI_RECORD = (
    "struct<journalInfo:struct<`journal-name`:string, `publisher-name`:string, `pub-year`:string, volume:string, "
    "issue:string>, articleInfo:struct<`_article-id`:string, `article-categories`:string, "
    "`title-group`:struct<`article-title`:array<struct<_VALUE:string, _lang:string>>>, "
    "`abstract-group`:struct<abstract:array<struct<_VALUE:string, _lang:string>>>, "
    "`author-group`:struct<author:array<struct<_VALUE:string, _english:string>>>, url:string>>"
)
KCI_RESPONSE = f"outputData struct<result:struct<total:string>, record:array<{_KCI_RECORD}>>"

RISS_FIELDS = (
    "riss.type", "riss.title", "riss.author", "riss.publisher", "riss.pubdate", "riss.stitle", "riss.vol",
    "riss.no", "riss.isbn", "riss.abstract", "riss.toc", "riss.image", "riss.charge", "url",
)
RISS_RESPONSE = (
    "head struct<totalcount:string, Error:string, ErrorMessage:string>, metadata array<struct<"
    + ", ".join(f"`{name}`:string" for name in RISS_FIELDS)
    + ">>"
)

_TWO = "struct<Korean:string, English:string>"
NTIS_RESPONSE = f"""
    resMsg string, TOTALHITS string,
    RESULTSET struct<HIT:array<struct<TermSn:string, PublicationYm:string, PublicationYear:string,
        ResearchPublicNo:string, PublicationAgency:string, ResultTitle:{_TWO}, Abstract:{_TWO}, Keyword:{_TWO},
        Contents:string, DocUrl:string, Manager:string, ManagerName:string>>>
"""

KISTI_RESPONSE = """
    errorDetail struct<errorCode:string, errorMessage:string>, resultSummary struct<TotalCount:string, statusCode:string>,
    recordList struct<record:array<struct<_rownum:string, item:array<struct<_metaCode:string, _metaName:string, _VALUE:string>>>>>
"""

LOSI_LIST = (
    "array<struct<divFlag string, lodID string, title string, pubYear string, "
    "authorList array<struct<lodAuthorID string, name string>>, publisher string, journal struct<title string>, "
    "keywordList array<struct<lodKeywordID string, name string>>, url string, lodYn string, abstractCont string, "
    "policyDataSeq string, controlNum string>>"
)

# A captured response: which request it answers and its body, unparsed.
CAPTURE = _ddl("source string, request_no int, page int, kind string, keyword string, body string")

# ---- records ----------------------------------------------------------------

# Arrival order of a harvested record: request, page, place on the page.
SEQ = "struct<request_no:int, page:int, pos:int>"

_BIB_TEXTS = (
    "source", "source_id", "title", "publisher", "author", "publish_year", "category", "sub_category", "summary",
    "detail_url", "isbn", "material_type", "matched_keyword", "title_en", "summary_en", "author_en",
)
BIB_FIELDS = {**{name: "string" for name in _BIB_TEXTS}, "seq": SEQ}
BIB_SCHEMA = ", ".join(f"{name} {kind}" for name, kind in BIB_FIELDS.items())

ARTICLE_META = _ddl(
    """
    title string, content string, writer string, writedate string, currentUrl string, title_en string,
    content_text_en string, img array<struct<url:string, caption:string, s3Path:string>>,
    file array<struct<originalName:string, url:string, s3Path:string, file_ty:string>>, guid string,
    matchedKeywords array<string>, _corrupt_record string
    """
)

ARCHIVE_META = _ddl(
    """
    source string, sourceId string, menuId string, title string, titleEn string, publisher string,
    publisherEn string, author string, authorEn string, publishYear string, category string, categoryEn string,
    subCategory string, subCategoryEn string, summary string, summaryEn string, linkUrl string, isbn string,
    coverUrl string, registerNo string, remark string, matchedKeywords array<string>,
    classification struct<verdict:string, by:string>, collectedAt string, _corrupt_record string
    """
)

RECIPE = _ddl(
    """
    id long, origin_id long, name string, description string, baseUrl string, startUrl array<string>,
    keywords array<string>, scheduleTime array<string>, enabled boolean, useListSession boolean, maxPage int,
    steps array<struct<id:string, type:string, params:struct<selector:string, attribute:string,
        customTransform:struct<type:string, pattern:string, output:string>,
        targets:array<struct<name:string, type:string, selector:string, attribute:string, optional:boolean,
            captionSelector:string, containerSelector:string,
            customTransform:struct<type:string, pattern:string, output:string>>>,
        apiUrl:string, baseParams:map<string,string>, pageParam:string, keywordFrom:string, keywordParam:string,
        listPath:string, totalPagePath:string, detailUrlTemplate:string, listFields:map<string,string>>>>,
    createdAt string, updatedAt string, lastExecutedAt string, _corrupt_record string
    """
)

RUN_LOG = _ddl(
    "id long, configId long, startedAt timestamp, endedAt timestamp, itemCount long, success boolean, message string, "
    "_corrupt_record string"
)

# classifier: publisher, topic, academic or news; value is the stored outcome.
VERDICT = _ddl(
    "classifier string, key string, value string, by string, reason string, decided_at timestamp"
)
