"""URL and key expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmill.functions.patterns import SPACE_CHARS, java
from gleanmill.functions.text import Col, col, text_of, trimmed

# Query parameters that only carry a session or a token.
SESSION_PARAMS = ("_csrf", "csrf", "csrfToken", "JSESSIONID", "PHPSESSID")
# Parameters that hold a page number, in order of precedence.
PAGE_PARAMS = ("page", "pageIndex", "pg", "_page", "nowPage")

_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"


def percent_encode(value: Col) -> Column:
    """Component encoding: blanks as %20, and ~ ! ' ( ) * left alone."""
    out = F.url_encode(col(value).cast("string"))
    for old, new in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def is_absolute(url: Col) -> Column:
    return col(url).rlike(_URL)


def url_origin(url: Col) -> Column:
    """scheme://host, lower case, without a default port."""
    u = col(url)
    scheme, host = F.lower(_part(u, 1)), F.lower(F.regexp_replace(_part(u, 2), "^[^@]*@", ""))
    return F.when(is_absolute(u), F.concat(scheme, F.lit("://"), _without_port(scheme, host)))


def _without_port(scheme: Column, host: Column) -> Column:
    return (
        F.when(scheme == "http", F.regexp_replace(host, ":80$", ""))
        .when(scheme == "https", F.regexp_replace(host, ":443$", ""))
        .otherwise(host)
    )


def host_of(url: Col) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(_part(col(url), 2), "^[^@]*@", ""), r":\d*$", ""))


def path_without_dots(path: Column) -> Column:
    """Resolve '.' and '..' segments."""
    steps = F.split(path, "/", -1)
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        )
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
    )
    trailing = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    resolved = F.array_join(trailing, "/")
    return F.when(F.contains(path, F.lit("/.")), resolved).otherwise(path)


def _form_pairs(query: Column) -> Column:
    """Decoded (k, v) pairs of a query string."""
    def pair(item: Column) -> Column:
        at = F.instr(item, "=")
        k = F.when(at > 0, F.substring(item, F.lit(1), at - 1)).otherwise(item)
        v = F.when(at > 0, F.substring(item, at + 1, F.length(item))).otherwise(F.lit(""))
        return F.struct(
            F.coalesce(F.try_url_decode(k), k).alias("k"), F.coalesce(F.try_url_decode(v), v).alias("v")
        )

    return F.transform(F.filter(F.split(query, "&", -1), lambda item: item != ""), pair)


def _form_text(pairs: Column) -> Column:
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&"
    )


def _assemble(url: Column, query: Column) -> Column:
    """Serialise the parts of an absolute url again, with another query."""
    path = _part(url, 3)
    clean = F.when(path == "", F.lit("/")).otherwise(path_without_dots(path))
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    asked = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
    return F.concat(url_origin(url), clean, asked, fragment)


def url_normalise(url: Col, drop: Sequence[str] = SESSION_PARAMS) -> Column:
    """The url without session parameters, serialised again; else unchanged."""
    u = text_of(url)
    query = _part(u, 4)
    kept = F.filter(_form_pairs(query), lambda p: ~p["k"].isin(*drop))
    new_query = F.when(query == "", F.lit("")).otherwise(_form_text(kept))
    return F.when(is_absolute(u), _assemble(u, new_query)).otherwise(u)


def next_page_url(url: Col, params: Sequence[str] = PAGE_PARAMS) -> Column:
    """Raise whichever page parameters exist to the first one's value plus one."""
    u = text_of(url)
    pairs = _form_pairs(_part(u, 4))

    def first(name: str) -> Column:
        return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(1))["v"]

    current = F.coalesce(*[first(name) for name in params])
    number = F.regexp_extract(current, java(r"^\s*([+-]?\d+)"), 1).try_cast("long")
    stepped = F.transform(
        pairs, lambda p: F.struct(p["k"].alias("k"), F.when(p["k"].isin(*params), (number + 1).cast("string")).otherwise(p["v"]).alias("v"))
    )
    # setting a parameter keeps its first place and drops its repetitions
    unique = F.filter(
        stepped,
        lambda p, i: ~p["k"].isin(*params)
        | (F.array_position(F.transform(stepped, lambda q: q["k"]), p["k"]) == i + 1),
    )
    return F.when(is_absolute(u) & number.isNotNull(), _assemble(u, _form_text(unique)))


def page_offset_url(url: Col, page_no: Col, size_param: str = "maxPageItems", offset_param: str = "pagerOffset") -> Column:
    """Offset paging: (n - 1) * size, size 10 unless the url names another."""
    u = text_of(url)
    pairs = _form_pairs(_part(u, 4))
    size = F.try_element_at(F.filter(pairs, lambda p: p["k"] == size_param), F.lit(1))["v"]
    per_page = F.coalesce(F.nullif(F.regexp_extract(size, r"^\s*(\d+)", 1).try_cast("long"), F.lit(0)), F.lit(10))
    offset = ((col(page_no) - 1) * per_page).cast("string")
    others = F.filter(pairs, lambda p: p["k"] != offset_param)
    added = F.array_append(others, F.struct(F.lit(offset_param).alias("k"), offset.alias("v")))
    return F.when(is_absolute(u), _assemble(u, _form_text(added)))


def url_resolve(link: Col, base: Col) -> Column:
    """Relative to absolute against an absolute base; failure is ''."""
    rel, b = F.btrim(text_of(link), F.lit(SPACE_CHARS)), text_of(base)
    origin, scheme = url_origin(b), F.lower(_part(b, 1))
    base_path = F.when(_part(b, 3) == "", F.lit("/")).otherwise(_part(b, 3))
    folder = F.regexp_extract(base_path, "^(.*/)", 1)
    base_query = F.regexp_extract(b, r"^[^?#]*(\?[^#]*)", 1)
    rel_path = F.regexp_extract(rel, "^[^?#]*", 0)
    rel_tail = F.regexp_extract(rel, r"^[^?#]*(.*)\z", 1)
    with_slash = F.regexp_replace(rel, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)(?=[?#]|\z)", "$1/")
    resolved = (
        F.when(rel.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), with_slash)
        .when(rel.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), rel)
        .when(rel == "", F.concat(origin, base_path, base_query))
        .when(F.startswith(rel, F.lit("//")), F.concat(scheme, F.lit(":"), rel))
        .when(F.startswith(rel, F.lit("/")), F.concat(origin, path_without_dots(rel_path), rel_tail))
        .when(F.startswith(rel, F.lit("?")), F.concat(origin, base_path, rel))
        .when(F.startswith(rel, F.lit("#")), F.concat(origin, base_path, base_query, rel))
        .otherwise(F.concat(origin, path_without_dots(F.concat(folder, rel_path)), rel_tail))
    )
    return F.when(is_absolute(b) | is_absolute(rel), resolved).otherwise(F.lit(""))


def regex_template(value: Col, pattern: str, output: str) -> Column:
    """First match replaced by a template with ``${n}`` groups; unmatched groups blank."""
    v = text_of(value)
    # trailing empty groups: a template may name more groups than the pattern has
    rule = java(pattern) + "()" * output.count("${")
    found = F.regexp_instr(v, F.lit(rule))
    pieces: list[Column] = []
    rest = output
    while "${" in rest:
        head, _, tail = rest.partition("${")
        number, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(F.regexp_extract(v, rule, int(number)), F.lit(""))]
    pieces.append(F.lit(rest))
    before = F.substring(v, F.lit(1), found - 1)
    after = F.substring(v, found + F.length(F.regexp_extract(v, rule, 0)), F.length(v))
    return F.when(found > 0, F.concat(before, *pieces, after)).otherwise(v)


def url_template(template: str, fields: Sequence[str], page: Col | None = None) -> Column:
    """``${FIELD}`` filled from a row, percent-encoded, resolved against the page."""
    out: Column = F.lit(template)
    for field in fields:
        out = F.replace(out, F.lit("${" + field + "}"), percent_encode(text_of(field)))
    return url_resolve(out, page) if page is not None else out


def url_template_from_map(template: Column, row: Column, page: Column) -> Column:
    """As url_template, with template and row values both as data."""
    names = F.array_distinct(F.regexp_extract_all(template, F.lit(r"\$\{(\w+)\}"), F.lit(1)))
    filled = F.aggregate(
        names,
        template,
        lambda acc, name: F.replace(
            acc,
            F.concat(F.lit("${"), name, F.lit("}")),
            percent_encode(F.coalesce(F.try_element_at(row, name), F.lit(""))),
        ),
    )
    return url_resolve(filled, page)


def call_name(value: Col) -> Column:
    return F.regexp_extract(_call_text(value), r"^([\w$.]+)\(", 1)


def _call_text(value: Col) -> Column:
    bare = F.regexp_replace(text_of(value), java(r"^javascript:\s*"), "")
    bare = F.regexp_replace(bare, java(r"\s*;\s*return false;?$"), "")
    return F.regexp_replace(bare, r";\z", "")


def call_args(value: Col) -> Column:
    """Arguments of ``fn(a,'b, c')``; commas inside quotes are kept."""
    inner = F.regexp_extract(_call_text(value), r"(?s)^[\w$.]+\((.*)\)\z", 1)
    parts = F.split(inner, r",(?=(?:[^']*'[^']*')*[^']*$)", -1)
    args = F.transform(
        parts, lambda a: F.regexp_replace(F.btrim(a, F.lit(SPACE_CHARS)), r"(?s)^'(.*)'\z", "$1")
    )
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(args)


def session_path_strip(path: Col) -> Column:
    """Remove a leading session segment and repair the one board path that loses its folder."""
    bare = F.regexp_replace(text_of(path), "^/;jsessionid=[^/]+/", "/")
    return F.when(F.startswith(bare, F.lit("/board.do?boardId=f")), F.concat(F.lit("/board"), bare)).otherwise(bare)


def proxy_link(path: Col) -> Column:
    return F.concat(F.lit("/scraper/media?path="), percent_encode(path))


def srcset_parse(value: Col) -> Column:
    """Candidates of a srcset with width ('640w') or density ('2x')."""
    def candidate(item: Column) -> Column:
        parts = F.split(item, java(r"\s+"), -1)
        descriptor = F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
        return F.struct(
            parts[0].alias("url"),
            F.when(F.endswith(descriptor, F.lit("w")), F.regexp_extract(descriptor, r"^(-?\d+)", 1).try_cast("long")).alias("width"),
            F.when(F.endswith(descriptor, F.lit("x")), F.regexp_extract(descriptor, r"^(-?\d*\.?\d+)", 1).try_cast("double")).alias("density"),
        )

    return F.transform(
        F.split(text_of(value), ",", -1), lambda s: candidate(F.btrim(s, F.lit(SPACE_CHARS)))
    )


# ---- pictures ---------------------------------------------------------------

def base_name(url: Col) -> Column:
    return F.substring_index(F.substring_index(text_of(url), "?", 1), "/", -1)


def image_base(url: Col) -> Column:
    """File name without the size mark before its extension."""
    return F.regexp_replace(base_name(url), r"(?i)_P\d+(?=\.[a-z]+\z)", "")


def image_url_fix(url: Col, old_host: str = "img.yna.co.kr", new_host: str = "img1.yna.co.kr") -> Column:
    """http to https, and the archive's picture host to the one that serves it."""
    secure = F.regexp_replace(trimmed(url), "(?i)^http://", "https://")
    host = old_host.replace(".", r"\.")
    return F.regexp_replace(secure, f"(?i)//{host}/", f"//{new_host}/")


def thumbnail_to_full(url: Col, old: str = "_w250_", new: str = "_w1597_") -> Column:
    """First occurrence only."""
    u = text_of(url)
    at = F.instr(u, old)
    return F.when(at > 0, F.concat(F.substring(u, F.lit(1), at - 1), F.lit(new), F.substring(u, at + len(old), F.length(u)))).otherwise(u)


def image_url_allowed(url: Col) -> Column:
    """http(s) pictures that are not vector graphics."""
    u = text_of(url)
    return u.rlike("(?i)^https?:") & ~F.endswith(F.regexp_replace(u, "[?#].*$", ""), F.lit(".svg"))


# ---- keys -------------------------------------------------------------------

def riss_id(url: Col) -> Column:
    """The record id a riss url carries; '' where it has none."""
    return F.regexp_extract(col(url), "[?&]id=([A-Za-z0-9]+)", 1)


def item_key(value: Col, length: int = 8) -> Column:
    return F.left(F.md5(col(value)), F.lit(length))


def article_identity(guid: Col, link: Col) -> Column:
    """guid, or the link where there is none."""
    return F.when(text_of(guid) != "", text_of(guid)).otherwise(text_of(link))


def verdict_key(key: Col, title: Col, content: Col) -> Column:
    """The article's own key, else 16 hex digits of title and content."""
    own = trimmed(key)
    digest = F.left(F.md5(F.concat(text_of(title), F.lit("\n"), text_of(content))), F.lit(16))
    return F.when(own != "", own).otherwise(digest)


def object_path(uri: Col) -> Column:
    """s3://bucket/key to /key."""
    key = F.regexp_replace(text_of(uri), "^s3://[^/]+", "")
    return F.when(F.startswith(key, F.lit("/")), key).otherwise(F.concat(F.lit("/"), key))


def object_bucket(uri: Col) -> Column:
    return F.regexp_extract(text_of(uri), r"(?s)^s3://([^/]+)/(.+)\z", 1)


def object_key(uri: Col) -> Column:
    return F.regexp_extract(text_of(uri), r"(?s)^s3://([^/]+)/(.+)\z", 2)


def clean_key(key: Col) -> Column:
    return F.regexp_replace(trimmed(key), "^/+", "")


def object_key_problem(key: Col, first_segments: Sequence[str]) -> Column:
    """Why an upload key is refused, or null when it is accepted."""
    k = clean_key(key)
    segments = F.split(k, "/", -1)
    return (
        F.when(k == "", "empty")
        .when(F.length(k) > 1024, "too long")
        .when(F.contains(k, F.lit("\\")), "backslash")
        .when(k.rlike(r"[\x00-\x1f]"), "control character")
        .when(~F.contains(k, F.lit("/")), "one segment")
        .when(k.rlike(r"(?:^|/)\.{0,2}(?:/|\z)"), "bad segment")
        .when(~segments[0].isin(*first_segments), "prefix")
    )


def readable_key(key: Col, prefix: str = "news-crawler/") -> Column:
    k = clean_key(key)
    return F.startswith(k, F.lit(prefix)) & ~k.rlike(r"(?:^|/)\.\.(?:/|\z)")
