"""Number, array, map and JSON expressions, file names and file kinds."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from gleanmill.functions.patterns import BLANK_RUN, SPACE_CHARS, java
from gleanmill.functions.text import NAMED_ENTITIES, Col, bound, col, decode_entities, strip_tags, text_of, trimmed
from gleanmill.functions.urls import base_name


def nearest_allowed(value: Col, sizes: Sequence[int] = (10, 20, 50, 100), default: int = 100) -> Column:
    """Allowed size with the least distance; the default wins ties, then list order."""
    wanted = col(value).cast("long")
    ranked = [default, *[size for size in sizes if size != default]]
    options = [
        F.struct(F.abs(F.lit(size) - wanted).alias("gap"), F.lit(rank).alias("rank"), F.lit(size).alias("size"))
        for rank, size in enumerate(ranked)
    ]
    return F.least(*options)["size"].cast("long")


def pick_by_lang(entries: Col, lang: str) -> Column:
    """First non-blank entry of a language in array<struct<_VALUE,_lang>>."""
    hits = F.filter(col(entries), lambda e: (e["_lang"] == lang) & (trimmed(e["_VALUE"]) != ""))
    return F.coalesce(trimmed(F.try_element_at(hits, F.lit(1))["_VALUE"]), F.lit(""))


def coded(items: Col, code: str) -> Column:
    """Text of the last item that carries a code; '' when absent or blank."""
    hits = F.filter(col(items), lambda i: trimmed(i["_metaCode"]) == code)
    return strip_tags(F.try_element_at(hits, F.lit(-1))["_VALUE"])


def json_path(value: Col, path: str) -> Column:
    """Value at a dotted path of a JSON text."""
    return F.get_json_object(col(value), "$." + path)


# ---- alias picking ----------------------------------------------------------

# Keys tried first when a text is needed from a nested object.
TEXT_KEYS = ("ko", "kor", "kr", "korean", "name", "title", "text", "content", "value", "#text", "_")


def normal_key(key: Column) -> Column:
    return F.lower(F.regexp_replace(key, java(r"[\s_\-./]"), ""))


def json_entries(record: Col) -> Column:
    """Non-null members of a JSON object as array<struct<k,nk,v>>; nested values as JSON text."""
    pairs = F.map_entries(F.from_json(col(record), "map<string,string>"))
    return F.transform(
        F.filter(pairs, lambda e: e["value"].isNotNull()),
        lambda e: F.struct(e["key"].alias("k"), normal_key(e["key"]).alias("nk"), e["value"].alias("v")),
    )


def _member(entries: Column, alias: str) -> Column:
    """Value under one alias: the exact spelling first, then ignoring case and separators."""
    at = lambda field, name: F.get(entries["v"], (F.array_position(entries[field], F.lit(name)) - 1).cast("int"))
    return F.coalesce(at("k", alias), at("nk", "".join(c for c in alias if c not in " _-./").lower()))


def _by_name(entries: Column) -> Column:
    return F.struct(entries["k"].alias("k"), entries["nk"].alias("nk"), entries["v"].alias("v"))


def member(entries: Column, aliases: Sequence[str]) -> Column:
    """First value found under any alias."""
    return bound(_by_name(entries), lambda e: F.coalesce(*[_member(e, alias) for alias in aliases]))


def _plain_text(value: Column) -> Column:
    """Tag-free, decoded, one-line text; values with nothing to clean pass untouched."""
    bare = bound(strip_tags(value), decode_entities)
    full = F.btrim(F.regexp_replace(bare, BLANK_RUN, " "), F.lit(SPACE_CHARS))
    return F.when(value.rlike(java(r"[<&]|\s")), full).otherwise(value)


#: Stands before a text that came out of a container, so that it is not cleaned again.
CLEAN = "\ue000"
# A JSON container without another one in it; strings are passed over whole.
INNERMOST = r'[\[{][^\[\]{}"]*+(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"[^\[\]{}"]*+)*+[\]}]'


def _leaf(value: Column) -> Column:
    text = F.coalesce(value, F.lit(""))
    done = F.startswith(text, F.lit(CLEAN))
    return F.when(done, F.substring(text, 2, 1 << 30)).otherwise(F.coalesce(_plain_text(text), F.lit("")))


def _flat_text(container: Column) -> Column:
    """Text of a container of plain members: arrays joined by ', ', objects by a preferred key or by ' '; null: no JSON."""

    def joined(values: Column, glue: str) -> Column:
        return F.array_join(F.filter(F.transform(values, _leaf), lambda t: t != ""), glue)

    def of_object(members: Column) -> Column:
        keys = F.filter(F.array(*[F.lit(key) for key in TEXT_KEYS]), lambda k: F.map_contains_key(members, k))
        by_key = F.filter(F.transform(keys, lambda k: _leaf(F.try_element_at(members, k))), lambda t: t != "")
        return F.coalesce(F.try_element_at(by_key, F.lit(1)), joined(F.map_values(members), " "))

    of_list = joined(F.from_json(container, "array<string>"), ", ")
    as_object = bound(F.from_json(container, "map<string,string>"), of_object)
    return F.when(F.startswith(container, F.lit("[")), of_list).otherwise(as_object)


def _quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.btrim(F.to_json(F.array(text)), F.lit("[]"))


def _opens(value: Column) -> Column:
    return F.startswith(value, F.lit("{")) | F.startswith(value, F.lit("["))


def json_text(value: Column) -> Column:
    """Text of a JSON value of any depth: arrays joined by ', ', objects by a preferred key or by ' '.

    The innermost containers become strings, all of them in one step, until the
    value is a string itself; so the steps are as many as the value is deep.
    """

    def step(text: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(text, F.lit(INNERMOST), F.lit(0)), _flat_text)

        def put_back(texts: Column) -> Column:
            quoted = F.transform(texts, lambda t: _quoted(F.concat(F.lit(CLEAN), t)))
            parts = F.zip_with(F.split(text, INNERMOST, -1), quoted, lambda p, q: F.concat(p, F.coalesce(q, F.lit(""))))
            return F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(parts, ""))

        return bound(inner, put_back)

    # no value is deeper than it has opening brackets
    most = F.length(value) - F.length(F.translate(value, "{[", ""))
    string = F.aggregate(F.sequence(F.lit(1), most), value, lambda text, _: F.when(_opens(text), step(text)).otherwise(text))
    flat = F.substring(F.get(F.from_json(F.concat(F.lit("["), string, F.lit("]")), "array<string>"), F.lit(0)), 2, 1 << 30)
    # what only looks like JSON is plain text
    return F.when(_opens(value), F.coalesce(flat, _leaf(value))).otherwise(_leaf(value))


def text_entries(entries: Column) -> Column:
    """json_entries with every value flattened to text, once for all later picks."""
    return F.transform(entries, lambda e: F.struct(e["k"].alias("k"), e["nk"].alias("nk"), json_text(e["v"]).alias("v")))


ENTRIES = ArrayType(StructType([StructField(name, StringType()) for name in ("k", "nk", "v")]))


class _Unusual(Exception):
    """A record that the expressions must read."""


def _unusual(_: str):
    raise _Unusual


def _integer(text: str) -> str:
    return text if text != "-0" else _unusual(text)


_TAG, _SPACES, _MARKS = re.compile("<[^>]+>"), re.compile(f"[{re.escape(SPACE_CHARS)}]+"), re.compile(r"[ _\-./]")
# Keys that every language lowers alike.
_KEY = re.compile("[ -~가-힣]*")


def _one_line(text: str) -> str:
    return (text if text.isascii() and text.isprintable() and "  " not in text else _SPACES.sub(" ", text)).strip(SPACE_CHARS)


def _clean(text: str) -> str:
    text = _one_line(_TAG.sub("", text) if "<" in text else text)
    if "&" not in text:
        return text
    if "&#" in text:
        raise _Unusual
    for old, new in NAMED_ENTITIES:
        text = text.replace(old, new)
    return _one_line(text)


def _text(value) -> str:
    if isinstance(value, list):
        return ", ".join(t for t in map(_text, value) if t)
    if isinstance(value, tuple):
        texts = [(key, _text(member_)) for key, member_ in value]
        known = dict(reversed(texts))  # of equal keys the first counts
        for key in TEXT_KEYS:
            if text := known.get(key):
                return text
        return " ".join(t for _, t in texts if t)
    return "" if value is None else "true" if value is True else "false" if value is False else _clean(value)


_READER = json.JSONDecoder(object_pairs_hook=tuple, parse_float=_unusual, parse_constant=_unusual, parse_int=_integer)


def _record_texts(record: str | None) -> list[tuple[str, str, str]] | None:
    """text_entries(json_entries) of a plain record; None: one with floats, escapes by number or other rare forms."""
    if record is None or "\\u" in record or CLEAN in record:
        return None
    try:
        found = _READER.decode(record)
        if not isinstance(found, tuple):
            return None
        out = []
        for key, value in found:
            if not _KEY.fullmatch(key) or isinstance(value, str) and value[:1] in ("[", "{"):
                return None
            if value is not None:
                out.append((key, _MARKS.sub("", key).lower(), _text(value)))
        return out
    except (_Unusual, ValueError, RecursionError):
        return None


@F.arrow_udf(ENTRIES)
def _plain_record_texts(records: pa.Array) -> pa.Array:
    rows = [_record_texts(record) for record in records.to_pylist()]
    ends = itertools.accumulate((len(row or ()) for row in rows), initial=0)
    places = [None if n < len(rows) and rows[n] is None else end for n, end in enumerate(ends)]
    flat = [entry for row in rows if row for entry in row]
    fields = [pa.array([entry[n] for entry in flat], pa.string()) for n in range(3)]
    return pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.StructArray.from_arrays(fields, ["k", "nk", "v"]))


def record_texts(record: Col) -> Column:
    """text_entries(json_entries(record)): plain records in one pass of a small reader, the others by the expressions."""
    return F.coalesce(_plain_record_texts(col(record)), text_entries(json_entries(record)))


def alias_pick(texts: Column, aliases: Sequence[str]) -> Column:
    """First non-blank text among aliases, in alias order, over text_entries."""
    picked = lambda e: F.coalesce(*[bound(_member(e, alias), lambda v: F.when(v != "", v)) for alias in aliases], F.lit(""))
    return bound(_by_name(texts), picked)


# ---- file kinds and names ---------------------------------------------------

# Accepted extensions.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "tif", "tiff")
FILE_EXTENSIONS = (
    "pdf", "hwp", "hwpx", "doc", "docx", "xls", "xlsx", "ppt", "pptx",
    "zip", "7z", "txt", "csv", "rtf", "odt",
)
# Extensions of a script, never of a document.
SCRIPT_EXTENSIONS = (".do", ".es", ".jsp", ".asp", ".php", ".action")
# Media type by extension.
MIME_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "svg": "image/svg+xml",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "zip": "application/zip",
    "7z": "application/x-7z-compressed",
    "txt": "text/plain",
    "csv": "text/csv",
    "rtf": "application/rtf",
    "odt": "application/vnd.oasis.opendocument.text",
}
# Media types the upload side sets for the local office formats.
OFFICE_OVERRIDES = {"hwp": "application/x-hwp", "hwpx": "application/x-hwp"}
UNKNOWN_MIME = "application/octet-stream"


def extension(path: Col) -> Column:
    """Last dot part before '?', lower case."""
    return F.lower(F.substring_index(F.substring_index(text_of(path), "?", 1), ".", -1))


def file_kind(path: Col) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), "image").when(ext.isin(*FILE_EXTENSIONS), "file")


def mime_type(path: Col, overrides: dict[str, str] | None = None) -> Column:
    """A literal map keeps the lookup inside the projection: no join, no shuffle."""
    known = {**MIME_TYPES, **(overrides or {})}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit(UNKNOWN_MIME))


def attachment_problem(name: Col) -> Column:
    """Why an attachment makes its article invalid, or null."""
    ext = F.lower(F.regexp_extract(F.substring_index(text_of(name), "/", -1), r"(?<=.)(\.[^.]*)\z", 1))
    return F.when(ext == "", "no extension").when(ext.isin(*SCRIPT_EXTENSIONS), "script")


def _looks_like_file(name: Column) -> Column:
    return F.contains(F.right(name, F.lit(5)), F.lit("."))


def filename_resolve(disposition: Col, link_text: Col, url: Col, title: Col) -> Column:
    """Header name, else link text, else url base, else the title as a pdf."""
    header = text_of(disposition)
    star = F.btrim(F.replace(F.regexp_extract(header, r"(?i)filename\*=(?:UTF-8'')?([^;]+)", 1), F.lit('"'), F.lit("")), F.lit(SPACE_CHARS))
    plain = F.btrim(F.replace(F.regexp_extract(header, r'(?i)filename="?([^";]+)"?', 1), F.lit('"'), F.lit("")), F.lit(SPACE_CHARS))

    def percent_decoded(value: Column) -> Column:
        return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))

    # header bytes read as latin-1: only texts of that range can be repaired
    narrow = plain.rlike(r"^[\x00-\xFF]*\z")
    repaired = F.when(narrow, F.try_validate_utf8(F.encode(plain, "ISO-8859-1")))
    named = (
        F.when(star != "", percent_decoded(star))
        .when(plain.rlike("%[0-9A-Fa-f]{2}"), F.coalesce(percent_decoded(plain), plain))
        .otherwise(F.coalesce(repaired, plain))
    )
    from_header = F.regexp_replace(named, java(r"[\s,+]+"), "")
    from_link = F.regexp_replace(trimmed(link_text), java(r"[\s,+]+"), "")
    from_url = base_name(F.regexp_replace(text_of(url), "#.*$", ""))
    from_title = F.regexp_replace(text_of(title), java(r"""[\s,+/\\:*?"<>|]+"""), "_")
    return (
        F.when((from_header != "") & _looks_like_file(from_header), from_header)
        .when((from_link != "") & _looks_like_file(from_link), from_link)
        .when(_looks_like_file(from_url) & ~F.endswith(from_url, F.lit(".do")), from_url)
        .otherwise(F.concat(F.when(from_title != "", from_title).otherwise(F.lit("download")), F.lit(".pdf")))
    )


def isbn_valid(value: Col) -> Column:
    return F.coalesce(col(value).rlike(r"^(?:\d{9}[\dXx]|\d{13})\z"), F.lit(False))


# ---- replies of an outside classifier ---------------------------------------

def reply_object(reply: Col) -> Column:
    """The greedy {...} of a reply as a VARIANT, or null."""
    text = F.regexp_extract(text_of(reply), r"(?s)\{.*\}", 0)
    return F.try_parse_json(F.nullif(text, F.lit("")))


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _reason(parsed: Column, limit: int | None) -> Column:
    """The reply's reason, whole unless the caller asks for its first ``limit`` characters."""
    whole = F.coalesce(F.try_variant_get(parsed, "$.reason", "string"), F.lit(""))
    return whole if limit is None else F.left(whole, F.lit(limit))


def relevant_unless_false(reply: Col, field: str = "relevant", limit: int | None = None) -> Column:
    """Only an explicit false (boolean or text) drops; struct(ok, value, reason)."""
    parsed = reply_object(reply)
    raw = F.try_variant_get(parsed, f"$.{field}", "variant")
    text = F.lower(F.btrim(F.coalesce(F.try_variant_get(parsed, f"$.{field}", "string"), F.lit("")), F.lit(SPACE_CHARS)))
    explicit = _kind(raw).isin("BOOLEAN", "STRING") & (text == "false")
    return F.struct(parsed.isNotNull().alias("ok"), (~explicit).alias("value"), _reason(parsed, limit).alias("reason"))


def only_true(reply: Col, field: str = "relevant", limit: int | None = None) -> Column:
    """Only a boolean true keeps."""
    parsed = reply_object(reply)
    raw = F.try_variant_get(parsed, f"$.{field}", "variant")
    kept = (_kind(raw) == "BOOLEAN") & F.coalesce(F.try_variant_get(parsed, f"$.{field}", "boolean"), F.lit(False))
    return F.struct(parsed.isNotNull().alias("ok"), kept.alias("value"), _reason(parsed, limit).alias("reason"))


def unless_boolean_false(reply: Col, field: str = "academic", limit: int | None = None) -> Column:
    """Only a boolean false drops."""
    parsed = reply_object(reply)
    raw = F.try_variant_get(parsed, f"$.{field}", "variant")
    dropped = (_kind(raw) == "BOOLEAN") & ~F.coalesce(F.try_variant_get(parsed, f"$.{field}", "boolean"), F.lit(True))
    return F.struct(parsed.isNotNull().alias("ok"), (~dropped).alias("value"), _reason(parsed, limit).alias("reason"))


def institution_reply(reply: Col, least: float = 0.6) -> Column:
    """struct(verdict, by): low confidence and failure both fall to PRIVATE."""
    parsed = reply_object(reply)
    confidence = F.coalesce(F.try_variant_get(parsed, "$.confidence", "double"), F.lit(0.0))
    verdict = F.when(F.try_variant_get(parsed, "$.verdict", "string") == "GOV", "GOV").otherwise("PRIVATE")
    return (
        F.when(parsed.isNull(), F.struct(F.lit("PRIVATE").alias("verdict"), F.lit("default").alias("by")))
        .when(confidence < least, F.struct(F.lit("PRIVATE").alias("verdict"), F.lit("llm-lowconf").alias("by")))
        .otherwise(F.struct(verdict.alias("verdict"), F.lit("llm").alias("by")))
    )


def reply_rows(reply: Col) -> Column:
    """The greedy [...] of a reply as array<struct<i,theme>>, or null."""
    text = F.regexp_extract(text_of(reply), r"(?s)\[.*\]", 0)
    return F.from_json(F.nullif(text, F.lit("")), "array<struct<i string, theme string>>")


def config_reply(list_reply: Col, detail_reply: Col) -> Column:
    """Two JSON replies merged, later keys win; null unless both are valid objects."""
    both = F.array(col(list_reply), col(detail_reply))
    pairs = F.flatten(F.transform(both, lambda r: F.map_entries(F.from_json(r, "map<string,string>"))))
    names = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    merged = F.transform(
        names, lambda n: F.element_at(F.filter(pairs, lambda e: e["key"] == n), -1)
    )
    valid = F.try_parse_json(col(list_reply)).isNotNull() & F.try_parse_json(col(detail_reply)).isNotNull()
    return F.when(valid, F.map_from_entries(merged))
