"""Text clean-up expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmill.functions.patterns import BLANK_RUN, SPACE_CHARS, java

Col = Column | str


def col(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_of(value: Col) -> Column:
    """Missing text counts as empty."""
    return F.coalesce(col(value), F.lit(""))


def trimmed(value: Col) -> Column:
    return F.btrim(text_of(value), F.lit(SPACE_CHARS))


def blank_to_null(value: Col) -> Column:
    return F.nullif(trimmed(value), F.lit(""))


def is_blank(value: Col) -> Column:
    return trimmed(value) == ""


def lines_of(value: Column) -> Column:
    """Trimmed, non-empty lines."""
    return F.filter(
        F.transform(F.split(value, "\r?\n", -1), lambda line: F.btrim(line, F.lit(SPACE_CHARS))),
        lambda line: line != "",
    )


def strip_tags(value: Col) -> Column:
    flat = F.regexp_replace(text_of(value), "<[^>]+>", "")
    return F.btrim(F.regexp_replace(flat, BLANK_RUN, " "), F.lit(SPACE_CHARS))


def strip_highlight(value: Col) -> Column:
    return F.regexp_replace(text_of(value), r"(?i)<span\b[^>]*>|</span>", "")


def node_text(value: Col) -> Column:
    """Text of a mixed XML node that the schema declares as STRING."""
    return F.regexp_replace(text_of(value), "<[^>]+>", "")


def escape_bare_amp(value: Col) -> Column:
    known = r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)"
    return F.regexp_replace(text_of(value), known, "&amp;")


# Named entities in decoding order, the ampersand last.
NAMED_ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&nbsp;", " "),
    ("&amp;", "&"),
)
FEED_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&amp;", "&"),
)


def replace_all(value: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    for old, new in pairs:
        value = F.replace(value, F.lit(old), F.lit(new))
    return value


def character(code: Column) -> Column:
    """One UTF-16 unit by number; a lone surrogate becomes the replacement mark."""
    unit = F.pmod(code, F.lit(65536)).cast("long")
    safe = F.when(unit.between(0xD800, 0xDFFF), F.lit(0xFFFD)).otherwise(unit)
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _decode_numeric(value: Column, pattern: str, to_number) -> Column:
    """Single pass: text between the matches, zipped with the decoded matches."""
    codes = F.transform(
        F.regexp_extract_all(value, F.lit(pattern), F.lit(1)), lambda c: character(to_number(c))
    )
    pieces = F.split(value, pattern, -1)
    return F.array_join(F.zip_with(pieces, codes, lambda p, c: F.concat(p, F.coalesce(c, F.lit("")))), "")


def decode_entities(value: Col) -> Column:
    """Decimal, then hexadecimal, then named entities; texts without any pass untouched."""
    raw = text_of(value)

    def decode(text: Column) -> Column:
        decimal = F.when(
            F.contains(text, F.lit("&#")),
            _decode_numeric(
                text, r"&#(\d+);", lambda c: F.pmod(F.right(c, F.lit(30)).cast("decimal(38,0)"), F.lit(65536))
            ),
        ).otherwise(text)
        return bound(decimal, lambda d: F.when(
            F.contains(d, F.lit("&#x")),
            _decode_numeric(d, "&#x([0-9a-fA-F]+);", lambda c: F.conv(F.substring(c, -4, 4), 16, 10).cast("long")),
        ).otherwise(d))

    named = bound(raw, lambda text: replace_all(decode(text), NAMED_ENTITIES))
    return F.when(F.contains(raw, F.lit("&")), named).otherwise(raw)


def bound(value: Column, body) -> Column:
    """Evaluate ``value`` once for an expression that reads it several times.

    The finish of an aggregate over nothing: an array of one would have its type
    derived from the whole body anew for each row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def html_to_text(value: Col) -> Column:
    """Feed description to ``<br>``-joined lines; figure blocks go as a whole."""
    bare = F.regexp_replace(text_of(value), r"(?is)<figure.*?</figure>", "\n")
    bare = F.regexp_replace(bare, java(r"<br\s*/?>", True), "\n")
    bare = replace_all(F.regexp_replace(bare, "<[^>]+>", ""), FEED_ENTITIES)
    return F.array_join(lines_of(bare), "<br>")


def inline_images(value: Col) -> Column:
    return F.regexp_extract_all(
        text_of(value), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1)
    )


def body_to_text(body: Col, title: Col, subtitle: Col) -> Column:
    """Body lines without the leading ones that repeat the title or subtitle."""
    lines = lines_of(text_of(body))
    own = F.transform(lines, lambda line: (line != text_of(title)) & (line != text_of(subtitle)))
    start = F.array_position(own, True)
    kept = F.when(start > 0, F.slice(lines, start, F.size(lines))).otherwise(F.array().cast("array<string>"))
    return F.array_join(kept, "<br>")


def title_suffix(value: Col, limit: int = 40) -> Column:
    unsafe = java(r"""[/\\:*?"'<>|#%&{}\[\]`^~\s]+""")
    flat = F.regexp_replace(F.regexp_replace(text_of(value), unsafe, "_"), "_+", "_")
    return F.rtrim(F.left(F.btrim(flat, F.lit("_")), F.lit(limit)), F.lit("_"))


# Legal-form prefixes of an institution's name.
LEGAL_FORMS = r"^\s*(\(재\)|\(사\)|\(사단\)|\(재단\)|재단법인|사단법인)\s*"


def publisher_normalise(value: Col) -> Column:
    bare = F.regexp_replace(text_of(value), java(LEGAL_FORMS), "")
    return F.btrim(F.regexp_replace(bare, BLANK_RUN, " "), F.lit(SPACE_CHARS))


# Fixed value: the news agency's byline, e.g. "(Seoul=agency) name reporter =".
BYLINE = r"\([^)=]*=\s*연합뉴스\)\s*([가-힣]+(?:\s+[가-힣]+)*)\s*기자"


def byline_extract(value: Col, pattern: str = BYLINE) -> Column:
    return F.btrim(F.regexp_extract(text_of(value), java(pattern), 1), F.lit(SPACE_CHARS))


def cleaned(names: Column) -> Column:
    """Trimmed, non-empty entries of an array."""
    return F.filter(
        F.transform(names, lambda n: F.btrim(F.coalesce(n, F.lit("")), F.lit(SPACE_CHARS))),
        lambda n: n != "",
    )


def relist(value: Col, separator: str, glue: str = ", ") -> Column:
    """Split on a separator pattern and join the non-empty parts again."""
    return F.array_join(cleaned(F.split(text_of(value), separator, -1)), glue)


def drop_affiliation(name: Column) -> Column:
    """'name(university)' without the trailing bracket."""
    return F.btrim(F.regexp_replace(name, java(r"\([^)]*\)\s*$"), ""), F.lit(SPACE_CHARS))


def people(value: Col) -> Column:
    """Names split on , ; | / with every bracket removed."""
    parts = F.split(text_of(value), "[,;|/]+", -1)
    return F.array_join(cleaned(F.transform(parts, lambda n: F.regexp_replace(n, r"\([^)]*\)", ""))), ", ")


def local_names(names: Column, script: str = "[가-힣]") -> Column:
    """Names in the local script if there are any, else all; distinct, in order."""
    local = F.filter(names, lambda n: n.rlike(script))
    return F.array_join(F.array_distinct(F.when(F.size(local) > 0, local).otherwise(names)), ", ")


def volume_label(journal: Col, volume: Col, issue: Col, absent: Sequence[str] = ()) -> Column:
    """'journal vol(no)'; values in ``absent`` count as missing."""
    missing = ["", *absent]
    name, vol, no = trimmed(journal), trimmed(volume), trimmed(issue)
    number = F.when(no.isin(missing), F.lit("")).otherwise(F.concat(F.lit("("), no, F.lit(")")))
    label = F.when(vol.isin(missing), F.lit("")).otherwise(F.concat(F.lit(" "), vol, number))
    return F.when(name != "", F.concat(name, label))


def text_cleanup(value: Col) -> Column:
    """Newlines to `` <br> ``, tabs and runs of blanks to one blank."""
    joined = F.regexp_replace(text_of(value), java(r"\s*[\r\n]+\s*"), " <br> ")
    joined = F.regexp_replace(F.regexp_replace(joined, "\t+", " "), " {2,}", " ")
    return F.btrim(joined, F.lit(SPACE_CHARS))


def one_line(value: Col) -> Column:
    return F.btrim(F.regexp_replace(text_of(value), BLANK_RUN, " "), F.lit(SPACE_CHARS))


def writer_cleanup(value: Col) -> Column:
    bare = F.regexp_replace(one_line(value), java(r"기자명\s*"), "")
    return F.btrim(F.regexp_replace(bare, java(r"^작성자\s*"), ""), F.lit(SPACE_CHARS))


def keyword_sanitise(value: Col) -> Column:
    """Percent-decoded keyword without control characters; '+' stays a plus."""
    decoded = F.try_url_decode(F.replace(text_of(value), F.lit("+"), F.lit("%2B")))
    return F.btrim(F.regexp_replace(decoded, r"[\x00-\x1F\x7F]", ""), F.lit(SPACE_CHARS))


def keyword_list(values: Column) -> Column:
    """A missing list is one blank keyword."""
    return F.when(values.isNull(), F.array(F.lit(""))).otherwise(F.transform(values, keyword_sanitise))


def translated_flag(*english: Col) -> Column:
    present = None
    for field in english:
        test = ~is_blank(field)
        present = test if present is None else present | test
    return F.when(present, "Y").otherwise("N")


def pad_left(value: Col, width: int, fill: str = " ") -> Column:
    """Pads, never cuts."""
    c = col(value).cast("string")
    return F.when(F.length(c) < width, F.lpad(c, width, fill)).otherwise(c)


def pad_right(value: Col, width: int, fill: str = " ") -> Column:
    c = col(value).cast("string")
    return F.when(F.length(c) < width, F.rpad(c, width, fill)).otherwise(c)


def sql_literal(value: Col) -> Column:
    return F.concat(F.lit("'"), F.replace(col(value).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def matched_keywords(value: Col, keywords: Sequence[str]) -> Column:
    """Every listed keyword contained in the text, ignoring case, in list order."""
    upper = F.upper(text_of(value))
    hits = [F.when(F.contains(upper, F.lit(word.upper())), F.lit(word)) for word in keywords]
    return F.array_compact(F.array(*hits))


def has_keyword(value: Col, keywords: Sequence[str]) -> Column:
    """Cheap gate: stays a boolean inside codegen, builds no array."""
    upper = F.upper(text_of(value))
    test = F.lit(False)
    for word in keywords:
        test = test | F.contains(upper, F.lit(word.upper()))
    return test


def first_characters(value: Col, n: int) -> Column:
    return F.left(text_of(value), F.lit(n))
