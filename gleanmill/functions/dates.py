"""Date expressions.  Wall-clock texts are 'yyyy-MM-dd HH:mm:ss'."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmill.functions.patterns import java
from gleanmill.functions.text import Col, bound, col, text_of, trimmed

TEXT = "yyyy-MM-dd HH:mm:ss"
ZONE = "Asia/Seoul"
# Fixed value: the date of an article whose own date cannot be read.
UNREADABLE = "1970-01-01 00:00:00"


def zone_text(instant: Col, zone: str = ZONE) -> Column:
    """An instant as wall-clock text of one zone, whatever the session zone is."""
    as_utc = F.to_utc_timestamp(col(instant), F.current_timezone())
    return F.date_format(F.from_utc_timestamp(as_utc, zone), TEXT)


def rfc822_to_zone(value: Col, otherwise: Col | None = None, zone: str = ZONE) -> Column:
    """'Thu, 9 Jul 2026 16:13:14 +0900'; unreadable dates take the ingest time."""
    bare = F.regexp_replace(trimmed(value), r"^[A-Za-z]+,\s*", "")
    bare = F.regexp_replace(bare, r"(?i)\s(?:GMT|UTC|UT|Z)\z", " +0000")
    parsed = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    return zone_text(parsed if otherwise is None else F.coalesce(parsed, col(otherwise)), zone)


def send_datetime(date: Col, time: Col, otherwise: Col | None = None) -> Column:
    """yyyyMMdd and HHmmss, the time left-padded with zeros."""
    clock = F.when(trimmed(time) == "", F.lit("000000")).otherwise(trimmed(time))
    clock = F.when(F.length(clock) < 6, F.lpad(clock, 6, "0")).otherwise(F.left(clock, F.lit(6)))
    stamp = F.concat(trimmed(date), clock)
    parsed = F.when(
        stamp.rlike(r"^\d{14}\z"), F.date_format(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), TEXT)
    )
    return parsed if otherwise is None else F.coalesce(parsed, zone_text(otherwise))


def _article_timestamp(value: Col) -> Column:
    return bound(trimmed(value), _strict_timestamp)


def _strict_timestamp(raw: Column) -> Column:
    dashed = F.regexp_replace(raw, "[./]", "-")
    with_time = F.when(F.length(dashed) == 16, F.concat(dashed, F.lit(":00"))).otherwise(dashed)
    return (
        F.when(raw.rlike(r"^\d{4}([-./])\d{1,2}\1\d{1,2}\z"), F.try_to_timestamp(dashed, F.lit("yyyy-M-d")))
        .when(
            raw.rlike(r"^\d{4}([-./])\d{2}\1\d{2} \d{2}:\d{2}(?::\d{2})?\z"),
            F.try_to_timestamp(with_time, F.lit("yyyy-MM-dd HH:mm:ss")),
        )
        .when(raw.rlike(r"^\d{8}\z"), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
        .when(
            raw.rlike(r"^\d{4}년 \d{1,2}월 \d{1,2}일\z"),
            F.try_to_timestamp(raw, F.lit("yyyy'년' M'월' d'일'")),
        )
    )


def article_date(value: Col, keep_time: bool = True) -> Column:
    """Fifteen strict formats to text; null when none fits."""
    stamp = _article_timestamp(value)
    return F.date_format(stamp if keep_time else F.date_trunc("day", stamp), TEXT)


def first_format(value: Column, formats: Sequence[tuple[str, str]]) -> Column:
    """First format whose shape matches and whose date exists.

    Each entry is (shape pattern, datetime pattern); the shape keeps the parser
    from seeing texts it would read leniently.
    """
    return F.coalesce(
        *[F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(fmt))) for shape, fmt in formats]
    )


_MONTH = r"[A-Za-z]+ \d{1,2}, \d{4}"
# Accepted shapes of a listed date.
LISTED_FORMATS = (
    (r"^\d{4}\.\d{1,2}\.\d{1,2}\z", "yyyy.M.d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2} \d{1,2}:\d{1,2}\z", "yyyy.M.d H:m"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z", "yyyy.M.d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}\z", "yyyy-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z", "yyyy-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
    (rf"^{_MONTH}\z", "MMMM d, yyyy"),
    (rf"^{_MONTH} \d{{1,2}}:\d{{2}} (?:AM|PM)\z", "MMMM d, yyyy h:mm a"),
)


def _month_case(value: Column) -> Column:
    """Month name with one capital, AM/PM in capitals, as the parser wants them."""
    name = F.initcap(F.regexp_extract(value, "^[A-Za-z]+", 0))
    rest = F.upper(F.regexp_replace(value, "^[A-Za-z]+", ""))
    return F.when(value.rlike("^[A-Za-z]+ "), F.concat(name, rest)).otherwise(value)


def listed_date(value: Col) -> Column:
    """'a ~ b' takes b, the weekday goes; yyyyMMdd, or null for the worklist."""
    raw = text_of(value)
    ends = F.when(F.contains(raw, F.lit("~")), F.get(F.split(raw, "~", -1), F.lit(1))).otherwise(raw)
    bare = bound(F.regexp_replace(trimmed(ends), java(r"^[A-Za-z]+,\s*"), ""), _month_case)
    return F.date_format(bound(bare, lambda text: first_format(text, LISTED_FORMATS)), "yyyyMMdd")


# Accepted shapes of a date on older pages.
LEGACY_FORMATS = (
    (r"^\d{4}\.\d{1,2}\.\d{1,2}\z", "yyyy.M.d"),
    (r"^\d{4}\.\d{2}\.\d{1,2} \d{2}:\d{2}\z", "yyyy.MM.d HH:mm"),
    (r"^\d{4}-\d{2}-\d{1,2} \d{2}:\d{2}\z", "yyyy-MM-d HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}\z", "yyyy-MM-dd"),
    (rf"^{_MONTH}\z", "MMMM d, yyyy"),
    (rf"^{_MONTH} \d{{1,2}}:\d{{2}} (?:AM|PM)\z", "MMMM d, yyyy h:mm a"),
)


def legacy_date(value: Col) -> Column:
    """English month with am/pm, else a numeric date inside the text; yyyyMMdd or null."""
    return F.date_format(bound(trimmed(value), _legacy_timestamp), "yyyyMMdd")


def _legacy_timestamp(raw: Column) -> Column:
    english = F.try_to_timestamp(
        F.when(raw.rlike(rf"(?i)^{_MONTH} \d{{1,2}}:\d{{2}} (?:am|pm)\z"), _month_case(raw)),
        F.lit("MMMM d, yyyy h:mm a"),
    )
    numeric = F.regexp_extract(raw, java(r"\d{4}[-.]\d{1,2}[-.]\d{1,2}(?:\s+\d{2}:\d{2})?"), 0)
    found = F.when(numeric != "", numeric).otherwise(raw)
    dayless = F.regexp_replace(found, r"^(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day, ", "")
    other = bound(bound(dayless, _month_case), lambda text: first_format(text, LEGACY_FORMATS))
    return F.coalesce(english, other)


def korean_datetime(value: Col, this_year: int) -> Column:
    """'2025년 3월 4일 9시' to yyyyMMddHH; '1' when blank, '2' when unmatched."""
    raw = text_of(value)
    rule = java(r"(\d{1,2})월\s*(\d{1,2})일(?:\s*\(.*?\)\s*요일)?\s*(\d{1,2})(?:시|:\d{2})")
    year = F.regexp_extract(raw, r"(\d{4})년", 1)
    pads = [F.lpad(F.regexp_extract(raw, rule, i), 2, "0") for i in (1, 2, 3)]
    full = F.concat(F.when(year == "", F.lit(str(this_year))).otherwise(year), *pads)
    return F.when(raw == "", "1").when(~raw.rlike(rule), "2").otherwise(full)


def year_of(value: Col, anchored: bool = False) -> Column:
    """First four digits, or '' without any."""
    return F.regexp_extract(text_of(value), r"^\d{4}" if anchored else r"\d{4}", 0)


def day_from_name(name: Col) -> Column:
    """'AKR20260305…' to 2026-03-05, '' without eight digits."""
    rule = r"(\d{4})(\d{2})(\d{2})"
    parts = [F.regexp_extract(text_of(name), rule, i) for i in (1, 2, 3)]
    return F.when(text_of(name).rlike(rule), F.concat_ws("-", *parts)).otherwise("")


# ---- refresh windows --------------------------------------------------------

def last_days(date: Col, as_of: Col, days: int = 7) -> Column:
    return F.to_date(col(date)) >= F.date_sub(F.to_date(col(as_of)), days)


def this_year(year: Col, as_of: Col) -> Column:
    return col(year).try_cast("int") == F.year(col(as_of))


def since_last_year(year: Col, as_of: Col) -> Column:
    return col(year).try_cast("int") >= F.year(col(as_of)) - 1


def parse_since(text: str | None) -> dt.datetime | None:
    """Strictly 'yyyy-MM-dd', 'yyyy-MM-dd HH:mm:ss' or ISO 8601; else an error."""
    if not text:
        return None
    for fmt in ("%Y-%m-%d %H:%M:%S", "%Y-%m-%d"):
        try:
            parsed = dt.datetime.strptime(text, fmt)
        except ValueError:
            continue
        if parsed.strftime(fmt) == text:
            return parsed
    if "T" in text:
        try:
            return dt.datetime.fromisoformat(text)
        except ValueError:
            pass
    raise ValueError(f"not a date: {text!r} (yyyy-MM-dd or yyyy-MM-dd HH:mm:ss)")
