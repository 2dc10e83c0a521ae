"""Ordered cascades: the first rule that applies decides, and says so."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.patterns import any_of, escape, java, keyword_pattern
from gleanmill.functions.text import Col, col, publisher_normalise, text_of, trimmed
from gleanmill.rules import vocabulary as V
from gleanmill.rules.pack import RulePack

_NO_TEXTS = "array<string>"


@dataclass(frozen=True)
class NewsRules:
    """Patterns and switches of the news cascade."""

    roundup: str = V.ROUNDUP_HEADS
    correction: str = V.CORRECTION_PREFIX
    trial: RulePack = V.TRIAL_TERMS
    core: RulePack = V.CORE_TERMS
    anchors: RulePack = V.HOME_ANCHORS
    foreign: RulePack = V.FOREIGN_TERMS
    ambiguous: RulePack = V.AMBIGUOUS_TERMS
    filter_on: bool = True
    trial_on: bool = True
    roundup_on: bool = True

    def switched(self, **switches: bool) -> NewsRules:
        return replace(self, **switches)


def _news(relevant: bool, by: str, reason: Column | None = None, matched: Column | None = None) -> Column:
    nothing = F.lit(None)
    return F.struct(
        F.lit(relevant).alias("relevant"),
        F.lit(by).alias("by"),
        (nothing.cast("string") if reason is None else reason).alias("reason"),
        (nothing.cast(_NO_TEXTS) if matched is None else matched).alias("matched"),
    )


def news_body(content: Col) -> Column:
    return F.replace(text_of(content), F.lit("<br>"), F.lit("\n"))


def news_rule(title: Col, content: Col, rules: NewsRules = NewsRules()) -> Column:
    """struct(relevant, by, reason, matched) of the free, repeatable rules."""
    head_line, body = text_of(title), news_body(content)
    return _news_verdict(head_line, body, F.concat(head_line, F.lit("\n"), body), rules)


def with_news_rule(
    rows: DataFrame, title: str, content: str, rules: NewsRules = NewsRules(), out: str = "rule"
) -> DataFrame:
    """news_rule as a column; the joined text is built once per row, not once per rule."""
    prepared = rows.withColumns({"_head": text_of(title), "_body": news_body(content)}).withColumn(
        "_text", F.concat("_head", F.lit("\n"), "_body")
    )
    verdict = _news_verdict(F.col("_head"), F.col("_body"), F.col("_text"), rules)
    return prepared.withColumn(out, verdict).drop("_head", "_body", "_text")


def _news_verdict(head_line: Column, body: Column, text: Column, rules: NewsRules) -> Column:
    branches: list[tuple[Column, Column]] = []

    if rules.roundup_on:
        plain = F.regexp_replace(head_line, java(rules.correction), "")
        head = F.regexp_extract(plain, java(rules.roundup), 1)
        reason = F.format_string(V.ROUNDUP_REASON, head)
        branches.append((head != "", _news(False, "roundup-drop", reason, F.array(head))))
    if rules.trial_on:
        trial, core = rules.trial.first_match(head_line), rules.core.first_match(body)
        applies = rules.trial.test(head_line) & ~rules.core.test(head_line) & rules.core.test(body)
        reason = F.format_string(V.TRIAL_REASON, trial, core)
        branches.append((applies, _news(False, "trial-drop", reason, F.array(trial, core))))
    if not rules.filter_on:
        branches.append((F.lit(True), _news(True, "filter-off")))
    else:
        labels, unsure = rules.foreign.labels(text), rules.ambiguous.first_matches(text)
        branches += [
            (rules.anchors.test(text), _news(True, "anchor-keep")),
            (
                rules.foreign.test(text),
                _news(False, "rule-drop", F.format_string(V.FOREIGN_REASON, F.array_join(labels, ", ")), labels),
            ),
            (
                rules.ambiguous.test(text),
                _news(True, "ambiguous-keep", F.format_string(V.AMBIGUOUS_REASON, F.array_join(unsure, ", ")), unsure),
            ),
        ]
    verdict = F
    for test, outcome in branches:
        verdict = verdict.when(test, outcome)
    return verdict.otherwise(_news(True, "default-keep"))


# ---- bibliographic topic ----------------------------------------------------

def bib_rule(title: Col, noise: RulePack = V.BIB_NOISE, core: RulePack = V.BIB_CORE) -> Column:
    """struct(relevant, by, reason), or null when the rules leave it open."""
    t = trimmed(title)
    drop = F.struct(F.lit(False).alias("relevant"), F.lit("rule-drop").alias("by"), noise.first_label(t).alias("reason"))
    keep = F.struct(F.lit(True).alias("relevant"), F.lit("rule-keep").alias("by"), F.lit(None).cast("string").alias("reason"))
    return F.when(noise.test(t), drop).when(core.test(t), keep)


# ---- scholarly or not -------------------------------------------------------

@dataclass(frozen=True)
class AcademicRules:
    publishers: RulePack = V.NON_ACADEMIC_PUBLISHERS
    titles: RulePack = V.NON_ACADEMIC_TITLES
    journals: RulePack = V.ACADEMIC_JOURNALS
    exempt: Sequence[str] = V.EXEMPT_SOURCES
    trusted: Sequence[str] = V.TRUSTED_SOURCES


def academic_rule(
    source: Col, title: Col, publisher: Col, journal: Col, material_type: Col, rules: AcademicRules = AcademicRules()
) -> Column:
    """struct(academic, by, reason), or null when the rules leave it open."""
    name, t, j = trimmed(publisher), trimmed(title), trimmed(journal)

    def outcome(academic: bool, by: str, reason: Column | None = None) -> Column:
        return F.struct(
            F.lit(academic).alias("academic"),
            F.lit(by).alias("by"),
            (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
        )

    return (
        F.when(rules.publishers.test(name), outcome(False, "rule-publisher", F.format_string(V.PUBLISHER_REASON, name)))
        .when(col(source).isin(*rules.exempt), outcome(True, "rule-exempt", F.lit(V.EXEMPT_SOURCE_REASON)))
        .when(col(material_type) == "book", outcome(True, "rule-exempt", F.lit(V.BOOK_REASON)))
        .when(col(source).isin(*rules.trusted), outcome(True, "source-flag"))
        .when(rules.titles.test(t), outcome(False, "rule-title", rules.titles.first_label(t)))
        .when((j != "") & rules.journals.test(j), outcome(True, "rule-journal", j))
    )


# ---- institutions -----------------------------------------------------------

@dataclass(frozen=True)
class InstitutionRules:
    """Dictionaries as (names); patterns as packs, tried in this order."""

    private_names: Sequence[str] = V.PRIVATE_INSTITUTIONS
    gov_names: Sequence[str] = V.GOV_INSTITUTIONS
    gov_prefixes: RulePack = V.GOV_PREFIXES
    private: RulePack = V.PRIVATE_PATTERNS
    gov: RulePack = V.GOV_PATTERNS


def institution_rule(publisher: Col, rules: InstitutionRules = InstitutionRules()) -> Column:
    """struct(verdict, by) by dictionary and patterns, null when open.

    Every test reads one short string, so it runs where the row already is: a
    map-only pass costs less than a shuffle to distinct publishers and back,
    and no publisher can be hot.
    """
    name = publisher_normalise(publisher)
    private_names = any_of(escape(n) for n in rules.private_names)
    gov_names = any_of(escape(n) for n in rules.gov_names)

    def outcome(verdict: str, by: str) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(by).alias("by"))

    return (
        F.when(name == "", outcome("PRIVATE", "default"))
        .when(name.rlike(rf"^(?:{private_names})(?: |\z)| (?:{private_names})\z"), outcome("PRIVATE", "dict"))
        .when(name.rlike(rf"^(?:{gov_names})(?: |\z)"), outcome("GOV", "dict"))
        .when(rules.gov_prefixes.test(name), outcome("GOV", "pattern"))
        .when(rules.private.test(name), outcome("PRIVATE", "pattern"))
        .when(rules.gov.test(name), outcome("GOV", "pattern"))
    )


# ---- menus and kinds --------------------------------------------------------

def menu_of(material_type: Col, verdict: Col) -> Column:
    return F.when(col(verdict) == "GOV", "PUBLICATIONS").when(col(material_type) == "book", "BOOKS").otherwise("PAPERS")


def known_menu(menu: Col) -> Column:
    """Unknown menus are reported as papers."""
    return F.when(col(menu).isin(*V.MENUS), col(menu)).otherwise("PAPERS")


def article_or_thesis(target: Col, db_code: Col, source_id: Col, degree: Col) -> Column:
    thesis = (F.upper(text_of(db_code)) == "DIKO") | F.startswith(text_of(source_id), F.lit("DIKO")) | (text_of(degree) != "")
    return F.when(col(target) == "REPORT", "report").when(thesis, "thesis").otherwise("article")


def register_kind(register_no: Col) -> Column:
    """Letter after the colon of a register number."""
    return F.upper(F.substring(F.get(F.split(text_of(register_no), ":", -1), F.lit(1)), 1, 1))


def material_by_register(register_no: Col) -> Column:
    kind = register_kind(register_no)
    return F.when(kind == "U", "book").when(kind == "T", "thesis").otherwise("article")


# ---- page gates -------------------------------------------------------------

def page_topic_ok(
    title: Col, content: Col, has_media: Col, from_keyword: Col, keywords: Sequence[str] | None = None, default: str = "dmz"
) -> Column:
    """Before the first media target the title or content must be on topic."""
    pattern = keyword_pattern(keywords) if keywords else keyword_pattern([default])
    on_topic = text_of(title).rlike(pattern) | text_of(content).rlike(pattern)
    return F.when(col(has_media) & ~col(from_keyword), on_topic).otherwise(True)


def two_hit(text: Col, triggers: Sequence[str] = V.TRIGGER_WORDS, context: Sequence[str] = V.CONTEXT_WORDS) -> Column:
    """struct(passed, matched): after a trigger word two context words are needed."""
    t = text_of(text)
    hits = F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in context]))
    triggered = F.lit(False)
    for word in triggers:
        triggered = triggered | F.contains(t, F.lit(word))
    matched = F.when(triggered, hits).otherwise(F.array().cast(_NO_TEXTS))
    return F.struct((~triggered | (F.size(matched) >= 2)).alias("passed"), matched.alias("matched"))


def link_allowed(
    link: Col, page_host: Col, host: str, parts: Sequence[str], skip: str = "sections-offices/"
) -> Column:
    """For one host only links with a listed path part; one path fragment nowhere."""
    listed = text_of(link).rlike(any_of(escape(p) for p in parts))
    return (F.coalesce(col(page_host) != host, F.lit(True)) | listed) & ~F.contains(text_of(link), F.lit(skip))
