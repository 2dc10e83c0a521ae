"""Outside verdicts: the stored ones, the replies, and what is still to be asked.

No model is called here.  Undecided rows leave as a worklist of prompts, replies
come back as a table, and a reply that cannot be read falls back the way each
classifier defines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.functions.text import blank_to_null, is_blank, publisher_normalise, text_of, trimmed
from gleanmill.functions.values import (
    institution_reply,
    only_true,
    relevant_unless_false,
    reply_rows,
    unless_boolean_false,
)
from gleanmill.operators.joins import attach_translations
from gleanmill.operators.lookup import attach
from gleanmill.operators.numbering import with_batches
from gleanmill.rules import vocabulary as V
from gleanmill.rules.cascades import news_body

FINAL_RULES = ("trial-drop", "roundup-drop")
TTL_DAYS = 30
BATCH = 25

_STORED = (
    "map<string,struct<verdict:string,relevant:boolean,academic:boolean,by:string,reason:string,"
    "decidedAt:string,at:string>>"
)


def stored_verdicts(bodies: DataFrame) -> DataFrame:
    """(classifier, body) with one JSON object per classifier to one row per key."""
    entries = bodies.select("classifier", F.explode(F.from_json("body", _STORED)).alias("key", "e"))
    return entries.select(
        "classifier",
        "key",
        F.coalesce("e.verdict", F.col("e.relevant").cast("string"), F.col("e.academic").cast("string")).alias("value"),
        F.col("e.by").alias("by"),
        F.col("e.reason").alias("reason"),
        F.coalesce(F.try_to_timestamp("e.decidedAt"), F.try_to_timestamp("e.at")).alias("decided_at"),
    )


def latest_verdicts(store: DataFrame) -> DataFrame:
    """One verdict per (classifier, key): the one decided last."""
    return (
        store.groupBy("classifier", "key")
        .agg(F.max_by(F.struct("value", "by", "reason", "decided_at"), F.coalesce("decided_at", F.to_timestamp(F.lit("1970-01-01")))).alias("_v"))
        .select("classifier", "key", "_v.*")
    )


def fresh(as_of: Column, at: str = "decided_at", days: int = TTL_DAYS) -> Column:
    """Kept at a flush: not older than the lifetime, or without a readable time."""
    return F.col(at).isNull() | (F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def _looked_up(
    rows: DataFrame, key: Column, classifier: str, store: DataFrame, replies: DataFrame, spread: str
) -> DataFrame:
    """Rows with the stored verdict (_s) and the reply text (_reply) of their key."""
    stored = latest_verdicts(store.where(F.col("classifier") == classifier)).select(
        F.col("key").alias("_key"), F.struct("value", "reason").alias("_s")
    )
    answers = (
        replies.where(F.col("classifier") == classifier)
        .groupBy(F.col("key").alias("_key"))
        .agg(F.max("reply_text").alias("_reply"))
    )
    known = stored.join(answers, "_key", "full_outer")
    return attach(rows.withColumn("_key", key), known, "_key", ["_s", "_reply"], [spread])


def confirm_news(
    rows: DataFrame,
    store: DataFrame,
    replies: DataFrame,
    rule: str = "rule",
    key: str = "verdict_key",
    enabled: bool = True,
    provider: bool = True,
    out: str = "verdict",
    seq: str = "seq",
) -> DataFrame:
    """Final verdict struct(relevant, by, reason, matched, rule_by).

    ``key`` (see functions.urls.verdict_key) is computed beforehand, so rows
    need not carry their text through the lookups.
    """
    r = F.col(rule)
    no_match = F.lit(None).cast("array<string>")

    def final(relevant: Column, by: Column, reason: Column, matched: Column) -> Column:
        return F.struct(
            relevant.alias("relevant"), by.alias("by"), reason.alias("reason"), matched.alias("matched"), r["by"].alias("rule_by")
        )

    unchanged = final(r["relevant"], r["by"], r["reason"], r["matched"])
    if not enabled:
        return rows.withColumn(out, unchanged)
    settled = r["by"].isin(*FINAL_RULES)
    if not provider:
        kept = r["relevant"]
        off = final(
            kept,
            F.when(kept, "llm-off").otherwise("rule-drop"),
            F.when(kept, V.NO_PROVIDER_REASON).otherwise(r["reason"]),
            r["matched"],
        )
        return rows.withColumn(out, F.when(settled, unchanged).otherwise(off))

    joined = _looked_up(rows, F.col(key), "news", store, replies, seq)
    reply = relevant_unless_false("_reply")
    stored = F.col("_s.value") == "true"
    verdict = (
        F.when(settled, unchanged)
        .when(F.col("_s").isNotNull(), final(stored, F.lit("llm-cache"), F.col("_s.reason"), no_match))
        .when(reply["ok"], final(reply["value"], F.when(reply["value"], "llm-keep").otherwise("llm-drop"), reply["reason"], no_match))
        .otherwise(final(r["relevant"], F.when(r["relevant"], "llm-error-keep").otherwise("rule-drop"), r["reason"], no_match))
    )
    return joined.withColumn(out, verdict).drop("_s", "_reply", "_key")


def _confirm(rows, rule, classifier, store, replies, field, reply, out, seq):
    joined = _looked_up(rows, title_publisher_key(), classifier, store, replies, seq)

    def made(value: Column, by: Column, reason: Column) -> Column:
        return F.struct(value.alias(field), by.alias("by"), reason.alias("reason"))

    verdict = F.coalesce(
        F.col(rule),
        F.when(F.col("_s").isNotNull(), made(F.col("_s.value") == "true", F.lit("cache"), F.col("_s.reason"))),
        F.when(reply["ok"], made(reply["value"], F.lit("llm"), reply["reason"])),
        made(F.lit(True), F.lit("llm-error-keep"), F.lit(None).cast("string")),
    )
    return joined.withColumn(out, verdict).drop("_s", "_reply", "_key")


def title_publisher_key(title: str = "title", publisher: str = "publisher") -> Column:
    return F.concat(trimmed(title), F.lit("|"), trimmed(publisher))


def confirm_topic(
    rows: DataFrame, store: DataFrame, replies: DataFrame, rule: str = "topic_rule", out: str = "topic", seq: str = "seq"
) -> DataFrame:
    return _confirm(rows, rule, "topic", store, replies, "relevant", only_true("_reply"), out, seq)


def confirm_academic(
    rows: DataFrame, store: DataFrame, replies: DataFrame, rule: str = "academic_rule", out: str = "academic", seq: str = "seq"
) -> DataFrame:
    return _confirm(rows, rule, "academic", store, replies, "academic", unless_boolean_false("_reply"), out, seq)


def confirm_institution(
    rows: DataFrame,
    store: DataFrame,
    replies: DataFrame,
    rule: str = "institution_rule",
    out: str = "classification",
    seq: str = "seq",
) -> DataFrame:
    joined = _looked_up(rows, publisher_normalise("publisher"), "publisher", store, replies, seq)
    cached = F.struct(F.col("_s.value").alias("verdict"), F.lit("cache").alias("by"))
    verdict = F.coalesce(F.col(rule), F.when(F.col("_s").isNotNull(), cached), institution_reply("_reply"))
    return joined.withColumn(out, verdict).drop("_s", "_reply", "_key")


def new_verdicts(confirmed: DataFrame, classifier: str, key: Column, verdict: str, field: str, decided_at: Column) -> DataFrame:
    """Replies worth storing; a failed reply is not, so the next run asks again."""
    v = F.col(verdict)
    fields = confirmed.schema[verdict].dataType.fieldNames()
    reason = v["reason"] if "reason" in fields else F.lit(None).cast("string")
    return (
        confirmed.where(v["by"].isin("llm", "llm-keep", "llm-drop", "llm-lowconf"))
        .select(
            F.lit(classifier).alias("classifier"),
            key.alias("key"),
            v[field].cast("string").alias("value"),
            v["by"].alias("by"),
            reason.alias("reason"),
            decided_at.alias("decided_at"),
        )
        .dropDuplicates(["classifier", "key"])
    )


# ---- worklists --------------------------------------------------------------

def _or_dash(value: str) -> Column:
    return F.coalesce(blank_to_null(value), F.lit("-"))


def news_prompts(confirmed: DataFrame, instruction: str, body_chars: int | None = None) -> DataFrame:
    """Prompt per article nobody decided yet: title, keywords, the body or its first ``body_chars``."""
    pending = confirmed.where(
        F.col("verdict.by").isin("llm-error-keep", "rule-drop") & ~F.col("verdict.rule_by").isin(*FINAL_RULES)
    )
    body = news_body("content") if body_chars is None else F.left(news_body("content"), F.lit(body_chars))
    words = F.array_join(F.coalesce("matched_keywords", F.array().cast("array<string>")), ", ")
    prompt = F.concat(
        F.lit(instruction + "\n\n[기사]\n제목: "), trimmed("title"),
        F.lit("\n매칭 키워드: "), F.when(words == "", "-").otherwise(words),
        F.lit("\n본문:\n"), F.when(body == "", "-").otherwise(body),
    )
    return pending.select(F.lit("news").alias("classifier"), F.col("verdict_key").alias("key"), prompt.alias("prompt")).dropDuplicates(["key"])


def bib_prompts(rows: DataFrame, classifier: str, verdict: str, instruction: str, extra: dict[str, str]) -> DataFrame:
    """Prompt per (title, publisher) whose verdict is only a fallback."""
    lines = [F.lit(instruction + "\n\n제목: "), F.col("title"), F.lit("\n발행기관: "), _or_dash("publisher")]
    for label, column in extra.items():
        lines += [F.lit(f"\n{label}: "), _or_dash(column)]
    return (
        rows.where(F.col(verdict)["by"] == "llm-error-keep")
        .select(F.lit(classifier).alias("classifier"), title_publisher_key().alias("key"), F.concat(*lines).alias("prompt"))
        .dropDuplicates(["key"])
    )


def publisher_prompts(rows: DataFrame, rule: str, store: DataFrame, instruction: str) -> DataFrame:
    """One prompt per undecided publisher."""
    names = rows.where(F.col(rule).isNull()).select(publisher_normalise("publisher").alias("key")).distinct()
    known = store.where(F.col("classifier") == "publisher").select("key")
    return names.join(known, "key", "left_anti").select(
        F.lit("publisher").alias("classifier"), "key",
        F.concat(F.lit(instruction + '\n발행기관: "'), F.col("key"), F.lit('"')).alias("prompt"),
    )


def theme_batches(titles: DataFrame, order: str, size: int = BATCH) -> DataFrame:
    """(order, title) rows with their batch and place in it."""
    return with_batches(titles, [order], size)


def theme_prompts(batched: DataFrame, instruction: str) -> DataFrame:
    """One prompt per batch; a batch never holds more than its fixed size."""
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("i", "title"))),
        lambda e: F.concat(e["i"].cast("string"), F.lit(". "), e["title"]),
    )
    themes = "\n".join(f"{n}. {t}" for n, t in enumerate(V.THEMES, 1))
    text = F.concat(F.lit(f"{instruction}\n\n[주제]\n{themes}\n\n[제목]\n"), F.array_join(listed, "\n"))
    return batched.groupBy("batch_id").agg(text.alias("prompt"))


def assign_themes(
    batched: DataFrame,
    replies: DataFrame,
    themes: tuple[str, ...] = V.THEMES,
    fallback: str = V.THEME_FALLBACK,
) -> DataFrame:
    """Theme per title: unknown, missing and out-of-range all fall back; last reply per place wins."""
    answers = (
        replies.select("batch_id", F.posexplode(reply_rows("reply_text")).alias("n", "e"))
        .withColumn("i", F.expr("try_cast(e.i as double)"))
        .where(F.col("i") == F.floor("i"))
        .groupBy("batch_id", F.col("i").cast("long").alias("i"))
        .agg(F.max_by(trimmed("e.theme"), "n").alias("_theme"))
    )
    known = F.when(F.col("_theme").isin(*themes), F.col("_theme"))
    return batched.join(answers, ["batch_id", "i"], "left").withColumn("theme", F.coalesce(known, F.lit(fallback))).drop("_theme")


def translation_worklist(rows: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """(key, field, text) of every source text whose English is missing."""
    entries = [
        F.when(~is_blank(source) & is_blank(english), F.struct(F.lit(source).alias("field"), F.col(source).alias("text")))
        for source, english in fields.items()
    ]
    return rows.select(key, F.inline(F.array_compact(F.array(*entries))))


# Fields a translation may fill; names of people are never translated.
TRANSLATED = ("title", "publisher", "summary")


def english_fields(rows: DataFrame, translations: DataFrame, key: str) -> DataFrame:
    """Rows with their translations attached and merged."""
    return with_english(attach_translations(rows, translations, key, TRANSLATED))


def with_english(rows: DataFrame) -> DataFrame:
    """English the source gave is kept; what is missing takes the attached translation."""
    return rows.withColumns({
        "title_en": F.coalesce(blank_to_null("title_en"), F.col("title_translated")),
        "summary_en": F.coalesce(blank_to_null("summary_en"), F.col("summary_translated")),
        "author_en": blank_to_null("author_en"),
        "publisher_en": F.col("publisher_translated"),
    }).drop(*[field + "_translated" for field in TRANSLATED])
