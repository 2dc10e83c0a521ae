"""Rules, verdicts and gates.  Packs use words of the tables' own languages."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.functions import text as X
from gleanmill.functions import values as A
from gleanmill.operators import rollups as G
from gleanmill.operators import verdicts as R
from gleanmill.plans import collect
from gleanmill.queries.registry import SQL, query, words
from gleanmill.rules import cascades as C
from gleanmill.rules import vocabulary as V
from gleanmill.rules.pack import Rule, RulePack
from gleanmill.schemas import VERDICT
from gleanmill.session import cut_lineage, shared_dir, table

TERMS = ("the", "that", "oui", "nicht", "para", "license")
REPLY = "classifier string, key string, reply_text string"

RULES = C.NewsRules(
    correction=r"^[A-Z]+\. ",
    roundup=r"^(Is|Thht|Das|Les) ",
    trial=RulePack.of("the|der|les|con"),
    core=RulePack.of("nicht|oui|license", ignore_case=True),
    anchors=RulePack.of("para|onwh", "eau$"),
    foreign=RulePack((
        Rule("that", "that"), Rule("worthless", "junk"), Rule("AND ", "and", ignore_case=True),
    )),
    ambiguous=RulePack.of("with|from", "une|dans", "sch[a-z]+"),
)

# the same rules as SQL over d(doc_id, title, body), one line per branch
_TEXT = "(title || chr(10) || body)"
_LABELS = (
    "array_to_string([x for x in [CASE WHEN regexp_matches(t, 'that') THEN 'that' END, "
    "CASE WHEN regexp_matches(t, 'worthless') THEN 'junk' END, "
    "CASE WHEN regexp_matches(t, 'AND ', 'i') THEN 'and' END] if x is not null], ', ')"
)
_UNSURE = (
    "array_to_string([x for x in [regexp_extract(t, 'with|from'), regexp_extract(t, 'une|dans'), "
    "regexp_extract(t, 'sch[a-z]+')] if x <> ''], ', ')"
)
_HEAD = "regexp_extract(regexp_replace(title, '^[A-Z]+\\. ', ''), '^(Is|Thht|Das|Les) ', 1)"
_TRIAL = "regexp_extract(title, 'the|der|les|con')"
_CORE = "regexp_extract(body, 'nicht|oui|license', 0, 'i')"
NEWS_SQL = f"""
d AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS body FROM documents),
e AS (SELECT *, {_TEXT} AS t FROM d),
f AS (SELECT *, {_HEAD} AS head, {_TRIAL} AS trial, {_CORE} AS core, {_LABELS} AS labels, {_UNSURE} AS unsure FROM e),
g AS (SELECT *, CASE
    WHEN head <> '' THEN 'roundup-drop'
    WHEN trial <> '' AND core <> '' AND NOT regexp_matches(title, 'nicht|oui|license', 'i') THEN 'trial-drop'
    WHEN regexp_matches(t, '(para|onwh)|(eau$)') THEN 'anchor-keep'
    WHEN labels <> '' THEN 'rule-drop'
    WHEN unsure <> '' THEN 'ambiguous-keep'
    ELSE 'default-keep' END AS rule_by FROM f),
ruled AS (SELECT doc_id, title, body, rule_by, rule_by LIKE '%-keep' AS rule_relevant,
    CASE rule_by
        WHEN 'roundup-drop' THEN format('{V.ROUNDUP_REASON.replace("%s", "{}")}', head)
        WHEN 'trial-drop' THEN format('{V.TRIAL_REASON.replace("%s", "{}").replace("'", "''")}', trial, core)
        WHEN 'rule-drop' THEN format('{V.FOREIGN_REASON.replace("%s", "{}")}', labels)
        WHEN 'ambiguous-keep' THEN format('{V.AMBIGUOUS_REASON.replace("%s", "{}")}', unsure)
    END AS rule_reason,
    CASE rule_by
        WHEN 'roundup-drop' THEN head WHEN 'trial-drop' THEN trial || ', ' || core
        WHEN 'rule-drop' THEN labels WHEN 'ambiguous-keep' THEN unsure
    END AS rule_matched FROM g)
"""


def no_verdicts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], VERDICT)


def no_replies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REPLY)


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as articles: the first line is the title."""
    return table(spark, folder, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content")
    )


def label_store(spark: SparkSession, folder: str) -> DataFrame:
    """Toxic-labelled documents as stored verdicts, as if decided earlier."""
    labels = table(spark, folder, "labels").where("toxic = 1")
    return labels.select(
        F.lit("news").alias("classifier"),
        F.col("doc_id").cast("string").alias("key"),
        (F.col("quality") == 1).cast("string").alias("value"),
        F.lit("llm").alias("by"),
        F.concat(F.lit("q"), F.col("quality").cast("string")).alias("reason"),
        F.to_timestamp(F.lit("2026-01-01 00:00:00")).alias("decided_at"),
    )


def label_replies(spark: SparkSession, folder: str) -> DataFrame:
    """The other labels as reply texts; half of the readable shape, half not."""
    labels = table(spark, folder, "labels").where("toxic = 0")
    good = F.concat(F.lit('so: {"relevant": '), (F.col("quality") == 1).cast("string"), F.lit(', "reason": "from label"} end'))
    return labels.select(
        F.lit("news").alias("classifier"),
        F.col("doc_id").cast("string").alias("key"),
        F.when(F.col("doc_id") % 2 == 0, good).otherwise("no json here").alias("reply_text"),
    )


@query(f"SELECT doc_id, array_to_string([k for k in {words(TERMS)} if contains(upper(text), upper(k))], ',') AS matched FROM documents")
def q_keyword_match(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(X.matched_keywords("text", TERMS), ",").alias("matched")
    )


@query("""
SELECT lang, count(*) AS n FROM documents
WHERE contains(upper(text), 'OUI') OR contains(upper(text), 'NICHT') OR contains(upper(text), 'LICENSE') GROUP BY lang""")
def q_keyword_gate(spark, folder):
    gated = table(spark, folder, "documents").where(X.has_keyword("text", ("oui", "nicht", "license")))
    return gated.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {NEWS_SQL}
SELECT doc_id, rule_relevant AS relevant, rule_by AS "by", coalesce(rule_reason, '') AS reason, coalesce(rule_matched, '') AS matched FROM ruled""")
def q_news_rules(spark, folder):
    rows = C.with_news_rule(articles(spark, folder), "title", "content", RULES, "r")
    return rows.select(
        "doc_id", "r.relevant", "r.by", F.coalesce("r.reason", F.lit("")).alias("reason"),
        F.coalesce(F.array_join("r.matched", ", "), F.lit("")).alias("matched"),
    )


_FINAL_SQL = f"""
{NEWS_SQL},
judged AS (SELECT r.*, CASE
        WHEN rule_by IN ('trial-drop', 'roundup-drop') THEN rule_by
        WHEN l.toxic = 1 THEN 'llm-cache'
        WHEN l.toxic = 0 AND r.doc_id % 2 = 0 THEN CASE WHEN l.quality = 1 THEN 'llm-keep' ELSE 'llm-drop' END
        WHEN rule_relevant THEN 'llm-error-keep' ELSE 'rule-drop' END AS "by", l.quality
    FROM ruled r LEFT JOIN labels l USING (doc_id)),
final AS (SELECT doc_id, title, body, "by", rule_by, rule_reason, quality, CASE
        WHEN "by" IN ('trial-drop', 'roundup-drop', 'rule-drop', 'llm-drop') THEN false
        WHEN "by" = 'llm-cache' THEN quality = 1 ELSE true END AS relevant FROM judged)
"""


@query(f"""
WITH {_FINAL_SQL}
SELECT doc_id, "by", rule_by, relevant, coalesce(CASE
        WHEN "by" = 'llm-cache' THEN 'q' || quality WHEN "by" IN ('llm-keep', 'llm-drop') THEN 'from label'
        ELSE rule_reason END, '') AS reason FROM final""")
def q_final_verdict(spark, folder):
    ruled = C.with_news_rule(articles(spark, folder), "title", "content", RULES).select(
        "doc_id", "rule", F.col("doc_id").cast("string").alias("verdict_key")
    )
    out = R.confirm_news(cut_lineage(ruled), label_store(spark, folder), label_replies(spark, folder), seq="doc_id")
    return out.select(
        "doc_id", "verdict.by", "verdict.rule_by", "verdict.relevant", F.coalesce("verdict.reason", F.lit("")).alias("reason")
    )


def judged_documents(spark, folder):
    """The collection job over documents: equal texts are one article."""
    rows = table(spark, folder, "documents").select(
        F.col("doc_id").alias("seq"),
        F.md5("text").alias("guid"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id").cast("string")).alias("link"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        X.matched_keywords("text", TERMS).alias("matched_keywords"),
    )
    by_text = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("digest"))
    firsts = by_text.groupBy("digest").agg(F.min_by("id", F.col("id").cast("long")).alias("id"))
    to_digest = lambda frame: frame.join(firsts, frame["key"] == firsts["id"]).drop("id", "key").withColumnRenamed("digest", "key")
    stored = table(spark, folder, "documents").where("lang = 'de'").select(F.md5("text").alias("identity"))
    return collect.decisions(
        rows, stored, to_digest(label_store(spark, folder)), to_digest(label_replies(spark, folder)), rules=RULES
    )


_STATUS_SQL = f"""
WITH {_FINAL_SQL},
marked AS (SELECT d.doc_id, d.text, len([k for k in {words(TERMS)} if contains(upper(d.text), upper(k))]) > 0 AS hit,
        f.by, f.relevant FROM documents d JOIN final f USING (doc_id)),
ordered AS (SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY text, hit ORDER BY doc_id) END AS rn,
        EXISTS (SELECT 1 FROM documents x WHERE x.lang = 'de' AND x.text = marked.text) AS stored FROM marked),
status AS (SELECT *, CASE WHEN NOT hit THEN 'no_keyword' WHEN rn > 1 THEN 'duplicate' WHEN stored THEN 'existing'
        WHEN NOT relevant THEN 'irrelevant' ELSE 'saved' END AS status FROM ordered)
"""


@query(_STATUS_SQL + """
SELECT count(*) AS total_items, count(*) FILTER (hit) AS keyword_matched,
    count(*) FILTER (status IN ('duplicate', 'existing')) AS skipped_duplicate,
    count(*) FILTER (status = 'irrelevant') AS skipped_irrelevant,
    count(*) FILTER (status IN ('irrelevant', 'saved') AND "by" LIKE 'llm-%') AS llm_checked,
    count(*) FILTER (status IN ('irrelevant', 'saved') AND "by" = 'llm-drop') AS llm_dropped,
    count(*) FILTER (status IN ('irrelevant', 'saved') AND "by" = 'trial-drop') AS trial_dropped,
    count(*) FILTER (status IN ('irrelevant', 'saved') AND "by" = 'roundup-drop') AS roundup_dropped,
    count(*) FILTER (status = 'saved') AS saved FROM status""")
def q_status_summary(spark, folder):
    return collect.collect_summary(judged_documents(spark, folder))


@query(SQL["q_status_summary"])
def q_written_summary(spark, folder):
    """The same summary, counted while the decisions are written."""
    return collect.write_collected(judged_documents(spark, folder), f"{shared_dir(spark).rstrip('/')}/collected-{uuid.uuid4().hex}")


@query(_STATUS_SQL + """
SELECT status, CASE WHEN status IN ('irrelevant', 'saved') THEN "by" ELSE '' END AS "by", count(*) AS n FROM status GROUP BY 1, 2""")
def q_status_by_reason(spark, folder):
    """On-topic documents by the rule that decided, without duplicates: the flagship."""
    judged = judged_documents(spark, folder)
    by = F.when(F.col("status").isin("irrelevant", "saved"), F.col("verdict.by")).otherwise("")
    return judged.groupBy("status", by.alias("by")).agg(F.count(F.lit(1)).alias("n"))


BIB_NOISE = RulePack((Rule("bolt", "bolt"), Rule("^hot ", "hot start")))
BIB_CORE = RulePack.of("red|BLUE", ignore_case=True)


def part_verdicts(spark, folder):
    """Stored verdicts for (name, brand) pairs that exist as ECONOMY parts; replies for SMALL ones."""
    part = table(spark, folder, "part")
    key = F.concat("p_name", F.lit("|"), "p_brand").alias("key")
    store = part.where("p_type = 'ECONOMY'").select(
        F.lit("topic").alias("classifier"), key, F.lit("false").alias("value"), F.lit("llm").alias("by"),
        F.lit("seen").alias("reason"), F.to_timestamp(F.lit("2026-01-01")).alias("decided_at"),
    )
    replies = part.where("p_type = 'SMALL'").select(
        F.lit("topic").alias("classifier"), key, F.lit('{"relevant": true, "reason": "small"}').alias("reply_text")
    )
    return store, replies


_PART_KEYS = """
economy AS (SELECT DISTINCT p_name || '|' || p_brand AS key FROM part WHERE p_type = 'ECONOMY'),
small AS (SELECT DISTINCT p_name || '|' || p_brand AS key FROM part WHERE p_type = 'SMALL')
"""


@query(f"""
WITH {_PART_KEYS},
r AS (SELECT p_partkey, CASE
        WHEN regexp_matches(p_name, 'bolt|^hot ') THEN 'rule-drop'
        WHEN regexp_matches(p_name, 'red|BLUE', 'i') THEN 'rule-keep'
        WHEN p_name || '|' || p_brand IN (SELECT key FROM economy) THEN 'cache'
        WHEN p_name || '|' || p_brand IN (SELECT key FROM small) THEN 'llm'
        ELSE 'llm-error-keep' END AS "by", p_name FROM part)
SELECT p_partkey, "by", "by" NOT IN ('rule-drop', 'cache') AS relevant, CASE
    WHEN "by" = 'rule-drop' AND contains(p_name, 'bolt') THEN 'bolt' WHEN "by" = 'rule-drop' THEN 'hot start'
    WHEN "by" = 'cache' THEN 'seen' WHEN "by" = 'llm' THEN 'small' ELSE '' END AS reason FROM r""")
def q_bib_relevance(spark, folder):
    rows = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
        C.bib_rule("p_name", BIB_NOISE, BIB_CORE).alias("topic_rule"),
    )
    store, replies = part_verdicts(spark, folder)
    out = R.confirm_topic(rows, store, replies, seq="p_partkey")
    return out.select("p_partkey", "topic.by", "topic.relevant", F.coalesce("topic.reason", F.lit("")).alias("reason"))


ACADEMIC = C.AcademicRules(
    publishers=RulePack.of("#1$", "#2[0-3]"),
    titles=RulePack((Rule("widget", "widget"), Rule("[(<]|gear", "gear"))),
    journals=RulePack.of("LARGE$", "medi", ignore_case=True),
)


@query(f"""
WITH r AS (SELECT p_partkey, p_brand, p_type, CASE
    WHEN regexp_matches(p_brand, '#1$|#2[0-3]') THEN 'rule-publisher'
    WHEN p_type = 'PROMO' OR p_size > 45 THEN 'rule-exempt'
    WHEN p_type = 'STANDARD' THEN 'source-flag'
    WHEN regexp_matches(p_name, 'widget|gear') THEN 'rule-title'
    WHEN regexp_matches(p_type, 'LARGE$|medi', 'i') THEN 'rule-journal'
    ELSE 'llm-error-keep' END AS "by", p_name FROM part)
SELECT p_partkey, "by", "by" NOT IN ('rule-publisher', 'rule-title') AS academic, CASE
    WHEN "by" = 'rule-publisher' THEN '{V.PUBLISHER_REASON.replace("%s", "")}' || p_brand
    WHEN "by" = 'rule-exempt' AND p_type = 'PROMO' THEN '{V.EXEMPT_SOURCE_REASON}' WHEN "by" = 'rule-exempt' THEN '{V.BOOK_REASON}'
    WHEN "by" = 'rule-title' AND contains(p_name, 'widget') THEN 'widget' WHEN "by" = 'rule-title' THEN 'gear'
    WHEN "by" = 'rule-journal' THEN p_type ELSE '' END AS reason FROM r""")
def q_academic(spark, folder):
    source = F.when(F.col("p_type") == "PROMO", "encykorea").when(F.col("p_type") == "STANDARD", "kci").otherwise("losi")
    kind = F.when(F.col("p_size") > 45, "book").otherwise("article")
    rows = table(spark, folder, "part").select(
        "p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("publisher"),
        C.academic_rule(source, "p_name", "p_brand", "p_type", kind, ACADEMIC).alias("academic_rule"),
    )
    out = R.confirm_academic(rows, no_verdicts(spark), no_replies(spark), seq="p_partkey")
    return out.select("p_partkey", "academic.by", "academic.academic", F.coalesce("academic.reason", F.lit("")).alias("reason"))


INSTITUTIONS = C.InstitutionRules(
    private_names=("Supplier#000000001", "Customer#000000007"),
    gov_names=("Supplier#000000002", "Customer#000000008"),
    gov_prefixes=RulePack.of("^Supplier#00000001"),
    private=RulePack.of("[13579]$"),
    gov=RulePack.of("^Customer"),
)


@query("""
WITH n AS (SELECT 'S' || s_suppkey AS id, s_name AS name, s_acctbal AS bal FROM supplier
    UNION ALL SELECT 'C' || c_custkey, c_name || ' branch', c_acctbal FROM customer),
r AS (SELECT id, CASE
    WHEN name IN ('Supplier#000000001', 'Customer#000000007 branch') THEN 'PRIVATE dict'
    WHEN name IN ('Supplier#000000002', 'Customer#000000008 branch') THEN 'GOV dict'
    WHEN starts_with(name, 'Supplier#00000001') THEN 'GOV pattern'
    WHEN regexp_matches(name, '[13579]$') THEN 'PRIVATE pattern'
    WHEN starts_with(name, 'Customer') THEN 'GOV pattern'
    WHEN bal < 3000 THEN 'GOV cache' ELSE 'PRIVATE default' END AS v FROM n)
SELECT id, split_part(v, ' ', 1) AS verdict, split_part(v, ' ', 2) AS "by" FROM r""")
def q_publisher_class(spark, folder):
    supplier = table(spark, folder, "supplier")
    customer = table(spark, folder, "customer")
    names = supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("(재)  "), "s_name").alias("publisher")
    ).unionByName(customer.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit(" "), "c_name", F.lit("   branch ")).alias("publisher")
    ))
    store = supplier.where("s_acctbal < 3000").select(
        F.lit("publisher").alias("classifier"), F.col("s_name").alias("key"), F.lit("GOV").alias("value"),
        F.lit("llm").alias("by"), F.lit("").alias("reason"), F.to_timestamp(F.lit("2026-01-01")).alias("decided_at"),
    )
    ruled = names.withColumn("institution_rule", C.institution_rule("publisher", INSTITUTIONS))
    out = R.confirm_institution(ruled, store, no_replies(spark), seq="id")
    return out.select("id", "classification.verdict", "classification.by")


@query("""
SELECT p_partkey, CASE WHEN p_brand LIKE '%5' THEN 'PUBLICATIONS' WHEN p_type = 'ECONOMY' THEN 'BOOKS' ELSE 'PAPERS' END AS menu_id,
    CASE substr(p_type, 1, 1) WHEN 'U' THEN 'book' WHEN 'T' THEN 'thesis' ELSE 'article' END AS by_register,
    CASE WHEN p_type = 'PROMO' THEN 'report' WHEN p_brand = 'DIKO' OR p_size > 40 THEN 'thesis' ELSE 'article' END AS by_code FROM part""")
def q_menu(spark, folder):
    verdict = F.when(F.col("p_brand").like("%5"), "GOV").otherwise("PRIVATE")
    kind = F.when(F.col("p_type") == "ECONOMY", "book").otherwise("article")
    register = F.concat(F.lit("RISS:"), "p_type", F.col("p_partkey").cast("string"))
    return table(spark, folder, "part").select(
        "p_partkey",
        C.menu_of(kind, verdict).alias("menu_id"),
        C.material_by_register(register).alias("by_register"),
        C.article_or_thesis(
            F.when(F.col("p_type") == "PROMO", "REPORT").otherwise("ARTI"), "p_brand", "p_name",
            F.when(F.col("p_size") > 40, "master").otherwise(""),
        ).alias("by_code"),
    )


GATE = ("onwh", "reau(", "eau+")


@query(r"""
WITH p AS (SELECT page_id, url, html, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        regexp_replace(html, '<[^>]+>', '', 'g') AS content FROM pages)
SELECT page_id, CASE WHEN contains(html, '<h1>') AND NOT contains(url, '?')
    THEN regexp_matches(title, 'onwh|reau\(|eau\+', 'i') OR regexp_matches(content, 'onwh|reau\(|eau\+', 'i') ELSE true END AS ok FROM p""")
def q_page_gate(spark, folder):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, folder, "pages").select(
        "page_id",
        C.page_topic_ok(
            title, X.strip_tags("html"), F.contains("html", F.lit("<h1>")), F.contains("url", F.lit("?")), GATE
        ).alias("ok"),
    )


TRIGGERS = ("the", "der", "que ")
CONTEXT = ("nicht", "worthless", "license", "onwh", "para ", "eau", "enco", "thht")
_TWO_SQL = f"""
WITH m AS (SELECT doc_id, text, regexp_matches(text, 'the|der|que ') AS triggered,
        [k for k in {words(CONTEXT)} if contains(text, k)] AS hits FROM documents),
t AS (SELECT doc_id, NOT triggered OR len(hits) >= 2 AS passed, CASE WHEN triggered THEN array_to_string(hits, ',') ELSE '' END AS matched FROM m)
"""


@query(_TWO_SQL + "SELECT doc_id, passed, matched FROM t")
def q_two_hit(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", C.two_hit("text", TRIGGERS, CONTEXT).alias("r"))
    return rows.select("doc_id", "r.passed", F.array_join("r.matched", ",").alias("matched"))


@query(_TWO_SQL + "SELECT count(*) AS all_count, count(*) FILTER (passed) AS pass_count, count(*) FILTER (NOT passed) AS exception_count FROM t")
def q_pass_counts(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return G.pass_and_exception(rows, C.two_hit("text", TRIGGERS, CONTEXT)["passed"])[0]


THETA = RulePack((
    Rule("th[aeiou]", "th-vowel"), Rule("ung|sch", "german"), Rule("(eau|oui){2}", "french"),
    Rule("[0-9]{3}", "digits"), Rule("license|LICENSE", "license"), Rule("^[A-Z][a-z]+ent", "first word"),
))


@query("""
SELECT doc_id, label AS rule FROM documents JOIN (VALUES ('th-vowel', 'th[aeiou]'), ('german', 'ung|sch'),
    ('french', '(eau|oui){2}'), ('digits', '[0-9]{3}'), ('license', 'license|LICENSE'), ('first word', '^[A-Z][a-z]+ent')) r(label, pattern)
ON regexp_matches(text, pattern)""")
def q_rule_theta(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return THETA.matching_rules(rows, "text").select("doc_id", "rule")


@query("""
WITH m AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'nothing' ELSE 'so ' || props || ' done' END AS reply,
    json_extract_string(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, reply <> 'nothing' AS ok, reply = 'nothing' OR k <> 7 AS kept, CASE WHEN reply = 'nothing' THEN -1 ELSE k END AS k FROM m""")
def q_reply_parse(spark, folder):
    reply = F.when(F.col("event_type") == "error", "nothing").otherwise(F.concat(F.lit("so "), "props", F.lit(" done")))
    parsed = A.reply_object(reply)
    number = F.coalesce(F.try_variant_get(parsed, "$.k", "bigint"), F.lit(-1).cast("long"))
    # the truth rule on a reply that says false for one value
    flagged = F.when(number == 7, '{"relevant": " False "}').when(number == 8, '{"relevant": 0}').otherwise(reply)
    rows = table(spark, folder, "events").select("event_id", reply.alias("reply"), number.alias("k"), flagged.alias("flagged"))
    return rows.select(
        "event_id",
        A.relevant_unless_false("reply")["ok"].alias("ok"),
        A.relevant_unless_false("flagged")["value"].alias("kept"),
        "k",
    )


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE event_type = 'error' OR ts >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY""")
def q_ttl(spark, folder):
    rows = table(spark, folder, "events").withColumn("decided_at", F.when(F.col("event_type") != "error", F.col("ts")))
    kept = rows.where(R.fresh(F.to_timestamp(F.lit("2024-02-10 00:00:00"))))
    return kept.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("""
WITH s AS (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'news' ELSE 'topic' END AS classifier, user_id AS key, event_id, value, ts FROM events)
SELECT classifier, key, arg_max(event_id, ts) AS event_id FROM s GROUP BY 1, 2""")
def q_latest_verdict(spark, folder):
    store = table(spark, folder, "events").select(
        F.when(F.col("event_type").isin("click", "view"), "news").otherwise("topic").alias("classifier"),
        F.col("user_id").alias("key"),
        F.col("event_id").alias("value"),
        F.lit("llm").alias("by"),
        F.lit("").alias("reason"),
        F.col("ts").cast("timestamp").alias("decided_at"),
    )
    return R.latest_verdicts(store).select("classifier", "key", F.col("value").alias("event_id"))


@query("""
WITH u AS (SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title, d.text FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)),
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM u)
SELECT (rn // 25)::BIGINT AS batch_id, md5(string_agg((rn % 25 + 1) || '. ' || title, chr(10) ORDER BY rn)) AS listed, count(*) AS n FROM n GROUP BY 1""")
def q_worklist(spark, folder):
    """Undecided documents in batches of titles, the prompt's list as a digest."""
    rows = articles(spark, folder).join(table(spark, folder, "labels"), "doc_id", "left_anti").select("doc_id", "title")
    batched = R.theme_batches(rows, "doc_id")
    prompts = R.theme_prompts(batched, "Pick one topic per title.")
    listed = F.substring_index("prompt", "[제목]\n", -1)
    sizes = batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    return prompts.join(sizes, "batch_id").select("batch_id", F.md5(listed).alias("listed"), "n")


@query("""
SELECT doc_id, 'title' AS field, split_part(text, chr(10), 1) AS text FROM documents WHERE lang <> 'en' AND split_part(text, chr(10), 1) <> ''
UNION ALL SELECT doc_id, 'source', source FROM documents WHERE n_chars % 3 <> 0""")
def q_translation_worklist(spark, folder):
    rows = table(spark, folder, "documents").select(
        "doc_id",
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(F.col("lang") == "en", F.substring_index("text", "\n", 1)).alias("title_en"),
        "source",
        F.when(F.col("n_chars") % 3 == 0, "known").otherwise(" ").alias("source_en"),
    ).where("title <> ''")
    empty = table(spark, folder, "documents").where(F.substring_index("text", "\n", 1) == "").select(
        "doc_id", F.lit("").alias("title"), F.lit(None).cast("string").alias("title_en"), "source",
        F.when(F.col("n_chars") % 3 == 0, "known").otherwise(" ").alias("source_en"),
    )
    return R.translation_worklist(rows.unionByName(empty), "doc_id", {"title": "title_en", "source": "source_en"})


THEMES = ("good", "poor")


def batched_documents(spark, folder):
    return R.theme_batches(articles(spark, folder).select("doc_id", "title"), "doc_id")


def theme_replies(spark, folder, batched):
    """One reply text per batch, written from the labels of its documents."""
    theme = F.when(F.col("toxic") == 1, "unheard of").when(F.col("quality") == 1, "good").otherwise("poor")
    named = batched.join(table(spark, folder, "labels"), "doc_id").select("batch_id", F.struct("i", theme.alias("theme")).alias("e"))
    listed = named.groupBy("batch_id").agg(F.to_json(F.array_sort(F.collect_list("e"))).alias("json"))
    return listed.select("batch_id", F.concat(F.lit("Here: "), "json", F.lit(" as asked.")).alias("reply_text"))


_THEME_SQL = """
WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents),
t AS (SELECT n.doc_id, (rn // 25)::BIGINT AS batch_id, (rn % 25 + 1)::BIGINT AS i,
    CASE WHEN l.toxic = 1 OR l.quality IS NULL THEN 'none' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS theme
    FROM n LEFT JOIN labels l USING (doc_id))
"""


@query(_THEME_SQL + "SELECT doc_id, batch_id, i, theme FROM t")
def q_batch_reply(spark, folder):
    batched = batched_documents(spark, folder)
    out = R.assign_themes(batched, theme_replies(spark, folder, batched), THEMES, "none")
    return out.select("doc_id", "batch_id", "i", "theme")


@query(_THEME_SQL + "SELECT theme, count(*) AS n FROM t GROUP BY theme")
def q_theme_distribution(spark, folder):
    return q_batch_reply(spark, folder).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))
