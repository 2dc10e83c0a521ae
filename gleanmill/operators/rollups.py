"""Summaries, reports and change scripts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from gleanmill.functions.text import pad_left, pad_right, sql_literal, text_of
from gleanmill.operators.numbering import with_position
from gleanmill.rules import vocabulary as V
from gleanmill.rules.cascades import known_menu

# Report labels.
NO_PUBLISHER = "(발행기관 없음)"
BY_LABELS = {
    "dict": "사전",
    "pattern": "패턴",
    "llm": "LLM판정",
    "llm-lowconf": "LLM저신뢰→PRIVATE",
    "cache": "LLM캐시",
    "default": "기본값(PRIVATE)",
}


def counters(rows: DataFrame, tests: Mapping[str, Column]) -> DataFrame:
    """One row of conditional counts: one pass, whatever the number of counters."""
    return rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def written_counts(rows: DataFrame, tests: Mapping[str, Column], write: Callable[[DataFrame], None]) -> DataFrame:
    """The one row of ``counters``, taken while ``write`` writes the rows: no second pass over them.

    Counts are those of the write as it ended; a task that is tried again counts once.
    """
    seen = Observation()
    write(rows.observe(seen, *[F.count_if(test).alias(name) for name, test in tests.items()]))
    # an input without rows may be written without a task, which counts nothing
    counts = [int(seen.get.get(name) or 0) for name in tests]
    return rows.sparkSession.createDataFrame([tuple(counts)], ", ".join(f"{name} long" for name in tests))


def status_counters(rows: DataFrame, statuses: Sequence[str], status: str = "status") -> DataFrame:
    return rows.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == s).alias(s) for s in statuses]
    )


def menu_counts(metas: DataFrame, menu: str = "menu_id") -> DataFrame:
    return metas.groupBy(known_menu(menu).alias("menu_id")).agg(F.count(F.lit(1)).alias("n"))


def publisher_rollup(metas: DataFrame, seq: str = "seq") -> DataFrame:
    """Count per publisher with verdict, reason and menu of its first record."""
    name = F.when(text_of("publisher") == "", NO_PUBLISHER).otherwise(F.col("publisher"))
    first = F.min_by(
        F.struct(
            F.coalesce("classification.verdict", F.lit("-")).alias("verdict"),
            F.coalesce("classification.by", F.lit("-")).alias("by"),
            F.col("menu_id"),
        ),
        seq,
    )
    return (
        metas.groupBy(name.alias("publisher"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first_seq"), first.alias("_f"))
        .select("publisher", "n", "first_seq", "_f.*")
    )


def move_matrix(rows: DataFrame, old: str, new: str) -> DataFrame:
    """Counts of old to new where they differ."""
    return rows.where(~F.col(old).eqNullSafe(F.col(new))).groupBy(old, new).agg(F.count(F.lit(1)).alias("n"))


def running_totals(rows: DataFrame, day: str, tests: Mapping[str, Column]) -> DataFrame:
    """Daily counts and their running totals.

    The window sees one row per day, so its single task is bounded by the
    calendar and not by the data.
    """
    daily = rows.groupBy(day).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    so_far = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("*", *[F.sum(n).over(so_far).alias("total_" + n) for n in tests])


def run_rollup(logs: DataFrame) -> DataFrame:
    """Runs, successes, items and mean duration per recipe and day."""
    seconds = F.col("endedAt").cast("double") - F.col("startedAt").cast("double")
    return logs.groupBy("configId", F.to_date("startedAt").alias("day")).agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if("success").alias("succeeded"),
        F.coalesce(F.sum("itemCount"), F.lit(0)).alias("items"),
        F.avg(seconds).alias("mean_seconds"),
    )


def schedule_rollup(recipes: DataFrame) -> DataFrame:
    """Enabled recipes per schedule time."""
    times = recipes.where("enabled").select("id", F.explode(F.array_distinct("scheduleTime")).alias("time"))
    return times.groupBy("time").agg(F.count(F.lit(1)).alias("n"))


def pass_and_exception(rows: DataFrame, passed: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts in one row, and the two member lists as frames of their own."""
    marked = rows.withColumn("passed", passed)
    counts = counters(
        marked,
        {"all_count": F.lit(True), "pass_count": F.col("passed"), "exception_count": ~F.col("passed")},
    )
    return counts, marked.where("passed").drop("passed"), marked.where(~F.col("passed")).drop("passed")


# ---- text report ------------------------------------------------------------

def report_order(metas: DataFrame) -> DataFrame:
    """Publisher (Korean order), year descending, title (Korean order)."""
    return metas.orderBy(*report_keys())


def report_keys() -> list[Column]:
    return [
        F.collate(text_of("publisher"), "ko"),
        text_of("publish_year").desc(),
        F.collate(text_of("title"), "ko"),
    ]


def by_label(by: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BY_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, by), by, F.lit("-"))


def report_lines(metas: DataFrame, source: str, origin_id: int, created: str, seq: str = "seq") -> DataFrame:
    """The status report as (section, rank, line), to be sorted on those keys.

    Heads are single-row aggregates, publisher and item lines stay distributed:
    writing the frame sorted gives part files whose concatenation is the report.
    """
    bar, rule = "=" * 100, "-" * 100
    totals = metas.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(known_menu("menu_id") == m).alias(m) for m in V.MENUS]
    )
    publishers = publisher_rollup(metas, seq)

    def fixed(section: int, *lines: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(section).alias("section"), F.lit(n).cast("long").alias("rank"), line.alias("line"))
            for n, line in enumerate(lines)
        ])

    head = totals.select(F.inline(fixed(
        0,
        F.lit(bar),
        F.lit(f" {source.upper()} (origin {origin_id}) 아카이브 저장 현황 리포트"),
        F.lit(f" 생성: {created} (KST)"),
        F.format_string(
            " 총 %d건 — 발간자료(PUBLICATIONS) %d / 논문(PAPERS) %d / 단행본(BOOKS) %d", "total", *V.MENUS
        ),
        F.lit(" 분류기준: 단행본→BOOKS 고정, 발행기관 GOV(정부·지자체·국책연)→PUBLICATIONS, PRIVATE(학회·대학·민간)→PAPERS"),
        F.lit(" 분류근거 표기: " + ", ".join(f"{k}={v}" for k, v in BY_LABELS.items())),
        F.lit(bar),
    )))
    publisher_head = publishers.agg(F.count(F.lit(1)).alias("n")).select(F.inline(fixed(
        1, F.lit(""), F.format_string("■ 발행기관별 분류 요약 — %d개 기관 (건수 내림차순)", "n"), F.lit(rule)
    )))
    ranked = with_position(publishers.withColumn("_down", -F.col("n")), ["_down", "first_seq"], name="rank")
    publisher_lines = ranked.select(
        F.lit(2).alias("section"),
        "rank",
        F.concat(
            pad_left("n", 5), F.lit("건 | "), pad_right("menu_id", 12), F.lit(" | "), pad_right("verdict", 7),
            F.lit("/"), pad_right(by_label(F.col("by")), 10), F.lit(" | "), F.col("publisher"),
        ).alias("line"),
    )
    parts = [head, publisher_head, publisher_lines]

    keyed = metas.select(
        known_menu("menu_id").alias("_menu"),
        *[k.alias(f"_k{n}") for n, k in enumerate((
            F.collate(text_of("publisher"), "ko"), text_of("publish_year"), F.collate(text_of("title"), "ko"),
        ))],
        F.concat(
            F.lit("["), text_of("register_no"), F.lit("] "),
            F.when(text_of("publish_year") == "", "----").otherwise(F.col("publish_year")), F.lit(" | "),
            F.when(text_of("publisher") == "", NO_PUBLISHER).otherwise(F.col("publisher")), F.lit(" → "),
            F.coalesce("classification.verdict", F.lit("-")), F.lit("("), by_label(F.col("classification.by")),
            F.lit(') | "'), text_of("title"), F.lit('"'),
            F.when(F.size("matched_keywords") > 0, F.concat(F.lit(" | 키워드: "), F.array_join("matched_keywords", ", "))).otherwise(""),
        ).alias("line"),
    )
    for n, menu in enumerate(V.MENUS):
        section = 3 + 2 * n
        own = keyed.where(F.col("_menu") == menu)
        title = F.format_string(f"■ {menu} ({V.MENU_LABELS[menu]}) — %d건", menu)
        empty = F.when(F.col(menu) == 0, F.lit("(없음)"))
        parts.append(
            totals.select(F.inline(fixed(section, F.lit(""), title, F.lit(rule), empty))).where("line is not null")
        )
        parts.append(own.select(F.lit(section + 1).alias("section"), F.lit(0).cast("long").alias("rank"), "line", "_k0", "_k1", "_k2"))
    parts.append(totals.select(F.inline(fixed(
        9, F.lit(""), F.lit(bar), F.format_string(" 끝 — 총 %d건", "total"), F.lit(bar)
    ))))
    lines = parts[0]
    for part in parts[1:]:
        lines = lines.unionByName(part, allowMissingColumns=True)
    return lines.orderBy("section", "rank", "_k0", F.desc("_k1"), "_k2").select("section", "rank", "line")


# ---- change scripts ---------------------------------------------------------

def in_list_script(rows: DataFrame, key: str, target: str, table: str, remark: str, size: int = 900) -> DataFrame:
    """UPDATE statements with IN-lists of at most ``size`` keys per target value.

    Chunks are numbered by range partitions and each list is at most ``size``
    long, so a target that takes most rows is still written by many tasks.
    """
    numbered = with_position(rows.select(target, key), [key], [target], "_pos")
    keys = F.array_sort(F.collect_list(sql_literal(key)))
    return (
        numbered.withColumn("chunk", F.floor(F.col("_pos") / size).cast("long"))
        .groupBy(target, "chunk")
        .agg(F.count(F.lit(1)).alias("n"), F.array_join(keys, ", ").alias("_keys"))
        .select(
            target,
            "chunk",
            "n",
            F.concat(
                F.lit(f"UPDATE {table} SET menu_id = "), sql_literal(target),
                F.lit(f", mdfcn_dt = SYSDATETIME\nWHERE remark = '{remark}' AND register_no IN ("), F.col("_keys"), F.lit(");"),
            ).alias("statement"),
        )
    )


def category_case_script(table: str, remark: str) -> str:
    """One statement that sets both category columns by register prefix."""
    def case(column: str, index: int) -> str:
        arms = " ".join(
            f"WHEN register_no LIKE 'RISS:{prefix}%' THEN '{kind[index]}'" for prefix, kind in V.REGISTER_KINDS.items()
        )
        return f"{column} = CASE {arms} ELSE {column} END"

    return f"UPDATE {table} SET {case('category', 0)}, {case('category_en', 1)}, mdfcn_dt = SYSDATETIME WHERE remark = '{remark}';"


def row_script(rows: DataFrame, table: str, with_menu: bool = True) -> DataFrame:
    """One UPDATE per register number."""
    menu = F.concat(F.lit("menu_id="), sql_literal("menu_id"), F.lit(", ")) if with_menu else F.lit("")
    return rows.select(
        "register_no",
        F.concat(
            F.lit(f"UPDATE {table} SET "), menu, F.lit("category="), sql_literal("category"),
            F.lit(", category_en=NULL, mdfcn_dt=SYSDATETIME WHERE register_no="), sql_literal("register_no"), F.lit(";"),
        ).alias("statement"),
    )
