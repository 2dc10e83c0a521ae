"""Quality rules, line first (expressions only).

Every line of a text is held against punctuation, navigation and boilerplate
rules; lines that fail are removed, and a document that loses too much of its
text that way is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import WORD, let, word_count, words_of

SYMBOLS = "[^#*$%&|<>]+"
#: An end of a sentence or clause: its mark, closing quotes or brackets, then a blank or the end.
SENTENCE_END = r"[.!?…。！？:;][\x22\x27)\]”»]*([\x20\x09-\x0D]|\z)"
#: Texts of page furniture, not of documents.
BOILERPLATE = (
    r"(?i)(all rights reserved|cookie policy|privacy policy|terms of (use|service)|licensed under|lorem ipsum"
    r"|enable javascript|click here|sign up for|subscribe to our|copyright (\(c\)|©))"
)
#: Three or more separators of menu items.
NAVIGATION = "(?s) [|»›·] .* [|»›·] .* [|»›·] "
#: A longer line that holds one of the phrases is text that mentions it.
FURNITURE_CHARS = 200
WINDOW = 8


def occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def bad_line(line: Column) -> Column:
    """A line with words that fails a rule.

    Punctuation: no sentence end anywhere, over 3 symbols for 10 words, or
    over 3 double exclamation marks for 10 words.  Navigation: three or more
    separators of menu items.  Boilerplate: a phrase of page furniture in a line
    of up to 200 characters.
    """
    symbols = F.length(F.regexp_replace(line, SYMBOLS, ""))
    failed = (
        ~F.rlike(line, F.lit(SENTENCE_END))
        | F.rlike(line, F.lit(NAVIGATION))
        | ((F.length(line) <= FURNITURE_CHARS) & F.rlike(line, F.lit(BOILERPLATE)))
        # words are counted only where there is something to hold against them
        | ((symbols > 0) & (10 * symbols > 3 * word_count(line)))
        | (F.contains(line, F.lit("!!")) & (10 * occurrences(line, "!!") > 3 * word_count(line)))
    )
    return failed & F.rlike(line, F.lit(WORD))


def repeated_window_words(words: Column) -> Column:
    """Words that lie in a window of 8 words found twice or more in the text.

    Windows are told apart by 64-bit hashes.  Only a text that holds one twice
    pays for the sort that finds where.
    """

    def where(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            twice = F.filter(
                F.sequence(F.lit(0), F.size(s) - 1),
                lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]),
            )
            return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

        def covered(p: Column) -> Column:
            # a window adds the words up to the next repeated one, the last all of its own
            steps = F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return let(let(pairs, positions), covered)

    def hashed(codes: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(codes) - WINDOW),
            lambda i: F.xxhash64(*(F.get(codes, i + k) for k in range(WINDOW))),
        )
        return let(
            windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(where(w))
        )

    return F.when(F.size(words) < WINDOW, 0).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), hashed)
    )


def judged(docs: DataFrame, max_lost: float = 0.6) -> DataFrame:
    """Per input row: its columns as struct ``doc``, the cleaned text, the base figures and the verdict.

    ``docs`` has text; all its columns stay in ``doc``, whatever their names.
    Adds clean_text (lines that passed, in order), n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, lost (share of the
    characters that stood in removed lines) and kept.  A null, empty or blank
    text has no words and fails; repeated rows are judged alike; an empty table
    gives none.  Texts are read whole and never leave their row, so there is no
    shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def measured(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_window_words(words).cast("long").alias("n_repeat_words"),
        )

    def lined(lines: Column) -> Column:
        with_words = F.filter(lines, lambda line: F.rlike(line, F.lit(WORD)))
        good = F.filter(lines, lambda line: ~bad_line(line))
        return F.struct(
            let(with_words, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            let(
                good,
                lambda g: F.struct(
                    F.array_join(g, "\n").alias("text"), F.length(F.array_join(g, "")).alias("chars")
                ),
            ).alias("good"),
            F.length(F.array_join(lines, "")).alias("chars"),
        )

    found = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        F.explode(
            F.array(
                F.struct(
                    let(words_of(text), measured).alias("base"),
                    let(F.split(text, "\n"), lined).alias("lines"),
                    F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"),
                )
            )
        ).alias("m"),
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        found.select(
            "doc",
            F.col("m.lines.good.text").alias("clean_text"),
            "m.base.n_words", "m.base.word_chars", "m.n_symbols", "m.lines.n_dup_lines", "m.base.n_repeat_words",
            F.when(
                F.col("m.lines.chars") > 0, 1 - F.col("m.lines.good.chars") / F.col("m.lines.chars")
            ).otherwise(0.0).alias("lost"),
        )
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
    )
