"""Chat formatting: turns to one training text with a loss mask, and back.

Spark expressions only.  The template::

    ### role: text</turn>text of the same role</turn>
    ### other role: ...

A header opens a block of adjacent turns of one role; every turn ends with
``</turn>``.  Inside texts and roles a backslash doubles, a ``#`` after a ``#``
and the slash of ``</turn>`` get a backslash before them (in roles also ``:``),
so that neither control string can occur in them, and dropping one backslash of
each pair restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmill.llm.common import let

OPEN, SEP, END = "### ", ": ", "</turn>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.regexp_replace(doubled, "(?<=#)#", r"\\#"), F.lit(END), F.lit("<\\/turn>"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask.

    ``turns`` has conv_id, turn, role, text; other columns are not read.  Rows
    go by turn (null first), ties by role and text, and repeated rows stay.
    Null texts and roles are empty ones; a null conv_id is a conversation of its
    own; no rows give no rows.  ``mask`` holds, per turn, how many template
    characters come before its text, how many characters the escaped text has,
    and whether they carry loss; the turn's end mark follows them.  A
    conversation is one value of the result, so its turns meet in one row, in
    time and space linear in their length; nothing else gathers.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def header(role: Column) -> Column:
        return F.concat(F.lit(OPEN), F.replace(escape(role), F.lit(":"), F.lit("\\:")), F.lit(SEP))

    def blocks(all_turns: Column) -> Column:
        # a block starts where the role changes and ends where the next one starts
        starts = F.filter(
            F.sequence(F.lit(0), F.size(all_turns) - 1),
            lambda i: (i == 0) | (F.get(all_turns, i)["role"] != F.get(all_turns, i - 1)["role"]),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda start, k: F.struct(
                    header(F.get(all_turns, start)["role"]).alias("header"),
                    (F.get(all_turns, start)["role"] == LEARNED).alias("loss"),
                    F.transform(
                        F.slice(
                            all_turns, start + 1, F.coalesce(F.get(s, k + 1), F.size(all_turns)) - start
                        ),
                        lambda t: escape(t["text"]),
                    ).alias("texts"),
                ),
            ),
        )

    merged = sorted_turns.select("conv_id", blocks(F.col("turns")).alias("blocks"))
    held = merged.select("conv_id", F.explode(F.array("blocks")).alias("blocks"))
    written = F.transform(
        "blocks", lambda b: F.concat(b["header"], F.array_join(b["texts"], END), F.lit(END))
    )
    mask = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.length(b["header"])).otherwise(0).alias("lead"),
                    F.length(t).alias("chars"),
                    b["loss"].alias("loss"),
                ),
            ),
        )
    )
    return held.select("conv_id", F.array_join(written, "").alias("formatted"), mask.alias("mask"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Parse formatted texts: conv_id, formatted, turns (role, text), loss_text.

    Takes what :func:`format_chats` returns; null or empty formatted texts have
    no turns.  ``loss_text`` is what stands under the mask, unescaped.
    """
    blocks = F.filter(F.split(F.coalesce("formatted", F.lit("")), "(?=### )"), lambda b: b != "")
    head = r"(?s)^### ((?:[^:\\]++|\\.)*+): "

    def pieces(block: Column) -> Column:
        # every turn of the block, the first with the header still before it
        return let(
            F.struct(F.regexp_extract(block, head, 1).alias("role"), F.split(block, END).alias("parts")),
            lambda b: F.transform(
                F.slice(b["parts"], 1, F.size(b["parts"]) - 1),
                lambda piece: F.struct(b["role"].alias("role"), piece.alias("piece")),
            ),
        )

    cut = formatted.select(
        "conv_id", "formatted", "mask",
        F.explode(F.array(F.flatten(F.transform(blocks, pieces)))).alias("pieces"),
    )
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(p["role"]).alias("role"),
            unescape(F.regexp_replace(p["piece"], head, "")).alias("text"),
        ),
    )
    masked = F.transform(
        F.arrays_zip("pieces", "mask"),
        lambda x: F.when(
            x["mask"]["loss"],
            unescape(F.substring(x["pieces"]["piece"], x["mask"]["lead"] + 1, x["mask"]["chars"])),
        ).otherwise(""),
    )
    return cut.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
