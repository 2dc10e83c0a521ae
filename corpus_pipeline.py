"""The corpus pipeline: quality rules, line and near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it
wrote, and returns a frame; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.llm import lines, mixing, neardup, packing, quality
from gleanmill.llm.common import documents, prepared, written
from gleanmill.llm.queries import public_specials, public_vocabulary
from gleanmill.session import shared_dir


def with_text(docs: DataFrame, doc: str, text: str) -> list:
    """The columns of ``docs`` out of struct ``doc``, with another text and its length."""
    out = {c: F.col(doc).getField(c) for c in docs.columns} | {"text": F.col(text)}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return [column.alias(c) for c, column in out.items()]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules keep, with the lines that pass them."""
    prepared(spark)
    return quality.judged(docs).where("kept").select(*with_text(docs, "doc", "clean_text"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat others."""
    prepared(spark)
    return lines.without_repeats(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 of 5-word shingles).

    Rows go by their place in the stored table, so of rows that repeat an id, or
    have none, also one stays.
    """
    prepared(spark)
    # both sides number the same splits of the same files, so a row has one number
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    narrow = numbered.select(F.col("_row").alias("doc_id"), "text")
    gone = neardup.near_duplicates(narrow, percent=80, bands=64).where("NOT kept").select(F.col("doc_id").alias("_row"))
    return numbered.join(gone, "_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row per document and epoch, its text being the words the mix takes of it."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their ids."""
    prepared(spark)
    return packing.pack(docs, *public_vocabulary(), specials=public_specials())


STAGES = [
    ("quality_rules", clean),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_copies),
    ("source_mix", mix),
    ("packing", pack),
]
#: Packing has no SQL: the pipeline is tested stage by stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, step in STAGES:
        written(step(spark, docs, sf_dir), f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
