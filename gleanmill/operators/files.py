"""File rows of an article."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanmill.functions.text import blank_to_null, text_of
from gleanmill.functions.urls import base_name, object_path, proxy_link
from gleanmill.functions.values import attachment_problem, file_kind, mime_type


def file_rows(items: Column, name_field: bool = False) -> Column:
    """Accepted entries of one list, with a 0-based order that counts only them.

    Works inside the array of one article: no explode, no window, no shuffle.
    """
    present = F.filter(items, lambda f: text_of(f["s3Path"]) != "")
    accepted = F.filter(present, lambda f: file_kind(f["s3Path"]).isNotNull())

    def row(f: Column, i: Column) -> Column:
        path = object_path(f["s3Path"])
        own = blank_to_null(f["originalName"]) if name_field else F.lit(None).cast("string")
        return F.struct(
            path.alias("file_path"),
            f["url"].alias("file_url"),
            file_kind(f["s3Path"]).alias("file_ty"),
            i.cast("int").alias("sort_order"),
            F.coalesce(own, base_name(path)).alias("file_name"),
            mime_type(path).alias("mime_type"),
            proxy_link(path).alias("download_url"),
        )

    return F.coalesce(F.transform(accepted, row), F.array().cast(
        "array<struct<file_path:string,file_url:string,file_ty:string,sort_order:int,"
        "file_name:string,mime_type:string,download_url:string>>"
    ))


def article_files(img: Column, file: Column) -> Column:
    """Pictures then attachments; each list numbers its own entries."""
    return F.concat(file_rows(img), file_rows(file, name_field=True))


def skipped_files(*lists: Column) -> Column:
    """Entries with a path whose extension is not accepted."""
    total = F.lit(0)
    for items in lists:
        bad = F.filter(items, lambda f: (text_of(f["s3Path"]) != "") & file_kind(f["s3Path"]).isNull())
        total = total + F.coalesce(F.size(bad), F.lit(0))
    return total


def has_bad_attachment(files: Column) -> Column:
    """One attachment without extension or with a script's rejects the article."""
    return F.coalesce(F.exists(files, lambda f: attachment_problem(f["originalName"]).isNotNull()), F.lit(False))


def stored_paths(items: Column) -> Column:
    return F.transform(F.filter(items, lambda f: text_of(f["s3Path"]) != ""), lambda f: f["s3Path"])
