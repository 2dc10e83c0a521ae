"""Stored metas, recipes, verdicts, run logs, keys and page captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanmill.functions.dates import parse_since
from gleanmill.functions.urls import host_of
from gleanmill.operators.dedupe import keep_last
from gleanmill.operators.once import evaluated_once
from gleanmill.operators.verdicts import stored_verdicts
from gleanmill.schemas import ARCHIVE_META, ARTICLE_META, RECIPE, RUN_LOG


def _json_files(spark: SparkSession, path: str, schema: str, name: str = "*.json") -> DataFrame:
    """One JSON object per file: parsed columns, the file's path and its time."""
    files = (
        spark.read.option("pathGlobFilter", name)
        .option("recursiveFileLookup", True)
        .text(path, wholetext=True)
        .select("value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified_at"))
    )
    return parse_metas(files, "value", schema)


def readable(scanned: DataFrame) -> DataFrame:
    """Rows that parsed; unreadable ones are silently left out."""
    return scanned.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def parse_metas(bodies: DataFrame, body: str, schema: str) -> DataFrame:
    """Meta texts already in a table: parsed columns plus ``_corrupt_record``."""
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rest = [c for c in bodies.columns if c != body]
    return evaluated_once(bodies, "_m", parsed).select(*rest, "_m.*")


def _since(scanned: DataFrame, since: str | None) -> DataFrame:
    """The bound is inclusive; on the file's own time it prunes files before they are opened."""
    bound = parse_since(since)
    return scanned if bound is None else scanned.where(F.col("modified_at") >= F.lit(bound))


def article_metas(spark: SparkSession, root: str, origin_id: int | None = None, since: str | None = None) -> DataFrame:
    """news-crawler/articles/{origin}/**/meta.json with origin and last-modified time."""
    base = f"{root}/news-crawler/articles/" + ("*" if origin_id is None else str(origin_id))
    scanned = _since(_json_files(spark, base, ARTICLE_META, "meta.json"), since)
    return readable(scanned.select(
        "*",
        F.regexp_extract("file_path", r"/articles/(\d+)/", 1).try_cast("long").alias("origin_id"),
        F.regexp_extract("file_path", r"/articles/\d+/([^/]+)/", 1).alias("item_hash"),
    ))


def archive_metas(spark: SparkSession, root: str, origin_id: int | None = None, since: str | None = None) -> DataFrame:
    """archive-crawler/items/{origin}/{hash}[_title]/meta.json."""
    base = f"{root}/archive-crawler/items/" + ("*" if origin_id is None else str(origin_id))
    scanned = _since(_json_files(spark, base, ARCHIVE_META, "meta.json"), since)
    return readable(scanned.select(
        "*",
        F.regexp_extract("file_path", r"/items/(\d+)/", 1).try_cast("long").alias("origin_id"),
        F.regexp_extract("file_path", r"/items/\d+/([0-9a-f]{8})", 1).alias("item_hash"),
    ))


def recipes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(recipes, bad files); a later file of the same id wins."""
    scanned = _json_files(spark, path, RECIPE).select("*", F.regexp_extract("file_path", "[^/]+$", 0).alias("file_name"))
    bad = scanned.where(F.col("_corrupt_record").isNotNull()).select("file_name", "_corrupt_record")
    return keep_last(readable(scanned), "id", "file_name"), bad


def verdict_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One JSON object per classifier to verdict rows."""
    bodies = None
    for classifier, path in paths.items():
        one = spark.read.text(path, wholetext=True).select(
            F.lit(classifier).alias("classifier"), F.col("value").alias("body")
        )
        bodies = one if bodies is None else bodies.unionByName(one)
    return stored_verdicts(bodies)


def register_numbers(lines: DataFrame, seq: str, text: str = "value", pattern: str = "RISS:[ATU][A-Za-z0-9]+") -> DataFrame:
    """Distinct register numbers of raw text, with the place of their first mention."""
    found = lines.select(seq, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "register_no"))
    return found.groupBy("register_no").agg(F.min(F.struct(seq, "pos")).alias("seq"))


CAPTURES = "page_id long, url string, html string"


def page_captures(spark: SparkSession, path: str, follow: bool = False) -> DataFrame:
    """Captures of a folder: those that are there, or a stream of those that come."""
    captured = spark.readStream.schema(CAPTURES).parquet(path) if follow else spark.read.parquet(path)
    return captured.select("page_id", "url", "html", host_of("url").alias("host"))


LIST_CAPTURES = "crawl string, page long, page_url string, body string, list_path string, total_path string"


def list_captures(spark: SparkSession, path: str, follow: bool = False, files: int = 1000) -> DataFrame:
    """JSON list pages of a folder: those that are there, or a stream of those that come, ``files`` of them a batch."""
    if follow:
        return spark.readStream.schema(LIST_CAPTURES).option("maxFilesPerTrigger", files).json(path)
    return spark.read.schema(LIST_CAPTURES).json(path)


def ajax_rows(captures: DataFrame) -> DataFrame:
    """Rows of JSON list pages: the recipe names the list and the page total by dotted path.

    captures: crawl, page, page_url, body, list_path, total_path.
    """
    path = lambda c: F.concat(F.lit("$."), F.col(c))
    listed = F.from_json(_at(F.col("body"), path("list_path")), "array<map<string,string>>")
    total = F.coalesce(_at(F.col("body"), path("total_path")).try_cast("long"), F.lit(0))
    base = captures.select("crawl", "page", "page_url", total.alias("total_pages"), listed.alias("_rows"))
    return base.select("crawl", "page", "page_url", "total_pages", F.posexplode("_rows").alias("pos", "fields"))


def _at(body: Column, path: Column) -> Column:
    """get_json_object with a path that is data; a missing path is null."""
    return F.call_function("get_json_object", body, path)


def list_fields(fields: Column, mapping: Column) -> Column:
    """Target name to the row's JSON field; a missing field is ''."""
    return F.transform_values(mapping, lambda _, field: F.coalesce(F.try_element_at(fields, field), F.lit("")))


def dimension(spark: SparkSession, path: str | None = None, **jdbc: str) -> DataFrame:
    """A reference table from parquet, or over JDBC where the cluster has the driver."""
    if path is not None:
        return spark.read.parquet(path)
    return spark.read.format("jdbc").options(**jdbc).load()


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """log/{configId}/{date}/*.json, or the folders that ``sinks.tables.write_run_logs`` names.

    A file holds one object, or one per line.  A run's configId is its own, or
    that of its folder.
    """
    # an object begins where a line begins with a brace, so files of many runs are read in splits
    reader = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).option("lineSep", "\n{")
    whole = F.when(F.startswith(F.ltrim("value"), F.lit("{")), F.col("value")).otherwise(F.concat(F.lit("{"), "value"))
    files = reader.text(f"{root}/log").where(F.btrim("value") != "").select(
        whole.alias("value"), F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified_at")
    )
    logs = parse_metas(files, "value", RUN_LOG)
    place = lambda n: F.regexp_extract("file_path", r"/log/(?:configId=)?(\d+)/(?:date=)?([^/]+)/", n)
    return logs.withColumns({"configId": F.coalesce("configId", place(1).try_cast("long")), "date": place(2)})


def key_listing(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """Object keys below a prefix, from the listing alone: no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{root}/{prefix}")
    key = F.expr("substring(path, instr(path, '{0}') + length('{0}') + 1)".format(root.rstrip("/")))
    return listed.select(key.alias("key"), "modificationTime", "length")


def failure_stamps(keys: DataFrame, prefix: str) -> DataFrame:
    """Twelve-digit names right below the prefix, sorted."""
    name = F.expr(f"substring(key, {len(prefix) + 1})")
    return keys.where(F.startswith("key", F.lit(prefix))).select(name.alias("stamp")).where(
        F.col("stamp").rlike(r"^\d{12}\z")
    ).orderBy("stamp")
