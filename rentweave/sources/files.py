"""Folders of saved postings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from ..functions.urls import url_id


def _stem(suffix: str) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), rf"^(.*)\.{suffix}$", 1)


def read_json_folder(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One raw record per ``.json`` file; the file stem is the source's own id."""
    return (
        spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
        .select(
            F.lit(source).alias("source"),
            F.col("_metadata.file_path").alias("source_url"),
            F.regexp_extract(F.col("_metadata.file_name"), r"^(.+)\.json$", 1).alias("source_listing_id"),
            F.lit(200).alias("http_status"),
            F.col("value").alias("raw_content"),
        )
    )


def _reader(spark: SparkSession, stream: bool):
    return spark.readStream if stream else spark.read


def discover_records(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
    """``url, seq, source_listing_id`` of the ``.json`` records in a folder, oldest file first; no content is read."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = _reader(spark, stream).schema(schema).format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    return files.select(
        F.col("path").alias("url"), F.unix_micros("modificationTime").alias("seq"),
        F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("source_listing_id"),
    )


def discover_seeds(pattern: str) -> Callable[[SparkSession, str, bool], DataFrame]:
    """Reader of the urls that match ``pattern``, as seeds (a url per line of ``.txt`` files) and link dumps (JSON
    objects with ``links``, one per line of ``.json`` files) list them; a url may come more than once."""

    def discover(spark: SparkSession, folder: str, stream: bool = False) -> DataFrame:
        lines = _reader(spark, stream).schema("value string").option("pathGlobFilter", "*.{txt,json}").text(folder).select(
            "value", F.unix_micros(F.col("_metadata.file_modification_time")).alias("seq"),
            F.col("_metadata.file_name").endswith(".json").alias("dump"),
        )
        listed = F.when(F.col("dump"), F.from_json("value", "links array<string>")["links"]).otherwise(F.array("value"))
        urls = lines.select("seq", F.explode(listed).alias("url")).select("seq", trim_ws(F.col("url")).alias("url"))
        return urls.where(F.rlike("url", F.lit(pattern))).select("url", "seq", url_id(F.col("url")).alias("source_listing_id"))

    return discover


def attach_sidecar_urls(pages: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Url of each saved page: its sidecar's text, else its own path.

    ``pages`` (stem, path, ...) and ``sidecars`` (stem, text) meet on the path stem.
    """
    named = sidecars.select("stem", trim_ws(F.col("text")).alias("sidecar_url"))
    return (
        pages.join(named, "stem", "left")
        .withColumn("url", F.coalesce("sidecar_url", F.concat(F.lit("file://"), F.col("path"))))
        .drop("sidecar_url")
    )


def _saved_pages(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """``stem, path, html`` of saved pages, ``stem, text`` of their sidecars."""
    pages = (
        spark.read.option("pathGlobFilter", "*.html").text(folder, wholetext=True)
        .select(
            _stem("html").alias("stem"),
            F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "").alias("path"),
            F.col("value").alias("html"),
        )
    )
    sidecars = (
        spark.read.option("pathGlobFilter", "*.url").text(folder, wholetext=True)
        .select(_stem("url").alias("stem"), F.col("value").alias("text"))
    )
    return pages, sidecars


def read_html_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Saved ``.html`` pages (url, html), urls from ``.url`` sidecar files where present."""
    return attach_sidecar_urls(*_saved_pages(spark, folder)).select("url", "html")


def parse_html_folder(spark: SparkSession, folder: str, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``url`` and posting fields of saved pages; ``parse`` takes (stem, path, html).

    Pages are parsed where they are read; only their fields meet the sidecars.
    """
    pages, sidecars = _saved_pages(spark, folder)
    return attach_sidecar_urls(parse(pages), sidecars).drop("stem", "path")
