"""Ingest of fetched pages and records into raw pages and postings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import PARSED_FIELDS
from ..session import stage
from ..sources.adapters import SourceAdapter
from ..sources.json_postings import extracted_json
from .ranking import top_rows

PARSE_VERSION = "1.0.0"


@dataclass
class IngestBatch:
    """Raw rows to upsert, parsed postings, refused rows and counts of one batch."""

    raw: DataFrame
    listings: DataFrame
    errors: DataFrame
    stats: DataFrame


def cap_per_source(discovered: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` discovered urls of each source; 0 means all."""
    if not limit:
        return discovered
    return top_rows(discovered, ["source"], [F.col("seq"), F.col("url")], limit, "_at").drop("_at")


def parse_batch(fetched: DataFrame, adapter: SourceAdapter) -> DataFrame:
    """Posting fields of every fetched row plus ``error``; a bad row never fails the task."""
    named = fetched.withColumn("source", F.lit(adapter.name))
    keep = [
        c for c in ("source", "source_url", "source_listing_id", "http_status", "seen_at", "seq", "content") if c in named.columns
    ]
    return adapter.parse(named).select(*keep, *PARSED_FIELDS, "error")


def ingest_stats(parsed: DataFrame) -> DataFrame:
    """Rows taken and refused per source."""
    return parsed.groupBy("source").agg(
        F.count_if(F.col("error").isNull()).alias("success"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def ingest_batch(fetched: DataFrame, adapter: SourceAdapter, limit: int = 0) -> IngestBatch:
    """Parse one source's fetched rows (source_url, raw_content, seen_at, seq, ...).

    Parsing is narrow and runs once: its result, with the content beside it, is
    written as one table, from which raw rows, postings, errors and counts each read
    their columns. No join brings content and fields together again.
    """
    capped = fetched
    if limit:
        named = fetched.withColumns({"source": F.lit(adapter.name), "url": F.col("source_url")})
        capped = cap_per_source(named, limit).drop("url")
    parsed = stage(parse_batch(capped.withColumn("content", F.col("raw_content")), adapter), "parsed")
    good = F.col("error").isNull()
    return IngestBatch(
        raw=parsed.select(
            "source", "source_url", "source_listing_id",
            F.col("seen_at").alias("fetched_at"), "http_status",
            F.col("content").alias("raw_content"),
            F.when(good, extracted_json(list(PARSED_FIELDS))).alias("extracted_json"),
            F.lit(PARSE_VERSION).alias("parse_version"),
            *[c for c in ("seq",) if c in parsed.columns],
        ),
        listings=parsed.filter(good).drop("error", "content"),
        errors=parsed.filter(~good).select("source", "source_url", "error"),
        stats=ingest_stats(parsed),
    )
