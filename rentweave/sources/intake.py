"""Validated intake: what is refused says why, nothing is dropped silently."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null

# Fixed value: largest accepted page, in characters.
MAX_HTML = 5 * 1024 * 1024


def check_pages(pages: DataFrame, max_html: int = MAX_HTML) -> DataFrame:
    """Add ``reject_reason`` (null = accepted) to submitted pages.

    Sizes count UTF-16 units, so characters outside the basic plane count twice.
    """
    astral = F.length("html") - F.length(F.regexp_replace("html", r"[\x{10000}-\x{10FFFF}]", ""))
    return pages.withColumn(
        "reject_reason",
        F.when(blank_to_null(F.col("url")).isNull(), "missing url")
        .when(blank_to_null(F.col("html")).isNull(), "missing html")
        .when(F.length("html") + astral > max_html, "html too large"),
    )


def check_searches(searches: DataFrame) -> DataFrame:
    """Add ``reject_reason`` to submitted saved searches: name and prompt are required."""
    return searches.withColumn(
        "reject_reason",
        F.when(blank_to_null(F.col("name")).isNull(), "missing name").when(
            blank_to_null(F.col("prompt")).isNull(), "missing prompt"
        ),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reject_reason").isNotNull())


def create_searches(existing: DataFrame, submitted: DataFrame) -> DataFrame:
    """Existing saved searches plus the accepted submissions, active from the start."""
    fresh = accepted(check_searches(submitted)).withColumn("is_active", F.lit(True))
    return existing.unionByName(fresh.select(*existing.columns))


def list_searches(searches: DataFrame) -> DataFrame:
    return searches.orderBy(F.col("created_at").desc(), "search_id")
