"""Posting urls: seeds, link dumps, links found on search result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null
from ..functions.urls import SUBLET_LINK, SUBLET_SITE, building_id, classify_url


def seed_listings(seeds: DataFrame) -> DataFrame:
    """Seed urls with the id their path carries."""
    return seeds.select("url", "seq", building_id(F.col("url")).alias("source_listing_id"))


def flatten_link_dump(dumps: DataFrame) -> DataFrame:
    """One row per link of JSON dumps {"links": [...]}, with its place in the dump."""
    parsed = dumps.withColumn("links", F.from_json("dump", "links array<string>")["links"])
    return parsed.select("dump_id", F.posexplode("links").alias("pos", "url"))


def listing_links(links: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Links that are detail pages of a known source, once each, first place kept."""
    known = links.withColumn("source", classify_url(F.col("url"), patterns)).filter(F.col("source").isNotNull())
    return first_urls(known, ["source", "url"], ["dump_id", "pos"])


def first_urls(links: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key once, with the ``order`` values of its first occurrence."""
    first = links.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first"))
    return first.select(*keys, "first.*")


def discover_links(pages: DataFrame, pattern: str = SUBLET_LINK, site: str = SUBLET_SITE) -> DataFrame:
    """Detail links on search result pages (seq, http_status, html), once each.

    Group 1 of ``pattern`` is the path, group 2 (if any) the source's own id. Pages
    that did not load are skipped. Runs without a shuffle up to the final grouping.
    """
    found = (
        pages.filter(F.col("http_status") == 200)
        .select("seq", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("pos", "hit"))
        .select(
            F.concat(F.lit(site), F.regexp_extract("hit", pattern, 1)).alias("url"),
            blank_to_null(F.regexp_extract("hit", pattern, 2)).alias("source_listing_id")
            if _groups(pattern) > 1
            else F.lit(None).cast("string").alias("source_listing_id"),
            "seq",
            "pos",
        )
    )
    return first_urls(found, ["url", "source_listing_id"], ["seq", "pos"])


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def union_urls(seeds: DataFrame, fresh: DataFrame) -> DataFrame:
    """Seeds first, then fresh urls, each url once."""
    both = seeds.select("url", F.lit(0).alias("batch"), "seq").unionByName(
        fresh.select("url", F.lit(1).alias("batch"), "seq")
    )
    return first_urls(both, ["url"], ["batch", "seq"])
