"""URL rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import extract

# What a detail page of each source looks like.
DETAIL_PATTERNS = {
    "sublet_pages": r"/short-term-rental-details/\d+/",
    "building_pages": r"(?i)/building/[a-z0-9_-]+/[a-z0-9_-]+\z",
}
# Link to a sublet detail page inside a search result page, and its site.
SUBLET_LINK = r'href="(/short-term-rental-details/(\d+)/[^"]+)"'
SUBLET_SITE = "https://www.leasebreak.com"
# Fixed value: path below which imported building pages carry their id.
IMPORT_ID = r"streeteasy\.com/(?:building|rental)/([^\n\r]+?)(?:\?|\z)"


def url_id(url: Column) -> Column:
    """Numeric path part, else everything after /building/, else null."""
    return F.coalesce(extract(url, r"/(\d+)/"), extract(url, r"/building/(.+)\z"))


def building_id(url: Column) -> Column:
    """Everything after /building/, else the whole url."""
    return F.coalesce(extract(url, r"/building/(.+)\z"), url)


def import_id(url: Column) -> Column:
    """Id of an imported page, without its query string; null for other sites."""
    return extract(url, IMPORT_ID)


def classify_url(url: Column, patterns: dict[str, str] | None = None) -> Column:
    """Name of the first source whose detail pattern the url matches, else null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(list((patterns or DETAIL_PATTERNS).items())):
        out = F.when(F.regexp_like(url, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def url_host(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))), F.lit("unknown"))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)
