"""Source plug-ins: a name, where its postings are, and how raw content is parsed."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import DETAIL_PATTERNS
from .building_page import parse_building_pages
from .files import discover_records, discover_seeds
from .json_postings import parse_classified, parse_structured
from .links import first_urls
from .sublet_page import parse_sublet_pages

#: Takes a session, a folder and whether to follow it as a stream.
Reader = Callable[[SparkSession, str, bool], DataFrame]
Parser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SourceAdapter:
    """``discover`` yields (url, seq, source_listing_id) of what lies in a folder, as a table or as a
    stream; ``parse`` takes raw rows (source_url, raw_content, ...) to posting fields plus ``error``."""

    name: str
    parse: Parser
    discover: Reader | None = None


def _page_parser(parse: Parser) -> Parser:
    def run(raw: DataFrame) -> DataFrame:
        pages = raw.withColumnRenamed("raw_content", "html")
        missing = F.when(F.col("html").isNull(), F.lit("missing content"))
        return parse(pages.withColumn("error", missing))

    return run


BUILT_IN = (
    SourceAdapter("structured_json", parse_structured, discover_records),
    SourceAdapter("classified_json", parse_classified, discover_records),
    SourceAdapter("sublet_pages", _page_parser(parse_sublet_pages), discover_seeds(DETAIL_PATTERNS["sublet_pages"])),
    SourceAdapter("building_pages", _page_parser(parse_building_pages), discover_seeds(DETAIL_PATTERNS["building_pages"])),
)


def discovered_by_source(
    spark: SparkSession, folders: dict[str, str], adapters: Iterable[SourceAdapter] = BUILT_IN, stream: bool = False
) -> DataFrame:
    """``source, url, seq, source_listing_id`` of all sources that have a folder, each url of a source once.

    As a stream, urls come as their files do and may come again; ``unseen_urls`` of a batch drops those that are known.
    """
    found = [
        a.discover(spark, folders[a.name], stream).select(F.lit(a.name).alias("source"), "url", "seq", "source_listing_id")
        for a in adapters
        if a.discover and a.name in folders
    ]
    rows = reduce(DataFrame.unionByName, found)
    if stream:
        return rows
    return first_urls(rows, ["source", "url"], ["seq", "source_listing_id"])


class SourceRegistry:
    """Adapters by name."""

    def __init__(self, adapters: Iterable[SourceAdapter] = BUILT_IN) -> None:
        self._adapters = {a.name: a for a in adapters}

    def register(self, adapter: SourceAdapter) -> None:
        if adapter.name in self._adapters:
            raise ValueError(f"source {adapter.name!r} is already registered")
        self._adapters[adapter.name] = adapter

    def names(self) -> list[str]:
        return list(self._adapters)

    def route(self, names: str | None = None) -> list[SourceAdapter]:
        """Adapters of a comma-separated list, all of them when none is given."""
        if not names:
            return list(self._adapters.values())
        wanted = [n.strip() for n in names.split(",")]
        unknown = [n for n in wanted if n not in self._adapters]
        if unknown:
            raise ValueError(f"unknown source {', '.join(unknown)}; available: {', '.join(self._adapters)}")
        return [self._adapters[n] for n in wanted]
