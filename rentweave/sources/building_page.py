"""Postings from building-unit pages, with optional separately captured page metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import geo_pair
from ..functions.text import (
    BOROUGHS, WORD, WS, blank_to_null, extract, has, parse_money, parse_number, trim_ws,
)
from .html import attr, class_part, element_text, first, last, own_text, select, shred_pages, tagged

# Class name parts, phrases and limits the page marks its fields with.
ADDRESS_PART, SUMMARY_PART, EXPLORE_PART, PRICE_PART = (
    "AboutBuildingSection_address", "BuildingSummaryList_listItem", "ExploreNeigborhoods_heading", "PriceInfo_price",
)
NOT_DESCRIPTION = ("Similar Homes", "net effective", "Listing by")
IMAGE_HOSTS, NOT_IMAGES = ("zillowstatic", "streeteasy"), ("logo", "icon", "avatar")
RENT_ABOVE, RENT_BELOW = 500, 100000
STUDIO_WITHIN = 3000


def plausible_rent(amount: Column) -> Column:
    return (amount > RENT_ABOVE) & (amount < RENT_BELOW)


def is_photo(src: Column) -> Column:
    """Photo of the posting: on an image host, and no logo, icon or avatar."""
    keep = F.lit(False)
    for host in IMAGE_HOSTS:
        keep = keep | has(src, host)
    for word in NOT_IMAGES:
        keep = keep & ~has(src, word)
    return keep


def _place(title: Column) -> tuple[Column, Column]:
    pattern = rf"(?i)in{WS}+([^,|]+),{WS}*({'|'.join(BOROUGHS)})"
    return blank_to_null(trim_ws(extract(title, pattern, 1))), extract(title, pattern, 2)


META = "struct<title:string,og_title:string,og_images:array<string>,geo_position:string,icbm:string>"


def captured_meta(page_meta: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """``on, meta`` of captured page metadata, once per key.

    Of several captures of a key the last by ``captured_at`` counts, where there is such a column (else, and of equal
    times, the greatest), so no page is ever repeated. ``og_images`` may be an array or one text, which counts as an
    array of one (none, if it is empty).
    """
    images = F.col("og_images")
    if dict(page_meta.dtypes)["og_images"] == "string":
        images = F.when(F.col("og_images") != "", F.array("og_images"))
    fields = F.struct("title", "og_title", images.alias("og_images"), "geo_position", "icbm")
    at = F.col("captured_at") if "captured_at" in page_meta.columns else F.lit(None).cast("timestamp_ntz")
    rows = page_meta.select(*on, F.struct(at.alias("at"), fields.cast(META).alias("meta")).alias("capture"))
    return rows.groupBy(*on).agg(F.max("capture")["meta"].alias("meta"))


def with_page_meta(pages: DataFrame, page_meta: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """Pages with the metadata captured for the same key, null where there is none.

    The pages' markup crosses this join; ``parse_with_page_meta`` joins what was parsed instead. Where urls are
    visited more than once, ``on`` also names the visit's column, so that each visit gets what was captured with it.
    """
    return pages.join(captured_meta(page_meta, on), list(on), "left")


def parse_with_page_meta(pages: DataFrame, page_meta: DataFrame, on: Sequence[str] = ("url",)) -> DataFrame:
    """Parsed posting fields of pages, overlaid with the metadata captured for their keys; only parsed fields are shuffled."""
    carried = [c for c in pages.columns if c != "html"]
    return _overlay(_page_fields(pages).join(captured_meta(page_meta, on), list(on), "left"), carried)


def parse_building_pages(pages: DataFrame) -> DataFrame:
    """Parsed posting fields of each page; other columns of ``pages`` are kept.

    A ``meta`` struct column (see :func:`with_page_meta`) takes precedence over the page.
    """
    carried = [c for c in pages.columns if c not in ("html", "meta")]
    if "meta" not in pages.columns:
        pages = pages.withColumn("meta", F.lit(None).cast(META))
    return _overlay(_page_fields(pages), carried)


def _page_fields(pages: DataFrame) -> DataFrame:
    """What a page itself says, in columns that start with ``p_``; other columns but the markup are kept."""
    kept = [c for c in pages.columns if c != "html"]
    page = shred_pages(pages).withColumn("page_text", F.array_join("text_runs", ""))

    def texts(where) -> Column:
        return F.transform(select(where), element_text)

    def meta_tag(key: str, name: str) -> Column:
        return select(lambda e: (e["tag"] == "meta") & F.coalesce(attr(e, key) == name, F.lit(False)))

    page = page.withColumns(
        {
            "low_text": F.lower("page_text"),
            "paragraphs": texts(tagged("p")),
            "head_title": trim_ws(F.array_join(F.transform(select(tagged("title")), own_text), "")),
            "h1": blank_to_null(element_text(first(select(tagged("h1"))))),
            "building": element_text(first(select(class_part(ADDRESS_PART)))),
            "summary": element_text(first(select(class_part(SUMMARY_PART)))),
        }
    )
    bar = rf"{WS}*\|.*\z"
    cut_title = F.regexp_replace(F.regexp_replace("head_title", bar, ""), rf"{WS}*in{WS}+.*\z", "")
    street = blank_to_null(trim_ws(F.try_element_at(F.split("building", ","), F.lit(1))))
    page_hood, page_borough = _place(F.col("head_title"))
    explore = F.filter(
        F.transform(
            select(lambda e: (e["tag"] == "h2") | class_part(EXPLORE_PART)(e)),
            lambda e: blank_to_null(trim_ws(extract(element_text(e), rf"Explore{WS}+(.+)"))),
        ),
        lambda t: t.isNotNull(),
    )
    hood = F.coalesce(
        page_hood,
        F.when(F.length("summary") < 40, blank_to_null(F.col("summary"))),
        first(explore),
    )
    named = F.coalesce(*[F.when(has(F.col("low_text"), f"{b.lower()} rental"), F.lit(b)) for b in BOROUGHS])

    shown_price = parse_money(element_text(first(select(class_part(PRICE_PART)))))
    heading_prices = F.transform(
        select(tagged("h4", "h3", "h2")), lambda e: parse_money(element_text(e))
    )
    net_texts = F.filter("paragraphs", lambda t: has(t, "net effective"))

    def rooms(rule) -> Column:
        return last(F.filter(F.transform(F.transform(F.col("paragraphs"), F.lower), rule), lambda x: x.isNotNull()))

    bed_text, bath_text = rf"\A\d+{WS}*bed", rf"\A\d+\.?\d*{WS}*bath"
    beds = rooms(
        lambda t: F.when(F.regexp_like(t, F.lit(bed_text)), parse_number(extract(t, r"(\d+)"))).when(
            t == "studio", F.lit(0.0)
        )
    )
    baths = rooms(
        lambda t: F.when(
            ~F.regexp_like(t, F.lit(bed_text)) & F.regexp_like(t, F.lit(bath_text)),
            parse_number(extract(t, r"([\d.]+)")),
        )
    )
    text_beds = F.coalesce(
        parse_number(extract(F.col("page_text"), rf"(?i)(\d+){WS}*bed")),
        F.when(has(F.lower(F.left("page_text", F.lit(STUDIO_WITHIN))), "studio"), F.lit(0.0)),
    )
    text_baths = parse_number(extract(F.col("page_text"), rf"(?i)([\d.]+){WS}*bath"))

    def says(text: str) -> Column:
        return has(F.col("low_text"), text)

    fee = F.when(says("can't be charged a broker fee") | says("no fee"), F.lit(False)).when(
        says("broker fee") & ~says("can't be charged"), F.lit(True)
    )
    prose = F.filter(
        "paragraphs",
        lambda t: (F.length(t) > 100) & ~has(t, NOT_DESCRIPTION[0]) & ~has(t, NOT_DESCRIPTION[1]) & ~has(t, NOT_DESCRIPTION[2]),
    )
    # Longest paragraph, the first among equals.
    longest = F.array_max(
        F.transform(prose, lambda t, i: F.struct(F.length(t), -i, t.alias("text")))
    )["text"]
    geo = F.coalesce(
        *[
            blank_to_null(c)
            for c in (
                attr(first(meta_tag("name", "geo.position")), "content"),
                attr(first(meta_tag("name", "ICBM")), "content"),
            )
        ]
    )
    head_images = F.filter(
        F.transform(meta_tag("property", "og:image"), lambda e: attr(e, "content")),
        lambda s: s.isNotNull() & (s != ""),
    )
    page_images = F.filter(
        F.transform(select(tagged("img")), lambda e: F.coalesce(attr(e, "src"), F.lit(""))), is_photo
    )
    images = F.when(F.size(head_images) > 0, head_images).otherwise(page_images)
    laundry = (
        F.when(says("washer/dryer in unit") | says("in-unit laundry"), "in_unit")
        .when(says("laundry in building") | says("on-site laundry"), "in_building")
    )
    fields = {
        "title": F.coalesce("h1", blank_to_null(cut_title)),
        "street": F.when(F.length("building") > 5, street),
        "hood": hood,
        "place_borough": page_borough,
        "named_borough": named,
        "geo": geo,
        "images": images,
        "description": longest,
        "rent_gross": F.coalesce(shown_price, first(F.filter(heading_prices, plausible_rent))),
        "rent_net": parse_money(last(net_texts)),
        "bedrooms": F.coalesce(beds, text_beds),
        "bathrooms": F.coalesce(baths, text_baths),
        "broker_fee": fee,
        "laundry": laundry,
        "elevator": F.when(says("elevator"), F.lit(True)),
        "doorman": F.when(says("doorman"), F.lit(True)),
    }
    return page.select(*kept, *[c.alias(f"p_{name}") for name, c in fields.items()])


def _overlay(page: DataFrame, carried: list[str]) -> DataFrame:
    """Posting fields from ``meta`` where it has them, else from the page."""
    page = page.withColumns(
        {
            "meta_title": F.coalesce(blank_to_null(F.col("meta.title")), blank_to_null(F.col("meta.og_title"))),
            "place_title": F.coalesce(blank_to_null(F.col("meta.og_title")), blank_to_null(F.col("meta.title"))),
        }
    )
    bar = rf"{WS}*\|.*\z"
    cut_meta = F.regexp_replace(F.regexp_replace("meta_title", bar, ""), rf"{WS}*in{WS}+{WORD}.*\z", "")
    title = F.coalesce("p_title", blank_to_null(cut_meta), F.lit("Unknown"))
    unit_tail = rf"{WS}*#({WORD}+){WS}*\z"
    unit = extract(title, unit_tail)
    address = F.coalesce("p_street", F.when(unit.isNotNull(), trim_ws(F.regexp_replace(title, unit_tail, ""))), title)
    meta_hood, meta_borough = _place(F.col("place_title"))
    borough = F.coalesce(
        F.when(meta_hood.isNotNull(), meta_borough).otherwise(F.coalesce("p_place_borough", meta_borough)), "p_named_borough"
    )
    geo = F.coalesce(blank_to_null(F.col("meta.geo_position")), blank_to_null(F.col("meta.icbm")), "p_geo")
    lat, lng = geo_pair(geo)
    return page.select(
        *carried,
        title.alias("title"),
        F.col("p_description").alias("description"),
        address.alias("address"),
        unit.alias("unit"),
        F.coalesce(meta_hood, "p_hood").alias("neighborhood"),
        borough.alias("borough"),
        lat.alias("lat"),
        lng.alias("lng"),
        F.col("p_rent_gross").alias("rent_gross"),
        F.col("p_rent_net").alias("rent_net"),
        F.col("p_bedrooms").alias("bedrooms"),
        F.col("p_bathrooms").alias("bathrooms"),
        F.col("p_broker_fee").alias("broker_fee"),
        F.lit(None).cast("int").alias("lease_term_months"),
        F.lit(None).cast("string").alias("move_in_notes"),
        F.lit(None).cast("string").alias("pet_policy"),
        F.col("p_laundry").alias("laundry"),
        F.col("p_elevator").alias("elevator"),
        F.col("p_doorman").alias("doorman"),
        F.when(F.size("meta.og_images") > 0, F.col("meta.og_images")).otherwise(F.col("p_images")).alias("images"),
    )
