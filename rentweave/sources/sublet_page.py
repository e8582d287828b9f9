"""Postings from sublet detail pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    blank_to_null, borough_or_title, extract, has, parse_lease_months, parse_money, parse_number,
    title_case, trim_ws, WS,
)
from .html import ELS, all_attrs, classed, element_text, first, first_text, inside, last, select, shred_pages, tagged

# Texts and class names the page marks its fields with.
TITLE_SUFFIX = " | LeaseBreak.com"
LOCATION, LABEL, VALUE, DATE, FEE = (
    "title-detail-apartments-text", "title-icon", "nums-icon", "date-icon", "listing-details-value",
)
TERM_HEADING, DETAILS_HEADING, FEATURES_HEADING = "Pricing Based on Lease Term", "Property Details", "Features"
NO_BROKERAGE, BROKERAGE = "not charging a brokerage fee", "charging a brokerage fee"
IMAGE_HOST, IMAGE_FOLDER = "images.leasebreak.com", "uploads"


def _after(heads: str) -> Column:
    """Elements on the same level behind any of the heads, in document order."""
    behind = F.filter(
        ELS, lambda e: F.exists(heads, lambda h: (h["parent"] == e["parent"]) & (h["seq"] < e["seq"]))
    )
    return F.when(F.size(heads) > 0, behind).otherwise(F.filter(ELS, lambda e: F.lit(False)))


def _last_hit(values: Column, rule) -> Column:
    return last(F.filter(F.transform(values, rule), lambda x: x.isNotNull()))


def parse_sublet_pages(pages: DataFrame) -> DataFrame:
    """Parsed posting fields of each page; other columns of ``pages`` are kept."""
    carried = [c for c in pages.columns if c != "html"]
    # The raw markup is only needed for one price pattern; it need not cross into Python twice.
    raw_price = parse_money(extract(F.col("html"), rf"(?i)(\${WS}*[\d,]+){WS}*/{WS}*mo"))
    shredded = shred_pages(pages.withColumn("raw_price", raw_price))

    # Whatever a lambda looks up is a column of an earlier step, so that it is computed
    # once per page and not once per element.
    def heading(text: str) -> Column:
        return select(lambda e: (e["tag"] == "h2") & (element_text(e) == text))

    marked = shredded.withColumns(
        {
            "icons": select(classed(LABEL)),
            "values": select(lambda e: classed(VALUE)(e) | classed(DATE)(e)),
            "divs": select(tagged("div")),
            "table": first(select(tagged("table"))),
            "details_heads": heading(DETAILS_HEADING),
            "features_heads": heading(FEATURES_HEADING),
        }
    )
    enclosing = lambda e: last(
        F.filter("divs", lambda d: (d["seq"] <= e["seq"]) & (e["seq"] < d["end_seq"]))
    )
    boxed = marked.withColumns(
        {
            "boxes": F.when(
                F.size("divs") > 0,
                F.transform("icons", lambda e: F.struct(element_text(e).alias("label"), enclosing(e).alias("box"))),
            ),
            "rows": select(lambda e: (e["tag"] == "tr") & inside(e, F.col("table"))),
            "cells": select(lambda e: (e["tag"] == "td") & inside(e, F.col("table"))),
            "behind_details": _after("details_heads"),
            "feature_box": first(F.filter(_after("features_heads"), tagged("ul", "div"))),
        }
    )

    def boxed_text(box: Column, *names: str) -> Column:
        hit = lambda e: inside(e, box) & F.arrays_overlap(e["classes"], F.array(*[F.lit(n) for n in names]))
        return F.coalesce(element_text(first(F.filter("values", hit))), F.lit(""))

    staged = boxed.withColumns(
        {
            "labels": F.transform(
                "boxes",
                lambda x: F.struct(
                    x["label"].alias("label"),
                    boxed_text(x["box"], VALUE).alias("value"),
                    boxed_text(x["box"], VALUE, DATE).alias("when"),
                ),
            ),
            "features": F.filter(
                F.transform(
                    select(lambda e: e["tag"].isin("li", "span") & inside(e, F.col("feature_box"))), element_text
                ),
                lambda t: (F.length(t) > 0) & (F.length(t) < 100),
            ),
        }
    )

    location = F.transform(F.split(first_text(classed(LOCATION)), ","), trim_ws)
    beds = last(F.filter("labels", lambda x: has(F.lower(x["label"]), "bedroom")))["value"]
    baths = last(
        F.filter("labels", lambda x: has(F.lower(x["label"]), "bathroom") & ~has(F.lower(x["label"]), "bedroom"))
    )["value"]

    def cells(row: Column) -> Column:
        return F.filter("cells", lambda e: inside(e, row))

    second_cells = cells(F.try_element_at("rows", F.lit(2)))
    table_price = parse_money(element_text(F.try_element_at(second_cells, F.lit(2))))
    fee = _last_hit(
        F.transform(select(classed(FEE)), lambda e: F.lower(element_text(e))),
        lambda t: F.when(has(t, NO_BROKERAGE), F.lit(False)).when(
            has(t, BROKERAGE) & ~has(t, "not"), F.lit(True)
        ),
    )
    terms = F.transform(
        F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1))),
        lambda row: parse_lease_months(F.coalesce(element_text(first(cells(row))), F.lit(""))),
    )
    has_terms = F.exists(ELS, lambda e: (e["tag"] == "h3") & has(element_text(e), TERM_HEADING))
    moves = F.filter(
        "labels",
        lambda x: (has(x["label"], "Move-In") | has(x["label"], "Move-Out") | has(x["label"], "move-out"))
        & (x["when"] != ""),
    )
    stop = F.coalesce(
        first(F.filter("behind_details", tagged("h2")))["seq"], F.lit(2147483647)
    )
    details = F.filter(
        F.transform(F.filter("behind_details", lambda e: e["seq"] < stop), element_text), lambda t: t != ""
    )
    body = blank_to_null(trim_ws(F.array_join(details, "\n")))
    listed = F.when(F.size("features") > 0, F.concat(F.lit("Features: "), F.array_join("features", ", ")))

    def feature(rule) -> Column:
        return _last_hit(F.transform(F.col("features"), F.lower), rule)

    title = F.coalesce(
        first_text(tagged("h2")),
        blank_to_null(F.replace(first_text(tagged("title")), F.lit(TITLE_SUFFIX), F.lit(""))),
        F.lit("Unknown"),
    )
    any_feature = lambda word: F.when(
        F.exists("features", lambda t: has(F.lower(t), word)), F.lit(True)
    )
    return staged.select(
        *carried,
        title.alias("title"),
        F.concat_ws("\n\n", body, listed).alias("_description"),
        title.alias("address"),
        F.lit(None).cast("string").alias("unit"),
        title_case(F.try_element_at(location, F.lit(1))).alias("neighborhood"),
        borough_or_title(F.try_element_at(location, F.lit(2))).alias("borough"),
        F.lit(None).cast("double").alias("lat"),
        F.lit(None).cast("double").alias("lng"),
        F.coalesce(table_price, "raw_price").alias("rent_gross"),
        F.lit(None).cast("int").alias("rent_net"),
        F.when(has(F.lower(beds), "studio"), F.lit(0.0)).otherwise(parse_number(beds)).alias("bedrooms"),
        parse_number(baths).alias("bathrooms"),
        fee.alias("broker_fee"),
        F.when(has_terms, F.array_min(F.filter(terms, lambda m: m > 0))).alias("lease_term_months"),
        blank_to_null(
            F.array_join(F.transform(moves, lambda x: F.concat_ws(" ", x["label"], x["when"])), "; ")
        ).alias("move_in_notes"),
        feature(
            lambda t: F.when(has(t, "pet friendly"), "pets_allowed")
            .when(has(t, "no pets"), "no_pets")
            .when(has(t, "cats"), "cats_only")
            .when(has(t, "dogs"), "dogs_only")
        ).alias("pet_policy"),
        feature(
            lambda t: F.when(has(t, "washer") & has(t, "unit"), "in_unit").when(
                has(t, "laundry") & has(t, "building"), "in_building"
            )
        ).alias("laundry"),
        any_feature("elevator").alias("elevator"),
        any_feature("doorman").alias("doorman"),
        F.filter(
            all_attrs(tagged("img"), "src"), lambda s: has(s, IMAGE_HOST) & has(s, IMAGE_FOLDER)
        ).alias("images"),
    ).withColumn("description", blank_to_null(F.col("_description"))).drop("_description")
