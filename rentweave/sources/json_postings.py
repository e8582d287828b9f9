"""Postings delivered as JSON: structured and classifieds-style records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    blank_to_null, borough_or_same, capitalize, parse_fee, parse_laundry, parse_pets, split_address, split_unit,
)
from ..schemas import LISTINGS, PARSED_FIELDS, column_types

STRUCTURED = """
    id string, title string, description string, address string, unit string, neighborhood string,
    borough string, lat double, lng double, rent int, netEffectiveRent int, bedrooms double,
    bathrooms double, brokerFee boolean, leaseTermMonths int, petPolicy string, laundry string,
    elevator boolean, doorman boolean, images array<string>"""

CLASSIFIED = """
    post_id string, post_title string, body string, location string, area string, boro string,
    latitude double, longitude double, price int, br double, ba double, fee string, pets string,
    laundry_situation string, has_elevator boolean, has_doorman boolean, pic_urls array<string>"""

_CORRUPT = "_corrupt"


def _read(content: Column, schema: str) -> Column:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    return F.from_json(content, f"{schema}, {_CORRUPT} string", options)


def _parsed(df: DataFrame, carried: list[str], fields: dict[str, Column]) -> DataFrame:
    """Carried columns, all posting fields (null when the source has none), parse error."""
    types = column_types(LISTINGS)
    bad = F.col("r").isNull() | F.col(f"r.{_CORRUPT}").isNotNull()
    return df.select(
        *carried,
        *[
            F.when(~bad, fields.get(name, F.lit(None))).cast(types[name]).alias(name)
            for name in PARSED_FIELDS
        ],
        F.when(bad, F.lit("malformed json")).alias("error"),
    )


def parse_structured(raw: DataFrame, content: str = "raw_content") -> DataFrame:
    """Structured records: renames, defaults, capitalised borough."""
    r = lambda name: F.col(f"r.{name}")
    carried = [c for c in raw.columns if c != content]
    same = ("title", "description", "address", "unit", "neighborhood", "lat", "lng", "bedrooms", "bathrooms",
            "laundry", "elevator", "doorman")
    return _parsed(
        raw.withColumn("r", _read(F.col(content), STRUCTURED)),
        carried,
        {
            **{name: r(name) for name in same},
            "borough": blank_to_null(capitalize(r("borough"))),
            "rent_gross": r("rent"),
            "rent_net": r("netEffectiveRent"),
            "broker_fee": r("brokerFee"),
            "lease_term_months": r("leaseTermMonths"),
            "pet_policy": r("petPolicy"),
            "images": F.coalesce(r("images"), F.array().cast("array<string>")),
        },
    )


def parse_classified(raw: DataFrame, content: str = "raw_content") -> DataFrame:
    """Classifieds records: address and unit from one text, free-text fee, pets and laundry."""
    r = lambda name: F.col(f"r.{name}")
    carried = [c for c in raw.columns if c != content]
    return _parsed(
        raw.withColumn("r", _read(F.col(content), CLASSIFIED)),
        carried,
        {
            "title": r("post_title"),
            "description": r("body"),
            "address": split_address(r("location")),
            "unit": split_unit(r("location")),
            "neighborhood": r("area"),
            "borough": blank_to_null(borough_or_same(r("boro"))),
            "lat": r("latitude"),
            "lng": r("longitude"),
            "rent_gross": r("price"),
            "bedrooms": r("br"),
            "bathrooms": r("ba"),
            "broker_fee": parse_fee(r("fee")),
            "pet_policy": parse_pets(r("pets")),
            "laundry": parse_laundry(r("laundry_situation")),
            "elevator": r("has_elevator"),
            "doorman": r("has_doorman"),
            "images": F.coalesce(r("pic_urls"), F.array().cast("array<string>")),
        },
    )


def extracted_json(fields: list[str]) -> Column:
    """Parsed fields as one JSON text, nulls written out."""
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
