from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rentweave.functions import geo, text, urls
from rentweave.operators.frontier import discovery_query
from rentweave.operators.registry import freshness_state
from rentweave.operators.search import clamp_limit, clamp_page


def evaluate(spark, rule, values, dtype="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    return [r[0] for r in df.select(rule(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


CASES = [
    (text.parse_money, {"$3,500/mo": 3500, "$7,294": 7294, "free": None, "$ ,": None, None: None, "$12.75": 12}),
    (text.parse_number, {"2": 2.0, "1.5": 1.5, "": None, " 3 beds": 3.0, "x1": None, "-.5": -0.5}),
    (
        lambda c: text.parse_date(c).cast("string"),
        {"Feb 07, 2026": "2026-02-07", "January 15, 2026": "2026-01-15", None: None, "on Mar 5 2026": "2026-03-05",
         "2026-02-07": "2026-02-07", "Feb 30, 2026": "2026-03-02", "Foo 12, 2026": None},
    ),
    (
        text.normalize_address,
        {"5 Last Road": "5 e rd", "12 Sterling": "12", "100 unity": "100", "10 Main St Apt 3-A": "10 main st apt 3-a",
         "10 Main St #3A": "10 main st #3a", "10 Main St#3A": "10 main st", "Apt 3": "",
         "245 East 7th Street": "245 east 7th st", " 156  North\t4th Street ,.": "156 n 4th st", None: None,
         "9 Éast Street\n": "9 éast st"},
    ),
    (lambda c: text.normalize_address(c, strict=False), {"245 East 7th Street": "245 e 7th st", "5 Last Road": "5 last rd"}),
    (text.split_unit, {"245 E 7th St Apt 3A": "3A", "156 N 4th St, Unit 5B": "5B", "12 Sterling": "rling", "1 Oak": None}),
    (text.split_address, {"245 E 7th St Apt 3A": "245 E 7th St", "12 Sterling": "12", "  ": None}),
    (text.parse_fee, {"no fee": False, "broker fee": True, "fee": True, "": None, "ask": None, None: None}),
    (text.parse_pets, {"cats ok": "cats_only", "dogs and cats ok": "pets_allowed", "no pets": "no_pets", "": None, "ask": "ask"}),
    (text.parse_laundry, {"laundry in bldg": "in_building", "w/d in unit": "in_unit", "": None, "near": "near"}),
    (text.title_case, {"eAST vILLAGE-x": "East Village-x"}),
    (text.capitalize, {"queens": "Queens", "": ""}),
    (text.borough_or_title, {" STATEN island ": "Staten Island", "jersey city": "Jersey City"}),
    (text.borough_or_same, {"queens": "Queens", "jersey city": "jersey city"}),
    (text.parse_lease_months, {"8 months": 8, "1 Month": 1, "long": None}),
    (text.trim_ws, {" ﻿ a b\n": "a b"}),
    (
        urls.url_id,
        {"https://h/short-term-rental-details/353111/x": "353111", "https://h/building/a-b/2g": "a-b/2g", "https://h/": None},
    ),
    (urls.url_host, {"https://WWW.Example.com/x": "www.example.com", "nothing": "unknown"}),
    (urls.strip_query, {"https://h/a?b=1": "https://h/a"}),
    (urls.classify_url, {"https://h/short-term-rental-details/1/x": "sublet_pages", "https://h/building/A/2G": "building_pages",
                         "https://h/building/a/2g/": None}),
]


@pytest.mark.parametrize("rule, cases", CASES)
def test_text_rules(spark, rule, cases):
    assert evaluate(spark, rule, list(cases)) == list(cases.values())


def test_cells_round_halves_up(spark):
    assert evaluate(spark, geo.cell_index, [-73.9615, -73.9614, 40.7265, 0.0], "double") == [-73961, -73961, 40727, 0]


def test_geo_pair(spark):
    rows = evaluate(spark, lambda c: F.struct(*geo.geo_pair(c)), ["40.7;-73.9", "40.7, 0", "x,1", None])
    assert [tuple(r) for r in rows] == [(40.7, -73.9), (40.7, None), (None, 1.0), (None, None)]


def test_freshness_limits(spark):
    now = datetime(2026, 2, 15)
    ms = timedelta(milliseconds=1)
    ages = [timedelta(days=7), timedelta(days=7) + ms, timedelta(days=14), timedelta(days=14) + ms]
    states = evaluate(
        spark, lambda c: freshness_state(c, F.lit("2026-02-15").cast("timestamp_ntz")), [now - a for a in ages], "timestamp_ntz"
    )
    assert states == ["active", "unknown", "unknown", "stale"]


def test_clamps(spark):
    assert evaluate(spark, clamp_page, [0, -3, 5, None], "int") == [1, 1, 5, 1]
    assert evaluate(spark, clamp_limit, [0, 101, 50, None], "int") == [1, 100, 50, 20]


def test_discovery_query(spark):
    row = spark.createDataFrame(
        [("sunny", 3000, 2.0, "Queens", "Astoria", True), ("x" * 200, 0, 0.0, None, "", None), ("p", None, 1.5, None, None, False)],
        "prompt string, max_rent int, min_beds double, borough string, neighborhood string, no_fee boolean",
    )
    out = [r[0] for r in row.select(discovery_query(*[F.col(c) for c in row.columns])).collect()]
    assert out == [
        "NYC apartment for rent Queens Astoria under $3000 2 bedroom no fee sunny",
        "NYC apartment for rent",
        "NYC apartment for rent 1.5 bedroom p",
    ]
