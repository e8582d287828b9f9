"""Queries over the scalar rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text, urls
from ..operators.duplicates import exact_duplicates
from ..sources.building_page import is_photo, plausible_rent
from .catalog import query, sql_cell, sql_normalize
from .views import POSTINGS_SQL, postings_view, table


def _pick(selector, *choices):
    """Choice number ``selector`` (0-based)."""
    out = choices[-1]
    for i in range(len(choices) - 2, -1, -1):
        out = F.when(selector == i, choices[i]).otherwise(out)
    return out


def _sql_pick(selector: str, *choices: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(choices[:-1]))
    return f"CASE {selector} {whens} ELSE {choices[-1]} END"


_RAW_SQL = _sql_pick(
    "custkey % 8",
    "address",
    "address || ' Apt ' || coalesce(unit, '')",
    "replace(address, 'West', 'East') || ' #3a'",
    "'  ' || upper(address) || ' ,.'",
    "replace(address, 'West', 'Last')",
    "address || '#' || coalesce(unit, 'x')",
    "replace(address, 'Street', 'Avenue') || ', Suite. 4'",
    "'Apt 3'",
)


@query(f"""
WITH p AS ({POSTINGS_SQL}), r AS (SELECT listing_id, {_RAW_SQL} AS raw FROM p)
SELECT listing_id, {sql_normalize('raw')} AS normalized, {sql_normalize('raw', False)} AS corrected FROM r
""")
def normalize_address(spark, sf_dir):
    p = postings_view(spark, sf_dir, place=False)
    a, u = F.col("address"), F.coalesce("unit", F.lit(""))
    swap = lambda old, new: F.replace(a, F.lit(old), F.lit(new))
    raw = _pick(
        F.col("custkey") % 8,
        a,
        F.concat(a, F.lit(" Apt "), u),
        F.concat(swap("West", "East"), F.lit(" #3a")),
        F.concat(F.lit("  "), F.upper(a), F.lit(" ,.")),
        swap("West", "Last"),
        F.concat(a, F.lit("#"), F.coalesce("unit", F.lit("x"))),
        F.concat(swap("Street", "Avenue"), F.lit(", Suite. 4")),
        F.lit("Apt 3"),
    )
    rows = p.select("listing_id", raw.alias("raw"))
    return rows.select(
        "listing_id",
        text.normalize_address(F.col("raw")).alias("normalized"),
        text.normalize_address(F.col("raw"), strict=False).alias("corrected"),
    )


_LOCATION_SQL = _sql_pick(
    "custkey % 6",
    "address || ' Apt ' || coalesce(unit, '9Z')",
    "address || ', Unit ' || coalesce(unit, '9z')",
    "CAST(custkey AS VARCHAR) || ' Sterling'",
    "address",
    "'  '",
    "address || ' #' || coalesce(unit, '7') || ' '",
)
_UNIT_RE = r"[,\s]+(?:apt|apartment|unit|suite|ste|#)\s*\.?\s*(\w+)\s*$"


@query(rf"""
WITH p AS ({POSTINGS_SQL}), r AS (SELECT listing_id, {_LOCATION_SQL} AS location FROM p)
SELECT listing_id,
       nullif(trim(regexp_replace(location, '{_UNIT_RE}', '', 'i')), '') AS address,
       nullif(regexp_extract(location, '{_UNIT_RE}', 1, 'i'), '') AS unit
FROM r
""")
def split_address_unit(spark, sf_dir):
    p = postings_view(spark, sf_dir, place=False)
    a = F.col("address")
    unit = lambda default: F.coalesce("unit", F.lit(default))
    location = _pick(
        F.col("custkey") % 6,
        F.concat(a, F.lit(" Apt "), unit("9Z")),
        F.concat(a, F.lit(", Unit "), unit("9z")),
        F.concat(F.col("custkey").cast("string"), F.lit(" Sterling")),
        a,
        F.lit("  "),
        F.concat(a, F.lit(" #"), unit("7"), F.lit(" ")),
    )
    rows = p.select("listing_id", location.alias("location"))
    return rows.select(
        "listing_id", text.split_address(F.col("location")).alias("address"), text.split_unit(F.col("location")).alias("unit")
    )


@query(f"""
WITH p AS ({POSTINGS_SQL})
SELECT listing_id, {sql_cell('lat')} AS cell_lat, {sql_cell('lng')} AS cell_lng,
       CASE WHEN lat IS NOT NULL AND lng IS NOT NULL
            THEN printf('%.3f,%.3f', CAST({sql_cell('lat')} AS DOUBLE) / 1000, CAST({sql_cell('lng')} AS DOUBLE) / 1000)
       END AS geo_cell
FROM p
""")
def geo_cell(spark, sf_dir):
    lat, lng = F.col("lat"), F.col("lng")
    return postings_view(spark, sf_dir, place=False).select(
        "listing_id",
        geo.cell_index(lat).alias("cell_lat"),
        geo.cell_index(lng).alias("cell_lng"),
        geo.geo_cell(lat, lng).alias("geo_cell"),
    )


@query(r"""
SELECT page_id, try_cast(replace(regexp_extract(html, '\$\s*([\d,]+)', 1), ',', '') AS INTEGER) AS first_amount
FROM pages
""")
def page_amounts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.parse_money(F.col("html")).alias("first_amount"))


_NUMBER_SQL = _sql_pick(
    "orderkey % 5",
    "CAST(bedrooms AS VARCHAR) || ' beds'",
    "'  ' || CAST(orderkey AS VARCHAR) || '.5baths'",
    "'x' || CAST(orderkey AS VARCHAR)",
    "'.75 or so'",
    "''",
)


@query(rf"""
WITH p AS ({POSTINGS_SQL}),
r AS (SELECT listing_id, {_NUMBER_SQL} AS n,
             CASE WHEN orderkey % 6 = 0 THEN 'free' ELSE 'rent $ ' || format('{{:,}}', rent_gross) || '.50/mo' END AS m FROM p)
SELECT listing_id,
       try_cast(replace(regexp_extract(m, '\$\s*([\d,]+)', 1), ',', '') AS INTEGER) AS amount,
       try_cast(regexp_extract(n, '^\s*([+-]?(?:\d+\.?\d*|\.\d+))', 1) AS DOUBLE) AS number
FROM r
""")
def parse_money_number(spark, sf_dir):
    p = postings_view(spark, sf_dir, place=False)
    key = F.col("orderkey")
    number = _pick(
        key % 5,
        F.concat(F.col("bedrooms").cast("string"), F.lit(" beds")),
        F.concat(F.lit("  "), key.cast("string"), F.lit(".5baths")),
        F.concat(F.lit("x"), key.cast("string")),
        F.lit(".75 or so"),
        F.lit(""),
    )
    money = F.when(key % 6 == 0, "free").otherwise(
        F.concat(F.lit("rent $ "), F.format_number("rent_gross", 0), F.lit(".50/mo"))
    )
    rows = p.select("listing_id", number.alias("n"), money.alias("m"))
    return rows.select(
        "listing_id", text.parse_money(F.col("m")).alias("amount"), text.parse_number(F.col("n")).alias("number")
    )


# Free texts of the flag rules, chosen by posting.
_FEES = ("No Fee!", "broker fee 15%", "one month fee", "", "call us")
_PETS = ("No pets", "Cats and Dogs ok", "cats ok", "small dogs", "ask", "")
_LAUNDRY = ("W/D In Unit", "laundry in bldg", "Laundry in Building", "laundromat next door", "")
_TERMS = ("12 months lease", "1 Month", "flexible", "from 6  months")
_BOROS = ("manhattan", "BROOKLYN", " queens ", "staten island", "jersey CITY", "Bronx")


def _lits(values):
    return [F.lit(v) for v in values]


def _sql_lits(values):
    return [f"'{v}'" for v in values]


@query(f"""
WITH p AS ({POSTINGS_SQL}),
r AS (SELECT listing_id,
             {_sql_pick('custkey % 5', *_sql_lits(_FEES))} AS fee, {_sql_pick('orderkey % 6', *_sql_lits(_PETS))} AS pets,
             {_sql_pick('orderkey % 5', *_sql_lits(_LAUNDRY))} AS laundry,
             {_sql_pick('orderkey % 4', *_sql_lits(_TERMS))} AS term, {_sql_pick('custkey % 6', *_sql_lits(_BOROS))} AS boro
      FROM p)
SELECT listing_id,
       CASE WHEN contains(lower(fee), 'no fee') THEN false
            WHEN contains(lower(fee), 'broker') OR contains(lower(fee), 'fee') THEN true END AS broker_fee,
       nullif(CASE WHEN contains(lower(pets), 'no pet') THEN 'no_pets'
            WHEN contains(lower(pets), 'dogs') AND contains(lower(pets), 'cats') THEN 'pets_allowed'
            WHEN contains(lower(pets), 'cats') THEN 'cats_only'
            WHEN contains(lower(pets), 'dogs') THEN 'dogs_only' ELSE pets END, '') AS pet_policy,
       nullif(CASE WHEN contains(lower(laundry), 'in unit') THEN 'in_unit'
            WHEN contains(lower(laundry), 'in bldg') OR contains(lower(laundry), 'in building') THEN 'in_building'
            ELSE laundry END, '') AS laundry,
       try_cast(regexp_extract(term, '(\\d+)\\s*month', 1, 'i') AS INTEGER) AS lease_months,
       CASE lower(boro) WHEN 'manhattan' THEN 'Manhattan' WHEN 'brooklyn' THEN 'Brooklyn' WHEN 'queens' THEN 'Queens'
            WHEN 'bronx' THEN 'Bronx' WHEN 'staten island' THEN 'Staten Island' ELSE boro END AS borough_kept,
       CASE trim(lower(boro)) WHEN 'manhattan' THEN 'Manhattan' WHEN 'brooklyn' THEN 'Brooklyn' WHEN 'queens' THEN 'Queens'
            WHEN 'bronx' THEN 'Bronx' WHEN 'staten island' THEN 'Staten Island'
            ELSE array_to_string(list_transform(string_split(lower(boro), ' '), lambda w: upper(w[1]) || w[2:]), ' ')
       END AS borough_titled,
       upper(boro[1]) || boro[2:] AS capitalized
FROM r
""")
def text_flags(spark, sf_dir):
    p = postings_view(spark, sf_dir, place=False)
    cust, key = F.col("custkey"), F.col("orderkey")
    rows = p.select(
        "listing_id",
        _pick(cust % 5, *_lits(_FEES)).alias("fee"),
        _pick(key % 6, *_lits(_PETS)).alias("pets"),
        _pick(key % 5, *_lits(_LAUNDRY)).alias("laundry"),
        _pick(key % 4, *_lits(_TERMS)).alias("term"),
        _pick(cust % 6, *_lits(_BOROS)).alias("boro"),
    )
    return rows.select(
        "listing_id",
        text.parse_fee(F.col("fee")).alias("broker_fee"),
        text.parse_pets(F.col("pets")).alias("pet_policy"),
        text.parse_laundry(F.col("laundry")).alias("laundry"),
        text.parse_lease_months(F.col("term")).alias("lease_months"),
        text.borough_or_same(F.col("boro")).alias("borough_kept"),
        text.borough_or_title(F.col("boro")).alias("borough_titled"),
        text.capitalize(F.col("boro")).alias("capitalized"),
    )


_URL_SQL = _sql_pick(
    "page_id % 5",
    "url",
    "'https://www.leasebreak.com/short-term-rental-details/' || page_id || '/some-place'",
    "'https://streeteasy.com/building/b-' || page_id || '-street/2g?utm=1'",
    "'https://STREETEASY.com/building/b' || page_id || '/2G'",
    "'no url ' || page_id",
)


@query(rf"""
WITH r AS (SELECT page_id, {_URL_SQL} AS u FROM pages)
SELECT page_id,
       coalesce(nullif(regexp_extract(u, '/(\d+)/', 1), ''), nullif(regexp_extract(u, '/building/(.+)$', 1), '')) AS url_id,
       coalesce(nullif(regexp_extract(u, '/building/(.+)$', 1), ''), u) AS building_id,
       nullif(regexp_extract(u, 'streeteasy\.com/(?:building|rental)/(.+?)(?:\?|$)', 1), '') AS import_id,
       CASE WHEN regexp_matches(u, '/short-term-rental-details/\d+/') THEN 'sublet_pages'
            WHEN regexp_matches(u, '/building/[a-z0-9_-]+/[a-z0-9_-]+$', 'i') THEN 'building_pages' END AS source,
       coalesce(nullif(lower(regexp_extract(u, '^[a-z]+://([^/?#:]+)', 1)), ''), 'unknown') AS host,
       string_split(u, '?')[1] AS bare_url
FROM r
""")
def url_parts(spark, sf_dir):
    page = F.col("page_id").cast("string")
    url = _pick(
        F.col("page_id") % 5,
        F.col("url"),
        F.concat(F.lit("https://www.leasebreak.com/short-term-rental-details/"), page, F.lit("/some-place")),
        F.concat(F.lit("https://streeteasy.com/building/b-"), page, F.lit("-street/2g?utm=1")),
        F.concat(F.lit("https://STREETEASY.com/building/b"), page, F.lit("/2G")),
        F.concat(F.lit("no url "), page),
    )
    u = F.col("u")
    return table(spark, sf_dir, "pages").select("page_id", url.alias("u")).select(
        "page_id",
        urls.url_id(u).alias("url_id"),
        urls.building_id(u).alias("building_id"),
        urls.import_id(u).alias("import_id"),
        urls.classify_url(u).alias("source"),
        urls.url_host(u).alias("host"),
        urls.strip_query(u).alias("bare_url"),
    )


@query("""
SELECT sha256(text) AS fingerprint, count(*) AS copies, min(doc_id) AS first_key
FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def content_fingerprint_dups(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""
SELECT o_orderkey AS orderkey,
       CASE o_orderkey % 4 WHEN 2 THEN NULL WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%d')
            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed
FROM orders
""")
def parse_dates(spark, sf_dir):
    day = F.col("o_orderdate")
    written = _pick(
        F.col("o_orderkey") % 4,
        F.date_format(day, "MMM dd, yyyy"),
        F.concat(F.lit("Available from "), F.date_format(day, "MMMM d, yyyy"), F.lit(" on")),
        F.lit("Any day"),
        F.date_format(day, "yyyy-MM-dd"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("w"))
    return rows.select(F.col("o_orderkey").alias("orderkey"), text.parse_date(F.col("w")).cast("string").alias("parsed"))


@query(f"""
WITH p AS ({POSTINGS_SQL})
SELECT listing_id, CASE WHEN orderkey % 11 <> 0 THEN lat END AS lat,
       CASE WHEN orderkey % 13 <> 0 THEN lng END AS lng
FROM p
""")
def split_geo(spark, sf_dir):
    part = lambda c, zero, junk: F.when(F.col("orderkey") % zero == 0, junk).otherwise(F.col(c).cast("string"))
    pair = F.concat(part("lat", 11, "0"), F.when(F.col("orderkey") % 2 == 0, ";").otherwise(", "), part("lng", 13, "n/a"))
    rows = postings_view(spark, sf_dir, place=False).select(
        "listing_id",
        F.when(F.col("lat").isNotNull(), pair).otherwise("unknown").alias("g"),
    )
    lat, lng = geo.geo_pair(F.col("g"))
    return rows.select("listing_id", lat.alias("lat"), lng.alias("lng"))


@query(f"""
WITH p AS ({POSTINGS_SQL}),
r AS (SELECT listing_id, CASE WHEN orderkey % 6 <> 0 THEN bedrooms END AS a, (orderkey % 9) * CAST(0.5 AS DOUBLE) AS b,
             CASE WHEN orderkey % 7 <> 0 THEN bathrooms END AS c, 1 + (orderkey % 5) * CAST(0.25 AS DOUBLE) AS d FROM p)
SELECT listing_id, coalesce(abs(a - b) <= 0.5, false) AND coalesce(abs(c - d) <= 0.5, true) AS close FROM r
""")
def beds_baths_close(spark, sf_dir):
    key = F.col("orderkey")
    rows = postings_view(spark, sf_dir, place=False).select(
        "listing_id",
        F.when(key % 6 != 0, F.col("bedrooms")).alias("a"),
        ((key % 9) * F.lit(0.5)).alias("b"),
        F.when(key % 7 != 0, F.col("bathrooms")).alias("c"),
        (1 + (key % 5) * F.lit(0.25)).alias("d"),
    )
    close = geo.rooms_close(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return rows.select("listing_id", close.alias("close"))


@query(f"""
WITH p AS ({POSTINGS_SQL}), r AS (SELECT listing_id, [custkey % 900, rent_gross, rent_gross * 40] AS amounts FROM p),
k AS (SELECT listing_id, list_filter(amounts, lambda a: a > 500 AND a < 100000) AS kept FROM r)
SELECT listing_id, CAST(len(kept) AS BIGINT) AS plausible, CAST(kept[1] AS BIGINT) AS first_plausible FROM k
""")
def plausible_rents(spark, sf_dir):
    amounts = F.array((F.col("custkey") % 900).cast("bigint"), F.col("rent_gross").cast("bigint"), F.col("rent_gross").cast("bigint") * 40)
    kept = postings_view(spark, sf_dir, place=False).select("listing_id", F.filter(amounts, plausible_rent).alias("kept"))
    return kept.select(
        "listing_id",
        F.size("kept").cast("bigint").alias("plausible"),
        F.try_element_at("kept", F.lit(1)).alias("first_plausible"),
    )


@query(f"""
WITH p AS ({POSTINGS_SQL}),
r AS (SELECT listing_id, ['https://photos.zillowstatic.com/' || custkey || '.jpg', 'https://streeteasy.com/logo.png',
      CASE WHEN orderkey % 3 = 0 THEN 'https://cdn.example.com/x.jpg' ELSE 'https://cdn.streeteasy.com/' || orderkey || '.jpg' END] AS images FROM p)
SELECT listing_id, array_to_string(list_filter(images, lambda s: (contains(s, 'zillowstatic') OR contains(s, 'streeteasy'))
       AND NOT contains(s, 'logo') AND NOT contains(s, 'icon') AND NOT contains(s, 'avatar')), ' ') AS kept
FROM r
""")
def kept_images(spark, sf_dir):
    images = F.array(
        F.concat(F.lit("https://photos.zillowstatic.com/"), F.col("custkey").cast("string"), F.lit(".jpg")),
        F.lit("https://streeteasy.com/logo.png"),
        F.when(F.col("orderkey") % 3 == 0, "https://cdn.example.com/x.jpg").otherwise(
            F.concat(F.lit("https://cdn.streeteasy.com/"), F.col("orderkey").cast("string"), F.lit(".jpg"))
        ),
    )
    return postings_view(spark, sf_dir, place=False).select(
        "listing_id", F.array_join(F.filter(images, is_photo), " ").alias("kept")
    )


@query(f"""
WITH p AS ({POSTINGS_SQL}),
r AS (SELECT listing_id, list_filter([3 + custkey % 10, orderkey % 14, CASE WHEN orderkey % 2 = 0 THEN 24 END], lambda m: m > 0) AS m FROM p)
SELECT listing_id, CAST(list_min(m) AS BIGINT) AS lease_term_months FROM r
""")
def min_lease_term(spark, sf_dir):
    cells = F.array(
        F.concat((3 + F.col("custkey") % 10).cast("string"), F.lit(" months")),
        F.concat((F.col("orderkey") % 14).cast("string"), F.lit(" Month stay")),
        F.when(F.col("orderkey") % 2 == 0, "24month").otherwise("open end"),
    )
    months = F.filter(F.transform(cells, text.parse_lease_months), lambda m: m > 0)
    return postings_view(spark, sf_dir, place=False).select(
        "listing_id", F.array_min(months).cast("bigint").alias("lease_term_months")
    )
