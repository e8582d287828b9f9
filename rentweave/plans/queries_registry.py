"""Queries over units: refresh, freshness, history, search, detail."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions.text import normalize_address
from ..operators import detail, history, search
from ..operators.merge import keyed_upsert, upsert_links, upsert_listings
from ..operators.merge import FOLDER_IMPORT_COLUMNS
from ..operators.registry import freshness_counts as count_states
from ..operators.registry import refresh_units, update_freshness
from ..schemas import LISTINGS, UNITS, column_types
from ..session import checkpoint_root, stage
from ..sources.intake import create_searches, list_searches
from .catalog import query, sql_normalize
from .views import AS_OF, POSTINGS_SQL, SPLIT_DAY, ntz, postings_view, table

# --- the registry of the views: one unit per posting url ------------------------------


def registry_view(spark, sf_dir):
    """(units before refresh, postings, listings): every customer's postings are one unit."""
    listings = postings_view(spark, sf_dir)
    unit_id = F.concat(F.lit("unit-"), F.lpad(F.col("custkey").cast("string"), 20, "0"))
    postings = listings.select(
        unit_id.alias("unit_id"), "listing_id", F.lit(100.0).alias("match_score"), F.col("last_seen_at").alias("created_at")
    )
    types = column_types(UNITS)
    known = listings.groupBy(unit_id.alias("unit_id")).agg(
        F.max("address").alias("address"), F.max("unit").alias("canonical_unit"), F.min("last_seen_at").alias("created_at")
    ).withColumn("canonical_address", normalize_address(F.col("address"))).withColumn("active_state", F.lit("active"))
    have = set(known.columns)
    units = known.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
    return units, postings, listings


def refreshed(spark, sf_dir):
    units, postings, listings = registry_view(spark, sf_dir)
    return refresh_units(units, postings, listings), postings, listings


REGISTRY_SQL = f"""
p AS (SELECT *, 'unit-' || lpad(CAST(custkey AS VARCHAR), 20, '0') AS unit_id FROM ({POSTINGS_SQL})),
newest AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY last_seen_at DESC, listing_id) = 1),
known AS (SELECT unit_id, max(address) AS address, max(unit) AS canonical_unit, min(last_seen_at) AS created_at FROM p GROUP BY 1),
units AS (SELECT k.unit_id, {sql_normalize('k.address')} AS canonical_address, k.canonical_unit, n.neighborhood, n.borough,
                 n.lat, n.lng, n.bedrooms, n.bathrooms, n.rent_gross AS best_rent_gross, n.rent_net AS best_rent_net,
                 n.broker_fee, n.last_seen_at, k.created_at, n.images
          FROM known k JOIN newest n ON n.unit_id = k.unit_id)"""


@query(f"WITH {REGISTRY_SQL} SELECT * EXCLUDE (images) FROM units")
def refresh_best_fields(spark, sf_dir):
    return refreshed(spark, sf_dir)[0].drop("active_state")


_STATE_SQL = f"""CASE WHEN last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'active'
     WHEN last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 'unknown' ELSE 'stale' END"""


@query(f"WITH p AS ({POSTINGS_SQL}) SELECT listing_id AS unit_id, {_STATE_SQL} AS active_state, {_STATE_SQL} <> 'active' AS state_changed FROM p")
def freshness_state(spark, sf_dir):
    units = postings_view(spark, sf_dir, place=False).select(
        F.col("listing_id").alias("unit_id"), "last_seen_at", F.lit("active").alias("active_state")
    )
    return update_freshness(units, ntz(AS_OF)).drop("last_seen_at")


@query(f"""
WITH p AS ({POSTINGS_SQL}), s AS (SELECT {_STATE_SQL} AS active_state FROM p)
SELECT active_state, count(*) FILTER (active_state <> 'active') AS moved, count(*) AS units FROM s GROUP BY 1
""")
def freshness_counts(spark, sf_dir):
    return count_states(freshness_state(spark, sf_dir))


# --- observations over time ------------------------------------------------------------


@query("""
WITH s AS (SELECT event_type, user_id, ts, event_id, value,
                  lag(value) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS old_price FROM events)
SELECT event_type, user_id, ts, event_id, old_price, value AS new_price FROM s WHERE old_price <> value
""")
def price_history(spark, sf_dir):
    return history.price_history(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts", "event_id", "value")


@query("SELECT event_type, user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY 1, 2")
def first_last_seen(spark, sf_dir):
    return history.first_last_seen(table(spark, sf_dir, "events"), ["event_type", "user_id"], "ts")


_MID = "2024-01-16 00:00:00"


@query("""
SELECT event_type, user_id, arg_max(value, (ts, event_id)) AS value, arg_max(props, (ts, event_id)) AS props,
       min(ts) AS first_seen_at, max(ts) AS last_seen_at
FROM events GROUP BY 1, 2
""")
def upsert_latest(spark, sf_dir):
    """Two batches into an empty table: fields of the last sighting, first_seen_at of the first."""
    seen = table(spark, sf_dir, "events").select(
        "event_type", "user_id", "value", "props", "event_id",
        F.col("ts").alias("first_seen_at"), F.col("ts").alias("last_seen_at"),
    )
    empty = seen.drop("event_id").limit(0)

    def merge(existing, batch):
        return keyed_upsert(
            existing, batch, ("event_type", "user_id"), ("last_seen_at", "event_id"),
            update=("value", "props", "last_seen_at"), insert_only=("first_seen_at",),
        )

    older = seen.filter(F.col("last_seen_at") < ntz(_MID))
    newer = seen.filter(F.col("last_seen_at") >= ntz(_MID))
    return merge(stage(merge(empty, older), "first"), newer)


@query(f"""
WITH p AS ({POSTINGS_SQL}),
olds AS (SELECT * FROM p WHERE last_seen_at < TIMESTAMP '{SPLIT_DAY}'
         QUALIFY row_number() OVER (PARTITION BY source, source_url ORDER BY last_seen_at DESC, listing_id DESC) = 1),
news AS (SELECT * FROM p WHERE last_seen_at >= TIMESTAMP '{SPLIT_DAY}'
         QUALIFY row_number() OVER (PARTITION BY source, source_url ORDER BY last_seen_at DESC, listing_id DESC) = 1),
firsts AS (SELECT source, source_url, min(last_seen_at) AS first_seen_at FROM p GROUP BY 1, 2)
SELECT f.source, f.source_url, f.first_seen_at, coalesce(n.last_seen_at, o.last_seen_at) AS last_seen_at,
       CASE WHEN n.source IS NOT NULL THEN n.title ELSE o.title END AS title,
       CASE WHEN n.source IS NOT NULL THEN n.unit ELSE o.unit END AS unit,
       CASE WHEN n.source IS NOT NULL THEN n.rent_net ELSE o.rent_net END AS rent_net,
       CASE WHEN n.source IS NOT NULL THEN n.broker_fee ELSE o.broker_fee END AS broker_fee,
       o.lat, o.lng
FROM firsts f LEFT JOIN olds o ON o.source = f.source AND o.source_url = f.source_url
LEFT JOIN news n ON n.source = f.source AND n.source_url = f.source_url
""")
def upsert_partial(spark, sf_dir):
    """A full batch, then one that leaves the columns alone which a folder import does not fill."""
    p = postings_view(spark, sf_dir, place=False)
    types = column_types(LISTINGS)
    given = set(p.columns) - {"last_seen_at", "listing_id"}
    seen = p.select(
        "source", "source_url", F.col("listing_id").cast("bigint").alias("seq"), F.col("last_seen_at").alias("seen_at"),
        *[
            (F.col(c) if c in given else F.lit(None)).cast(t).alias(c)
            for c, t in types.items()
            if c not in ("source", "source_url", "listing_id", "first_seen_at", "last_seen_at")
        ],
    )
    day = ntz(SPLIT_DAY)
    empty = spark.createDataFrame([], LISTINGS)
    table_ = stage(upsert_listings(empty, seen.filter(F.col("seen_at") < day)), "first")
    table_ = upsert_listings(table_, seen.filter(F.col("seen_at") >= day), columns=FOLDER_IMPORT_COLUMNS)
    return table_.select(
        "source", "source_url", "first_seen_at", "last_seen_at", "title", "unit", "rent_net", "broker_fee", "lat", "lng"
    )


@query(f"""
WITH p AS ({POSTINGS_SQL}),
l AS (SELECT 'unit-' || custkey AS unit_id, source AS listing_id, orderkey, last_seen_at FROM p)
SELECT unit_id, listing_id, CAST(arg_max(60 + orderkey % 5 * 10, (last_seen_at, orderkey)) AS DOUBLE) AS match_score,
       min(last_seen_at) AS created_at
FROM l GROUP BY 1, 2
""")
def upsert_link_scores(spark, sf_dir):
    links = postings_view(spark, sf_dir, place=False).select(
        F.concat(F.lit("unit-"), F.col("custkey").cast("string")).alias("unit_id"),
        F.col("source").alias("listing_id"),
        (60 + F.col("orderkey") % 5 * 10).cast("double").alias("match_score"),
        F.col("last_seen_at").alias("created_at"),
        F.col("orderkey").alias("seq"),
    )
    day = ntz(SPLIT_DAY)
    first = stage(upsert_links(links.drop("seq").limit(0), links.filter(F.col("created_at") < day)), "first")
    return upsert_links(first, links.filter(F.col("created_at") >= day))


# --- search ----------------------------------------------------------------------------

_SEARCH = {"max_rent": 4000, "min_beds": 1.0}
_WHERE = "best_rent_gross <= 4000 AND bedrooms >= 1"
_FIELDS = """u.unit_id, canonical_address AS address, canonical_unit AS unit, neighborhood, borough, bedrooms, bathrooms,
       best_rent_gross AS rent_gross, best_rent_net AS rent_net, broker_fee, last_seen_at, c.n AS sources_count,
       nullif(images[1], '') AS image_url"""
_COUNTS = ", c AS (SELECT unit_id, count(*) AS n FROM p GROUP BY 1)"


@query(f"""
WITH {REGISTRY_SQL}{_COUNTS}
SELECT {_FIELDS} FROM units u JOIN c ON c.unit_id = u.unit_id WHERE {_WHERE}
ORDER BY last_seen_at DESC, u.unit_id LIMIT 20 OFFSET 20
""")
def unit_search(spark, sf_dir):
    return search.search_units(*refreshed(spark, sf_dir), page=2, **_SEARCH).drop("active_state")


@query(f"""
WITH {REGISTRY_SQL}{_COUNTS}
SELECT {_FIELDS} FROM units u JOIN c ON c.unit_id = u.unit_id WHERE {_WHERE} AND borough = 'ASIA'
ORDER BY last_seen_at DESC, u.unit_id LIMIT 20
""")
def unit_search_clustered(spark, sf_dir):
    """A search of a table that was clustered for searches: only row groups of the borough and of such rents are read."""
    units, postings, listings = refreshed(spark, sf_dir)
    stored = search.write_search_table(units, f"{checkpoint_root(spark)}/search-{uuid4().hex}")
    return search.search_units(stored, postings, listings, borough="ASIA", **_SEARCH).drop("active_state")


@query(f"""
WITH {REGISTRY_SQL}{_COUNTS}
SELECT {_FIELDS} FROM units u JOIN c ON c.unit_id = u.unit_id WHERE {_WHERE} AND borough = 'EUROPE'
ORDER BY broker_fee NULLS LAST, last_seen_at DESC, u.unit_id LIMIT 100
""")
def unit_search_nofee(spark, sf_dir):
    found = search.search_units(*refreshed(spark, sf_dir), no_fee_preferred=True, page=0, limit=101, borough="EUROPE", **_SEARCH)
    return found.drop("active_state")


@query(f"""
WITH {REGISTRY_SQL}
SELECT CAST(2 AS BIGINT) AS page, CAST(100 AS BIGINT) AS "limit", count(*) AS total,
       CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages
FROM units WHERE {_WHERE} AND neighborhood = 'NATION_3'
""")
def search_page_meta(spark, sf_dir):
    return search.search_meta(refreshed(spark, sf_dir)[0], page=2, limit=500, neighborhood="NATION_3", **_SEARCH)


@query(f"""
WITH {REGISTRY_SQL}
SELECT count(*) AS units, count(*) FILTER ({_WHERE}) AS matching, (SELECT count(DISTINCT unit_id) FROM p) AS posted FROM units
""")
def registry_counts(spark, sf_dir):
    units, postings, _ = refreshed(spark, sf_dir)
    marked = units.select(
        "unit_id", ((F.col("best_rent_gross") <= 4000) & (F.col("bedrooms") >= 1)).alias("hit")
    ).join(postings.select("unit_id").distinct().withColumn("posted", F.lit(True)), "unit_id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("units"), F.count_if("hit").alias("matching"), F.count_if("posted").alias("posted")
    )


@query(f"WITH {REGISTRY_SQL} SELECT unit_id, nullif(images[1], '') AS image_url FROM units")
def newest_image(spark, sf_dir):
    _, postings, listings = registry_view(spark, sf_dir)
    return search.newest_image(postings, listings)


# --- saved searches: customers as people looking ---------------------------------------


def searches_view(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    place = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey", "n_name", "r_name")
    return c.join(place, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.lpad(key.cast("string"), 20, "0").alias("search_id"),
        F.when(key % 17 != 0, F.col("c_name")).alias("name"),
        F.when(key % 19 == 0, F.lit("")).when(key % 5 == 0, F.repeat(F.col("c_mktsegment"), 30)).otherwise(
            F.concat(F.lit("near "), F.lower("c_mktsegment"))
        ).alias("prompt"),
        F.when(key % 3 != 0, F.floor(F.col("c_acctbal") / 2).cast("int") + 1000).alias("max_rent"),
        F.when(key % 4 != 0, (key % 3).cast("double")).alias("min_beds"),
        F.when(key % 2 == 0, F.col("r_name")).alias("borough"),
        F.when(key % 8 == 0, F.col("n_name")).alias("neighborhood"),
        F.when(key % 7 != 0, key % 2 == 0).alias("no_fee_preferred"),
        (key % 6 != 0).alias("is_active"),
        F.date_add(F.lit("2001-01-01").cast("date"), (key % 200).cast("int")).cast("timestamp_ntz").alias("created_at"),
    )


SEARCHES_SQL = """
SELECT lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS search_id,
       CASE WHEN c_custkey % 17 <> 0 THEN c_name END AS name,
       CASE WHEN c_custkey % 19 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN repeat(c_mktsegment, 30)
            ELSE 'near ' || lower(c_mktsegment) END AS prompt,
       CASE WHEN c_custkey % 3 <> 0 THEN CAST(floor(c_acctbal / 2) AS INTEGER) + 1000 END AS max_rent,
       CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 3 AS DOUBLE) END AS min_beds,
       CASE WHEN c_custkey % 2 = 0 THEN r_name END AS borough,
       CASE WHEN c_custkey % 8 = 0 THEN n_name END AS neighborhood,
       CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 2 = 0 END AS no_fee_preferred,
       c_custkey % 6 <> 0 AS is_active,
       TIMESTAMP '2001-01-01' + to_days(CAST(c_custkey % 200 AS INTEGER)) AS created_at
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey
"""

_HITS_SQL = f"""
WITH {REGISTRY_SQL}, s AS ({SEARCHES_SQL}),
hits AS (SELECT s.search_id, u.unit_id, u.last_seen_at,
                CASE WHEN s.no_fee_preferred THEN coalesce(CAST(u.broker_fee AS INT), 2) ELSE 0 END AS fee FROM s JOIN units u
         ON (s.max_rent IS NULL OR u.best_rent_gross <= s.max_rent) AND (s.min_beds IS NULL OR u.bedrooms >= s.min_beds)
         AND (s.borough IS NULL OR u.borough = s.borough) AND (s.neighborhood IS NULL OR u.neighborhood = s.neighborhood)
         WHERE s.is_active)"""


@query(f"""{_HITS_SQL},
t AS (SELECT search_id, count(*) AS total FROM hits GROUP BY 1),
n AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY search_id ORDER BY fee, last_seen_at DESC, unit_id) = 1)
SELECT s.search_id, coalesce(t.total, 0) AS total, n.unit_id AS first_unit_id, n.last_seen_at AS first_hit_seen_at
FROM s LEFT JOIN t ON t.search_id = s.search_id LEFT JOIN n ON n.search_id = s.search_id WHERE s.is_active
""")
def saved_search_matches(spark, sf_dir):
    units = stage(refreshed(spark, sf_dir)[0], "units")
    return search.match_saved_searches(searches_view(spark, sf_dir), units)


@query(f"""{_HITS_SQL.replace("u.last_seen_at,", "u.last_seen_at, u.broker_fee,")},
t AS (SELECT search_id, count(*) AS total FROM hits GROUP BY 1),
n AS (SELECT search_id, unit_id, last_seen_at, broker_fee,
             CAST(row_number() OVER (PARTITION BY search_id ORDER BY fee, last_seen_at DESC, unit_id) AS BIGINT) AS place FROM hits)
SELECT s.search_id, coalesce(t.total, 0) AS total, n.place, n.unit_id, n.last_seen_at, n.broker_fee
FROM s LEFT JOIN t ON t.search_id = s.search_id LEFT JOIN n ON n.search_id = s.search_id AND n.place <= 20 WHERE s.is_active
""")
def saved_search_pages(spark, sf_dir):
    """The first page of every active saved search."""
    units = stage(refreshed(spark, sf_dir)[0], "units")
    pages = search.saved_search_pages(searches_view(spark, sf_dir), units)
    return pages.withColumn("place", F.col("place").cast("bigint"))


@query(f"""
WITH s AS ({SEARCHES_SQL})
SELECT search_id, name, prompt, max_rent, true AS is_active, created_at FROM s
WHERE coalesce(name, '') <> '' AND coalesce(prompt, '') <> ''
""")
def saved_search_list(spark, sf_dir):
    submitted = searches_view(spark, sf_dir)
    made = create_searches(submitted.limit(0), submitted)
    return list_searches(made).select("search_id", "name", "prompt", "max_rent", "is_active", "created_at")


# --- detail ----------------------------------------------------------------------------


@query("""
SELECT 'user-' || user_id AS unit_id, CAST(event_id AS VARCHAR) AS listing_id, event_type AS kind, ts AS created_at,
       CAST(row_number() OVER w AS BIGINT) AS ord
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR), event_type)
QUALIFY row_number() OVER w <= 50
""")
def unit_detail_top_changes(spark, sf_dir):
    changes = table(spark, sf_dir, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("unit_id"),
        F.col("event_id").cast("string").alias("listing_id"),
        F.col("event_type").alias("kind"),
        F.col("ts").alias("created_at"),
    )
    shown = detail.unit_changes(changes.select("unit_id").distinct(), changes)
    return shown.withColumn("ord", F.col("ord").cast("bigint"))


@query(f"""
WITH {REGISTRY_SQL}
SELECT u.unit_id, u.canonical_address, p.listing_id, CAST(100 AS DOUBLE) AS match_score, p.source AS posting_source,
       p.rent_gross AS posting_rent_gross, p.broker_fee AS posting_broker_fee, p.last_seen_at AS posting_last_seen_at
FROM units u LEFT JOIN p ON p.unit_id = u.unit_id
""")
def unit_detail_postings(spark, sf_dir):
    units, postings, listings = refreshed(spark, sf_dir)
    rows = detail.unit_postings(units, postings, listings)
    return rows.select(
        "unit_id", "canonical_address", "listing_id", "match_score", "posting_source", "posting_rent_gross",
        "posting_broker_fee", "posting_last_seen_at",
    )


@query(f"""
WITH {REGISTRY_SQL},
i AS (SELECT unit_id, last_seen_at, listing_id, unnest(images) AS image, generate_subscripts(images, 1) AS pos FROM p),
f AS (SELECT unit_id, image, row_number() OVER (PARTITION BY unit_id, image ORDER BY last_seen_at DESC, listing_id, pos) AS rn,
             last_seen_at, listing_id, pos FROM i),
g AS (SELECT unit_id, image, row_number() OVER (PARTITION BY unit_id ORDER BY last_seen_at DESC, listing_id, pos) AS ord
      FROM f WHERE rn = 1)
SELECT unit_id, string_agg(image, ' ' ORDER BY ord) AS gallery FROM g WHERE ord <= 10 GROUP BY 1
""")
def unit_gallery(spark, sf_dir):
    _, postings, listings = registry_view(spark, sf_dir)
    return detail.unit_gallery(postings, listings).select("unit_id", F.array_join("gallery", " ").alias("gallery"))
