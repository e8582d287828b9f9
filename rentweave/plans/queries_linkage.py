"""Queries over candidate search, scoring and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linkage
from ..operators.ranking import dense_position, top_rows
from ..operators.registry import append_changes, attach_changes, unlinked, update_freshness
from ..operators.search import filter_units
from ..session import checkpoint_root, stage
from ..schemas import POSTINGS, UNITS
from .catalog import query, sql_cell, sql_normalize
from .run import link_arrivals, link_new
from .views import AS_OF, POSTINGS_SQL, SPLIT_DAY, ntz, postings_view


def split_view(spark, sf_dir):
    """Postings of the run, and the known ones."""
    p = postings_view(spark, sf_dir, place=False)
    day = ntz(SPLIT_DAY)
    return p.filter(F.col("last_seen_at") >= day), p.filter(F.col("last_seen_at") < day)


def known_units(old):
    """Each known posting as a unit of its own."""
    return old.select(
        F.col("listing_id").alias("unit_id"),
        linkage.normalize_address(F.col("address")).alias("canonical_address"),
        F.col("unit").alias("canonical_unit"),
        "neighborhood", "borough", "lat", "lng", "bedrooms", "bathrooms",
        F.col("rent_gross").alias("best_rent_gross"),
        F.col("rent_net").alias("best_rent_net"),
        "broker_fee",
        F.lit("active").alias("active_state"),
        "last_seen_at",
        F.col("last_seen_at").alias("created_at"),
    )


IDENTITY_SQL = f"""
p AS ({POSTINGS_SQL}),
keyed AS (SELECT *, nullif({sql_normalize('address')}, '') AS addr, nullif(lower(unit), '') AS unit_key,
                 CASE WHEN lng IS NOT NULL THEN {sql_cell('lat')} END AS cell_lat,
                 CASE WHEN lat IS NOT NULL THEN {sql_cell('lng')} END AS cell_lng FROM p),
old AS (SELECT * FROM keyed WHERE last_seen_at < TIMESTAMP '{SPLIT_DAY}'),
new AS (SELECT * FROM keyed WHERE last_seen_at >= TIMESTAMP '{SPLIT_DAY}')"""

SCORE_SQL = """
(CASE WHEN n.addr = o.addr THEN 40 ELSE 0 END + CASE WHEN n.unit_key = o.unit_key THEN 30 ELSE 0 END
 + CASE WHEN n.cell_lat = o.cell_lat AND n.cell_lng = o.cell_lng THEN 20 ELSE 0 END
 + CASE WHEN abs(n.bedrooms - o.bedrooms) <= 0.5 AND coalesce(abs(n.bathrooms - o.bathrooms) <= 0.5, true)
        THEN 10 ELSE 0 END)"""

# The original predicate: same address, or within one cell width of the cell's centre.
_NEAR_SQL = """(o.lat BETWEEN n.cell_lat / 1000 - 0.001 AND n.cell_lat / 1000 + 0.001
 AND o.lng BETWEEN n.cell_lng / 1000 - 0.001 AND n.cell_lng / 1000 + 0.001)"""

PAIRS_SQL = f"""
pairs AS (SELECT n.listing_id, o.listing_id AS unit_id, o.last_seen_at AS created_at, {SCORE_SQL} AS score,
                 coalesce(n.addr = o.addr, false) AS same_address, coalesce({_NEAR_SQL}, false) AS near_cell
          FROM new n JOIN old o ON n.addr = o.addr OR {_NEAR_SQL})"""

BEST_SQL = """
best AS (SELECT listing_id, unit_id, score FROM pairs WHERE score >= 60
         QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, created_at, unit_id) = 1)"""


@query(f"""
WITH {IDENTITY_SQL}, {PAIRS_SQL},
c AS (SELECT listing_id, count(*) FILTER (same_address) AS sa, count(*) FILTER (near_cell) AS nc, count(*) AS n
      FROM pairs GROUP BY 1)
SELECT new.listing_id, coalesce(sa, 0) AS same_address, coalesce(nc, 0) AS near_cell, coalesce(n, 0) AS candidates
FROM new LEFT JOIN c ON c.listing_id = new.listing_id
""")
def candidate_counts(spark, sf_dir):
    new, old = split_view(spark, sf_dir)
    return linkage.candidate_counts(
        linkage.posting_identity(new), linkage.unit_identity(known_units(old)), "listing_id"
    )


@query(f"""
WITH {IDENTITY_SQL}, {PAIRS_SQL}
SELECT listing_id, count(*) FILTER (score = 100) AS n100, count(*) FILTER (score = 90) AS n90,
       count(*) FILTER (score = 80) AS n80, count(*) FILTER (score = 70) AS n70, count(*) FILTER (score = 60) AS n60
FROM pairs WHERE score >= 60 GROUP BY 1
""")
def match_scores(spark, sf_dir):
    new, old = split_view(spark, sf_dir)
    return linkage.score_histogram(
        linkage.posting_identity(new), linkage.unit_identity(known_units(old)), "listing_id"
    )


def _best(new, units):
    known = linkage.unit_identity(units).withColumn("unit_ord", F.struct("created_at", "unit_id"))
    best = linkage.best_match(linkage.posting_identity(new), known, "listing_id", "unit_ord")
    return best.select("listing_id", F.col("unit_ord.unit_id").alias("unit_id"), F.col("score").cast("bigint").alias("score"))


@query(f"WITH {IDENTITY_SQL}, {PAIRS_SQL}, {BEST_SQL} SELECT listing_id, unit_id, CAST(score AS BIGINT) AS score FROM best")
def best_candidate(spark, sf_dir):
    new, old = split_view(spark, sf_dir)
    return _best(new, known_units(old))


@query(f"""
WITH {IDENTITY_SQL}, {PAIRS_SQL}, {BEST_SQL}
SELECT listing_id, unit_id, CAST(score AS BIGINT) AS scored FROM best
""")
def rescored_pairs(spark, sf_dir):
    """The pair score recomputed from both records of each chosen pair."""
    new, old = split_view(spark, sf_dir)
    units = known_units(old)
    side = lambda df, key, p: df.select(key, *[F.col(c).alias(p + c) for c in linkage.IDENTITY])
    pairs = (
        _best(new, units)
        .join(side(linkage.posting_identity(new), "listing_id", "a_"), "listing_id")
        .join(side(linkage.unit_identity(units), "unit_id", "b_"), "unit_id")
    )
    return pairs.select("listing_id", "unit_id", linkage.match_score("a_", "b_").cast("bigint").alias("scored"))


_CHANGES_SQL = """
pairs_seen AS (SELECT b.unit_id, b.listing_id, n.rent_gross AS new_rent, o.rent_gross AS old_rent,
                      n.broker_fee AS new_fee, o.broker_fee AS old_fee
               FROM best b JOIN new n ON n.listing_id = b.listing_id JOIN old o ON o.listing_id = b.unit_id),
changes AS (
SELECT unit_id, listing_id, 'price_change' AS kind, NULL AS field, CAST(old_rent AS VARCHAR) AS old_value,
       CAST(new_rent AS VARCHAR) AS new_value,
       '{"oldRentGross":' || old_rent || ',"newRentGross":' || new_rent || '}' AS payload
FROM pairs_seen WHERE old_rent <> new_rent
UNION ALL
SELECT unit_id, listing_id, 'field_change', 'brokerFee', CAST(old_fee AS VARCHAR), CAST(new_fee AS VARCHAR),
       '{"field":"brokerFee","oldValue":' || CAST(old_fee AS VARCHAR) || ',"newValue":' || CAST(new_fee AS VARCHAR) || '}'
FROM pairs_seen WHERE old_fee <> new_fee)"""


def _changes(spark, sf_dir):
    new, old = split_view(spark, sf_dir)
    units = known_units(old)
    return attach_changes(_best(new, units), units, new, ntz(AS_OF))


@query(f"WITH {IDENTITY_SQL}, {PAIRS_SQL}, {BEST_SQL}, {_CHANGES_SQL} SELECT * FROM changes")
def attach_changes_log(spark, sf_dir):
    return _changes(spark, sf_dir).drop("created_at")


@query(f"""
WITH {IDENTITY_SQL}, {PAIRS_SQL}, {BEST_SQL}, {_CHANGES_SQL}
SELECT kind, unit_id, listing_id, CAST(2 AS BIGINT) AS records FROM changes
""")
def change_append(spark, sf_dir):
    """Two runs appended to one log, the second one twice; the log keeps one copy of each."""
    from uuid import uuid4

    path = f"{checkpoint_root(spark)}/change-log-{uuid4().hex}"
    changes = stage(_changes(spark, sf_dir), "changes")
    for run in ("first", "second", "second"):
        append_changes(changes, path, run)
    log = spark.read.parquet(path)
    return log.groupBy("kind", "unit_id", "listing_id").agg(F.count(F.lit(1)).alias("records"))


@query(f"""
WITH {IDENTITY_SQL}
SELECT listing_id, last_seen_at, row_number() OVER (ORDER BY last_seen_at DESC, listing_id) AS position FROM new
""")
def unlinked_ranked(spark, sf_dir):
    _, old = split_view(spark, sf_dir)
    postings = old.select(F.col("listing_id").alias("unit_id"), "listing_id")
    todo = unlinked(postings_view(spark, sf_dir, place=False), postings).select("listing_id", "last_seen_at")
    return dense_position(todo, linkage.newest_first(), "position")


# The sequential visit as a recursion over rounds on the explicit pair graph.
LINK_SQL = f"""
{IDENTITY_SQL.split("," + chr(10) + "old AS")[0]},
v AS MATERIALIZED (SELECT listing_id, addr, unit_key, cell_lat, cell_lng, bedrooms, bathrooms,
                          row_number() OVER (ORDER BY last_seen_at DESC, listing_id) AS pos FROM keyed),
e AS MATERIALIZED (
  SELECT n.pos AS later, o.pos AS earlier, {SCORE_SQL} AS score
  FROM v n JOIN v o ON o.pos < n.pos AND n.addr = o.addr AND n.unit_key = o.unit_key
  UNION
  SELECT n.pos, o.pos, {SCORE_SQL} FROM v n JOIN v o
    ON o.pos < n.pos AND n.addr = o.addr AND n.cell_lat = o.cell_lat AND n.cell_lng = o.cell_lng
  UNION
  SELECT n.pos, o.pos, {SCORE_SQL} FROM v n JOIN v o
    ON o.pos < n.pos AND n.unit_key = o.unit_key AND n.cell_lat = o.cell_lat AND n.cell_lng = o.cell_lng
   AND {SCORE_SQL} >= 60),
state AS (
  SELECT 0 AS round, pos, 0 AS mark FROM v
  UNION ALL
  SELECT s.round + 1, s.pos,
         CASE WHEN s.mark <> 0 THEN s.mark
              WHEN coalesce(b.founder, false) THEN 2
              WHEN NOT coalesce(b.open, false) THEN 1 ELSE 0 END
  FROM state s LEFT JOIN (
    SELECT e.later, bool_or(t.mark = 1) AS founder, bool_or(t.mark = 0) AS open
    FROM e JOIN state t ON t.pos = e.earlier GROUP BY 1) b ON b.later = s.pos
  WHERE EXISTS (SELECT 1 FROM state u WHERE u.mark = 0)),
final AS (SELECT pos, mark FROM state WHERE round = (SELECT max(round) FROM state)),
picked AS (SELECT e.later AS pos, e.earlier AS founder, e.score FROM e JOIN final f ON f.pos = e.earlier AND f.mark = 1
           QUALIFY row_number() OVER (PARTITION BY e.later ORDER BY e.score DESC, e.earlier) = 1),
linked AS (
  SELECT v.listing_id, w.listing_id AS founder, sha256('unit' || chr(1) || w.listing_id) AS unit_id,
         CASE WHEN f.mark = 1 THEN CAST(100 AS DOUBLE) ELSE CAST(picked.score AS DOUBLE) END AS match_score,
         f.mark = 1 AS founds_unit
  FROM v JOIN final f ON f.pos = v.pos LEFT JOIN picked ON picked.pos = v.pos AND f.mark = 2
  JOIN v w ON w.pos = CASE WHEN f.mark = 1 THEN v.pos ELSE picked.founder END)"""


@query(f"WITH RECURSIVE {LINK_SQL} SELECT listing_id, unit_id, match_score, founds_unit FROM linked")
def link_units(spark, sf_dir):
    return linkage.link_postings(postings_view(spark, sf_dir, place=False), spark.createDataFrame([], UNITS)).links


@query(f"""
WITH RECURSIVE {LINK_SQL},
newest AS (SELECT l.unit_id, l.founder, k.borough, k.neighborhood, k.bedrooms, k.rent_gross, k.broker_fee, k.last_seen_at
           FROM linked l JOIN keyed k ON k.listing_id = l.listing_id
           QUALIFY row_number() OVER (PARTITION BY l.unit_id ORDER BY k.last_seen_at DESC, k.listing_id) = 1)
SELECT n.borough, CAST(row_number() OVER w AS BIGINT) AS place, n.unit_id, f.addr AS address, n.neighborhood, n.bedrooms,
       n.rent_gross, n.last_seen_at,
       CASE WHEN n.last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'active' ELSE 'unknown' END AS active_state
FROM newest n JOIN keyed f ON f.listing_id = n.founder
WHERE n.broker_fee = false AND n.bedrooms >= 2 AND n.last_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY
WINDOW w AS (PARTITION BY n.borough ORDER BY n.rent_gross, n.unit_id) QUALIFY row_number() OVER w <= 5
""")
def cheapest_no_fee_units(spark, sf_dir):
    """Flagship: cheapest no-fee units with two bedrooms or more, per borough, seen in the last 14 days."""
    listings = postings_view(spark, sf_dir)
    none = spark.createDataFrame([], UNITS), spark.createDataFrame([], POSTINGS)
    run = link_new(listings, *none, ntz(AS_OF))
    units = update_freshness(run.units, ntz(AS_OF)).filter(F.col("active_state") != "stale")
    found = filter_units(units, min_beds=2.0).filter(~F.col("broker_fee"))
    best = top_rows(found, ["borough"], [F.col("best_rent_gross"), F.col("unit_id")], 5, "place")
    return best.select(
        "borough", F.col("place").cast("bigint").alias("place"), "unit_id", F.col("canonical_address").alias("address"),
        "neighborhood", "bedrooms", F.col("best_rent_gross").alias("rent_gross"), "last_seen_at", "active_state",
    )


# Arrivals at known units: mark 1 founds, 2 attaches, 3 has a unit already and never founds.
_RELINK_SQL = f"""
{IDENTITY_SQL},
v AS MATERIALIZED (SELECT listing_id, addr, unit_key, cell_lat, cell_lng, bedrooms, bathrooms, coalesce(broker_fee, false) AS kept,
                          row_number() OVER (ORDER BY last_seen_at, listing_id) AS pos FROM new),
e AS MATERIALIZED (
  SELECT n.pos AS later, o.pos AS earlier, {SCORE_SQL} AS score FROM v n JOIN v o
    ON o.pos < n.pos AND n.addr = o.addr AND {SCORE_SQL} >= 60
  UNION
  SELECT n.pos, o.pos, {SCORE_SQL} FROM v n JOIN v o
    ON o.pos < n.pos AND n.unit_key = o.unit_key AND n.cell_lat = o.cell_lat AND n.cell_lng = o.cell_lng
   AND {SCORE_SQL} >= 60),
{PAIRS_SQL.strip()}, {BEST_SQL.strip()},
state AS (
  SELECT 0 AS round, v.pos, CASE WHEN best.listing_id IS NOT NULL THEN 2 WHEN v.kept THEN 3 ELSE 0 END AS mark
  FROM v LEFT JOIN best ON best.listing_id = v.listing_id
  UNION ALL
  SELECT s.round + 1, s.pos,
         CASE WHEN s.mark <> 0 THEN s.mark WHEN coalesce(b.founder, false) THEN 2 WHEN NOT coalesce(b.open, false) THEN 1 ELSE 0 END
  FROM state s LEFT JOIN (
    SELECT e.later, bool_or(t.mark = 1) AS founder, bool_or(t.mark = 0) AS open
    FROM e JOIN state t ON t.pos = e.earlier GROUP BY 1) b ON b.later = s.pos
  WHERE EXISTS (SELECT 1 FROM state u WHERE u.mark = 0)),
final AS (SELECT pos, mark FROM state WHERE round = (SELECT max(round) FROM state)),
options AS (
  SELECT v.listing_id, best.unit_id, best.score, 0 AS place FROM v JOIN best ON best.listing_id = v.listing_id
  UNION ALL
  SELECT v.listing_id, sha256('unit' || chr(1) || w.listing_id), e.score, e.earlier
  FROM e JOIN final f ON f.pos = e.earlier AND f.mark = 1 JOIN v ON v.pos = e.later JOIN v w ON w.pos = e.earlier),
attached AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY score DESC, place) = 1)"""


def _known_again(new):
    """Units that the postings with a fee have from before."""
    again = new.filter("broker_fee").select(
        F.concat(F.lit("kept-"), F.col("custkey").cast("string")).alias("unit_id"), "listing_id",
        F.lit(100.0).alias("match_score"), F.col("last_seen_at").alias("created_at"),
    )
    return again.select(*[c.split()[0] for c in POSTINGS.split(", ")])


@query(f"""
WITH RECURSIVE {_RELINK_SQL}
SELECT 'kept-' || custkey AS unit_id, listing_id, CAST(100 AS DOUBLE) AS match_score FROM new WHERE broker_fee
UNION ALL
SELECT sha256('unit' || chr(1) || v.listing_id), v.listing_id, 100 FROM v JOIN final f ON f.pos = v.pos AND f.mark = 1
UNION ALL
SELECT a.unit_id, a.listing_id, a.score FROM attached a JOIN v ON v.listing_id = a.listing_id
JOIN final f ON f.pos = v.pos AND f.mark <> 1
""")
def relink_batch(spark, sf_dir):
    """Newer postings arrive one by one at the units of the older ones; those with a fee are linked already."""
    new, old = split_view(spark, sf_dir)
    run = link_arrivals(new, known_units(old), _known_again(new), ntz(AS_OF))
    return run.postings.select("unit_id", "listing_id", "match_score")


# No posting is spared from founding; one that has a unit founds another, named by its arrival.
_REFOUND_SQL = _RELINK_SQL.replace("coalesce(broker_fee, false) AS kept", "false AS kept")
_REFOUNDED = """CASE WHEN k.broker_fee THEN sha256('unit' || chr(1) || k.listing_id || chr(1) || strftime(k.last_seen_at, '%Y-%m-%d %H:%M:%S.%f'))
     ELSE sha256('unit' || chr(1) || k.listing_id) END"""
_REFOUND_SQL = _REFOUND_SQL.replace(
    "SELECT v.listing_id, sha256('unit' || chr(1) || w.listing_id), e.score, e.earlier", f"SELECT v.listing_id, {_REFOUNDED}, e.score, e.earlier"
).replace("JOIN v w ON w.pos = e.earlier)", "JOIN v w ON w.pos = e.earlier JOIN new k ON k.listing_id = w.listing_id)")


@query(f"""
WITH RECURSIVE {_REFOUND_SQL}
SELECT 'kept-' || custkey AS unit_id, listing_id, CAST(100 AS DOUBLE) AS match_score FROM new WHERE broker_fee
UNION ALL
SELECT {_REFOUNDED}, v.listing_id, 100 FROM v JOIN final f ON f.pos = v.pos AND f.mark = 1 JOIN new k ON k.listing_id = v.listing_id
UNION ALL
SELECT a.unit_id, a.listing_id, a.score FROM attached a JOIN v ON v.listing_id = a.listing_id
JOIN final f ON f.pos = v.pos AND f.mark <> 1
""")
def relink_strict(spark, sf_dir):
    """The same arrivals; those that have a unit but match none found a second one."""
    new, old = split_view(spark, sf_dir)
    run = link_arrivals(new, known_units(old), _known_again(new), ntz(AS_OF), refound=True)
    return run.postings.select("unit_id", "listing_id", "match_score")
