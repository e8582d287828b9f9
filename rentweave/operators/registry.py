"""Units of the registry: founding, changes, best-known fields, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_address
from .ranking import age

# Days until a unit is no longer active / is stale; its states.
ACTIVE_DAYS, UNKNOWN_DAYS = 7, 14
STATES = ("active", "unknown", "stale")


def unlinked(listings: DataFrame, postings: DataFrame) -> DataFrame:
    """Postings without a unit; before the first links that is all of them, without a join."""
    if postings.isEmpty():
        return listings
    return listings.join(postings.select("listing_id"), "listing_id", "left_anti")


#: Columns of postings that linking, founding and change records read.
LINKED_BY = (
    "listing_id", "address", "unit", "neighborhood", "borough", "lat", "lng", "bedrooms", "bathrooms",
    "rent_gross", "rent_net", "broker_fee", "last_seen_at",
)


def found_units(listings: DataFrame, links: DataFrame, as_of: Column, strict: bool = True) -> DataFrame:
    """One unit per founding posting, with that posting's fields."""
    founders = links.filter("founds_unit").select("listing_id", "unit_id")
    return listings.join(founders, "listing_id").select(
        "unit_id",
        normalize_address(F.nullif("address", F.lit("")), strict).alias("canonical_address"),
        F.col("unit").alias("canonical_unit"),
        "neighborhood", "borough", "lat", "lng", "bedrooms", "bathrooms",
        F.col("rent_gross").alias("best_rent_gross"),
        F.col("rent_net").alias("best_rent_net"),
        "broker_fee",
        F.lit("active").alias("active_state"),
        "last_seen_at",
        as_of.alias("created_at"),
    )


def attach_changes(attached: DataFrame, units: DataFrame, listings: DataFrame, as_of: Column) -> DataFrame:
    """Rent and fee differences between newly attached postings and their units.

    ``units`` are the units as of the start of the run plus the founded ones. Both
    sides have to be known for a difference to count.
    """
    pairs = (
        attached.select("unit_id", "listing_id")
        .join(listings.select("listing_id", "rent_gross", F.col("broker_fee").alias("new_fee")), "listing_id")
        .join(units.select("unit_id", "best_rent_gross", F.col("broker_fee").alias("old_fee")), "unit_id")
    )
    rent = F.when(
        F.col("rent_gross") != F.col("best_rent_gross"),
        F.struct(
            F.lit("price_change").alias("kind"),
            F.lit(None).cast("string").alias("field"),
            F.col("best_rent_gross").cast("string").alias("old_value"),
            F.col("rent_gross").cast("string").alias("new_value"),
            F.to_json(
                F.struct(
                    F.col("best_rent_gross").alias("oldRentGross"), F.col("rent_gross").alias("newRentGross")
                )
            ).alias("payload"),
        ),
    )
    fee = F.when(
        F.col("new_fee") != F.col("old_fee"),
        F.struct(
            F.lit("field_change").alias("kind"),
            F.lit("brokerFee").alias("field"),
            F.col("old_fee").cast("string").alias("old_value"),
            F.col("new_fee").cast("string").alias("new_value"),
            F.to_json(
                F.struct(
                    F.lit("brokerFee").alias("field"),
                    F.col("old_fee").alias("oldValue"),
                    F.col("new_fee").alias("newValue"),
                )
            ).alias("payload"),
        ),
    )
    return pairs.select(
        "unit_id", "listing_id", F.explode(F.filter(F.array(rent, fee), lambda c: c.isNotNull())).alias("c")
    ).select("unit_id", "listing_id", "c.*", as_of.alias("created_at"))


def append_changes(changes: DataFrame, path: str, run_id: str) -> None:
    """Add a run's change records to the log, in a folder per run date and run.

    Writing the same run again replaces its folders and no others, so a repeated run leaves one copy.
    """
    dated = changes.withColumns({"run_date": F.to_date("created_at"), "run_id": F.lit(run_id)})
    log = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    log.partitionBy("run_date", "run_id").parquet(path)


# Unit column -> posting column it is refreshed from.
REFRESHED = {
    "best_rent_gross": "rent_gross",
    "best_rent_net": "rent_net",
    "broker_fee": "broker_fee",
    "neighborhood": "neighborhood",
    "borough": "borough",
    "lat": "lat",
    "lng": "lng",
    "bedrooms": "bedrooms",
    "bathrooms": "bathrooms",
    "last_seen_at": "last_seen_at",
}


def newest_posting(postings: DataFrame, listings: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of each unit's most recently seen posting; ties go to the lower id."""
    seen = postings.select("unit_id", "listing_id").join(
        listings.select("listing_id", "last_seen_at", *[F.col(c).alias(f"v_{c}") for c in columns]), "listing_id"
    )
    # The newest as a minimum, so that the id breaks ties upwards.
    return (
        seen.groupBy("unit_id")
        .agg(
            F.min_by(
                F.struct("listing_id", *[F.col(f"v_{c}").alias(c) for c in columns]), F.struct(age("last_seen_at"), "listing_id")
            ).alias("newest")
        )
        .select("unit_id", "newest")
    )


def refresh_units(
    units: DataFrame, postings: DataFrame, listings: DataFrame, keep_known: bool = False, newest_id: bool = False
) -> DataFrame:
    """Best-known fields from the newest posting of each unit.

    A null of the newest posting overwrites too, unless ``keep_known``. Units
    without postings, and every unit's address and unit name, stay as they are.
    With ``newest_id``, a column of that name holds the newest posting's id, for ``refresh_newer``.
    """
    newest = newest_posting(postings, listings, list(dict.fromkeys(REFRESHED.values())))
    joined = units.join(newest, "unit_id", "left")
    out = _refreshed(units, F.col("newest").isNotNull(), keep_known)
    if newest_id:
        out.append(F.col("newest.listing_id").alias("newest_id"))
    return joined.select(*out)


def refresh_newer(units: DataFrame, known: DataFrame, links: DataFrame, listings: DataFrame) -> DataFrame:
    """``refresh_units`` after new links to new postings, without a pass over those before; adds ``newest_id``.

    ``units`` were refreshed before the links came; ``known`` (unit_id, newest_id) names the postings they show.
    """
    newest = newest_posting(links, listings, list(dict.fromkeys(REFRESHED.values())))
    joined = units.join(known.where(F.col("newest_id").isNotNull()), "unit_id", "left").join(newest, "unit_id", "left")
    shown = F.struct(age("last_seen_at").alias("age"), F.col("newest_id").alias("id"))
    come = F.struct(age(F.col("newest.last_seen_at")).alias("age"), F.col("newest.listing_id").alias("id"))
    newer = F.col("newest").isNotNull() & (F.col("newest_id").isNull() | (come < shown))
    latest = F.when(newer, F.col("newest.listing_id")).otherwise(F.col("newest_id"))
    return joined.select(*_refreshed(units, newer, False), latest.alias("newest_id"))


def _refreshed(units: DataFrame, found: Column, keep_known: bool) -> list[Column]:
    """Columns of ``units``, those of ``REFRESHED`` out of ``newest`` where ``found``."""
    out = []
    for c in units.columns:
        if c not in REFRESHED:
            out.append(F.col(c))
            continue
        fresh = F.col(f"newest.{REFRESHED[c]}")
        if keep_known:
            fresh = F.coalesce(fresh, F.col(c))
        out.append(F.when(found, fresh).otherwise(F.col(c)).alias(c))
    return out


def freshness_state(last_seen: Column, as_of: Column) -> Column:
    """active within 7 days, unknown within 14, then stale; both limits belong to the fresher state."""
    return (
        F.when(last_seen >= as_of - F.make_dt_interval(F.lit(ACTIVE_DAYS)), STATES[0])
        .when(last_seen >= as_of - F.make_dt_interval(F.lit(UNKNOWN_DAYS)), STATES[1])
        .otherwise(STATES[2])
    )


def update_freshness(units: DataFrame, as_of: Column) -> DataFrame:
    """Units with their state as of a time, and whether it changed."""
    state = freshness_state(F.col("last_seen_at"), as_of)
    changed = ~F.col("active_state").eqNullSafe(state)
    return units.withColumn("state_changed", changed).withColumn("active_state", state)


def freshness_counts(fresh: DataFrame) -> DataFrame:
    """Units that moved to each state."""
    return fresh.groupBy("active_state").agg(
        F.count_if("state_changed").alias("moved"), F.count(F.lit(1)).alias("units")
    )
