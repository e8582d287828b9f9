"""What is known about each unit: its postings, changes and images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import age, top_rows

# Change records and gallery images shown per unit.
SHOWN_CHANGES, SHOWN_IMAGES = 50, 10

POSTING_FIELDS = (
    "source", "source_url", "title", "rent_gross", "rent_net", "broker_fee", "address", "unit",
    "description", "images", "last_seen_at", "first_seen_at",
)


def unit_postings(units: DataFrame, postings: DataFrame, listings: DataFrame) -> DataFrame:
    """One row per unit and posting, also for units without one.

    Rows instead of one nested array per unit: a unit may hold any number of
    postings. Sort by (unit_id, last_seen_at desc, listing_id) to read them in order.
    """
    shown = [c for c in POSTING_FIELDS if c in listings.columns]
    posted = postings.select("unit_id", "listing_id", "match_score").join(
        listings.select("listing_id", *[F.col(c).alias(f"posting_{c}") for c in shown]), "listing_id", "left"
    )
    # Not a left join: only the unit side of one could be split when a unit holds very
    # many postings, and here it is the posting side that has to be.
    alone = units.join(postings.select("unit_id").distinct(), "unit_id", "left_anti")
    return units.join(posted, "unit_id").unionByName(alone, allowMissingColumns=True)


def latest_changes(changes: DataFrame, k: int = SHOWN_CHANGES) -> DataFrame:
    """Newest ``k`` change records of each unit, numbered."""
    order = [F.col("created_at").desc(), F.col("listing_id"), F.col("kind")]
    return top_rows(changes, ["unit_id"], order, k, "ord")


def unit_changes(units: DataFrame, changes: DataFrame, k: int = SHOWN_CHANGES) -> DataFrame:
    """Units with their newest changes, also units without any."""
    return units.select("unit_id").join(latest_changes(changes, k), "unit_id", "left")


def unit_gallery(postings: DataFrame, listings: DataFrame, k: int = SHOWN_IMAGES) -> DataFrame:
    """First ``k`` distinct images of each unit, newest posting first.

    Each image keeps its first place; copies are merged before the shuffle and only
    ``k`` images per unit are ever brought together.
    """
    seen = postings.select("unit_id", "listing_id").join(
        listings.select("listing_id", "last_seen_at", "images"), "listing_id"
    ).select("unit_id", age("last_seen_at").alias("age"), "listing_id", F.posexplode("images").alias("pos", "image"))
    first = seen.groupBy("unit_id", "image").agg(F.min(F.struct("age", "listing_id", "pos")).alias("at"))
    top = top_rows(first, ["unit_id"], [F.col("at")], k, "ord")
    return top.groupBy("unit_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "image"))), lambda x: x["image"]
        ).alias("gallery")
    )


def unit_detail(
    units: DataFrame, postings: DataFrame, listings: DataFrame, changes: DataFrame, unit_id: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Detail of one unit: its row, its postings newest first, its newest changes."""
    one = units.filter(F.col("unit_id") == unit_id)
    posted = unit_postings(one.select("unit_id"), postings.filter(F.col("unit_id") == unit_id), listings)
    return (
        one,
        posted.filter(F.col("listing_id").isNotNull()).orderBy(F.col("posting_last_seen_at").desc(), "listing_id"),
        latest_changes(changes.filter(F.col("unit_id") == unit_id)).orderBy("ord"),
    )
