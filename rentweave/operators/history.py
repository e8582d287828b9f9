"""What a posting looked like over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import previous_value


def price_history(observations: DataFrame, keys: list[str], ts: str, tie: str, price: str) -> DataFrame:
    """Observations whose price differs from the one before of the same posting."""
    known = observations.filter(F.col(price).isNotNull())
    seen = previous_value(known, keys, [ts, tie], price, "old_price")
    return seen.filter(F.col("old_price") != F.col(price)).select(
        *keys, ts, tie, "old_price", F.col(price).alias("new_price")
    )


def first_last_seen(observations: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """First and last sighting of each posting; runs on batches and streams alike."""
    return observations.groupBy(*keys).agg(
        F.min(ts).alias("first_seen_at"), F.max(ts).alias("last_seen_at")
    )
