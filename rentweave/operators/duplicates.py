"""Exact copies of raw content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint


def exact_duplicates(df: DataFrame, content: str, key: str) -> DataFrame:
    """Content that occurs more than once: fingerprint, copies, lowest key."""
    return (
        df.select(fingerprint(F.col(content)).alias("fingerprint"), key)
        .groupBy("fingerprint")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key"))
        .filter("copies > 1")
    )
