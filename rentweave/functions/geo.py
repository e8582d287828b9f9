"""Location and size comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_number, trim_ws

# Grid cells per degree; how far bedrooms and bathrooms may differ.
CELLS_PER_DEGREE = 1000
ROOM_TOLERANCE = 0.5


def round_half_up(x: Column) -> Column:
    """Nearest whole number, exact halves toward +infinity (also below zero)."""
    low = F.floor(x)
    return low + F.when(x - low >= 0.5, F.lit(1)).otherwise(F.lit(0))


def cell_index(degrees: Column) -> Column:
    """Index of the grid cell of one coordinate."""
    return round_half_up(degrees * CELLS_PER_DEGREE)


def geo_cell(lat: Column, lng: Column) -> Column:
    """Grid cell as text, null unless both coordinates are known."""
    both = lat.isNotNull() & lng.isNotNull()
    text = [F.format_string("%.3f", cell_index(d) / CELLS_PER_DEGREE) for d in (lat, lng)]
    return F.when(both, F.concat_ws(",", *text))


def geo_pair(c: Column) -> tuple[Column, Column]:
    """Latitude and longitude of "40.7;-73.9" or "40.7, -73.9"; zero counts as unknown."""
    parts = F.split(c, "[;,]")

    def number(i: int) -> Column:
        value = parse_number(trim_ws(F.try_element_at(parts, F.lit(i))))
        return F.nullif(value, F.lit(0.0))

    return number(1), number(2)


def rooms_close(beds_a: Column, beds_b: Column, baths_a: Column, baths_b: Column) -> Column:
    """Bedrooms known and close on both sides; bathrooms close or unknown on either."""
    beds = F.coalesce(F.abs(beds_a - beds_b) <= ROOM_TOLERANCE, F.lit(False))
    baths = F.coalesce(F.abs(baths_a - baths_b) <= ROOM_TOLERANCE, F.lit(True))
    return beds & baths
