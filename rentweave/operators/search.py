"""Filtered, sorted and paged unit search; saved searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .ranking import age, top_rows
from .registry import newest_posting

# Page size when none is asked for, and the largest one.
DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def clamp_page(page: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(page, F.lit(1)))


def clamp_limit(limit: Column) -> Column:
    return F.least(F.lit(MAX_LIMIT), F.greatest(F.lit(1), F.coalesce(limit, F.lit(DEFAULT_LIMIT))))


def filter_units(
    units: DataFrame,
    max_rent: int | None = None,
    min_beds: float | None = None,
    borough: str | None = None,
    neighborhood: str | None = None,
) -> DataFrame:
    """Units within the limits; an unknown rent or bedroom count fails its limit."""
    if max_rent is not None:
        units = units.filter(F.col("best_rent_gross") <= max_rent)
    if min_beds is not None:
        units = units.filter(F.col("bedrooms") >= min_beds)
    if borough:
        units = units.filter(F.col("borough") == borough)
    if neighborhood:
        units = units.filter(F.col("neighborhood") == neighborhood)
    return units


#: What searches filter by, in the order in which the units of a search table lie.
CLUSTERED = ("borough", "neighborhood", "best_rent_gross")


def write_search_table(units: DataFrame, path: str, row_group_bytes: int | None = None) -> DataFrame:
    """Units as a table that searches read in part: range-clustered by place and rent.

    A file, and a row group of it, spans a narrow range of ``CLUSTERED``, so the limits of ``filter_units``, which
    reach the scan, skip those that hold no hit.
    """
    order = [F.col(c) for c in CLUSTERED]
    units = stage(units, "units")  # range partitioning reads its input twice
    written = units.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite")
    if row_group_bytes:
        written = written.option("parquet.block.size", row_group_bytes)
    written.parquet(path)
    return units.sparkSession.read.schema(units.schema).parquet(path)


def search_order(no_fee_preferred: bool = False) -> list[Column]:
    """Newest first; no-fee units before the others (unknown last) when preferred."""
    order = [F.col("last_seen_at").desc(), F.col("unit_id")]
    return [F.col("broker_fee").asc_nulls_last(), *order] if no_fee_preferred else order


def posting_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy("unit_id").agg(F.count(F.lit(1)).alias("sources_count"))


def newest_image(postings: DataFrame, listings: DataFrame) -> DataFrame:
    """First image of each unit's most recently seen posting."""
    newest = newest_posting(postings, listings, ["images"])
    image = F.nullif(F.try_element_at("newest.images", F.lit(1)), F.lit(""))
    return newest.select("unit_id", image.alias("image_url"))


def search_units(
    units: DataFrame,
    postings: DataFrame,
    listings: DataFrame,
    *,
    no_fee_preferred: bool = False,
    page: int = 1,
    limit: int = DEFAULT_LIMIT,
    **limits,
) -> DataFrame:
    """One page of search results.

    The page is cut first and kept as a table of its own, at most 100 rows, which
    makes it a safe broadcast; posting counts and images are looked up for it only.
    """
    page = max(1, page)
    limit = min(MAX_LIMIT, max(1, limit))
    found = filter_units(units, **limits).orderBy(*search_order(no_fee_preferred))
    hits = stage(found.offset((page - 1) * limit).limit(limit), "page")
    ids = F.broadcast(hits.select("unit_id"))
    linked = postings.select("unit_id", "listing_id").join(ids, "unit_id", "left_semi")
    # only the page's postings, and of their images the first, come to a join
    shown = listings.join(linked.select("listing_id"), "listing_id", "left_semi").withColumn("images", F.slice("images", 1, 1))
    details = posting_counts(linked).join(newest_image(linked, shown), "unit_id", "left")
    return (
        hits.join(details, "unit_id", "left")
        .select(
            "unit_id",
            F.col("canonical_address").alias("address"),
            F.col("canonical_unit").alias("unit"),
            "neighborhood", "borough", "bedrooms", "bathrooms",
            F.col("best_rent_gross").alias("rent_gross"),
            F.col("best_rent_net").alias("rent_net"),
            "broker_fee", "active_state", "last_seen_at",
            F.coalesce("sources_count", F.lit(0)).alias("sources_count"),
            "image_url",
        )
        .orderBy(*search_order(no_fee_preferred))
    )


def search_meta(units: DataFrame, page: int = 1, limit: int = DEFAULT_LIMIT, **limits) -> DataFrame:
    """Page number, page size, total hits and number of pages."""
    total = filter_units(units, **limits).agg(F.count(F.lit(1)).alias("total"))
    size = clamp_limit(F.lit(limit))
    return total.select(
        clamp_page(F.lit(page)).cast("bigint").alias("page"),
        size.cast("bigint").alias("limit"),
        "total",
        F.ceil(F.col("total") / size).cast("bigint").alias("total_pages"),
    )


_ANY = "\u0002any"
# Rents as unsigned 32-bit numbers, cut into blocks of 16, 16^2, ... values.
_RENT_SHIFT, _BITS, _LEVELS = 1 << 31, 4, 9
_ANY_RENT = -1


def _block(level: int, index: Column) -> Column:
    return F.lit(level << 33) + index


def _blocks_holding(rent: Column) -> Column:
    """Every block a rent lies in, one per level, and the block of all rents (also unknown ones)."""
    x = rent.cast("bigint") + _RENT_SHIFT
    levels = [_block(n, F.shiftright(x, _BITS * n)) for n in range(_LEVELS)]
    known = F.when(rent.isNotNull(), F.array(*levels)).otherwise(F.array().cast("array<bigint>"))
    return F.concat(known, F.array(F.lit(_ANY_RENT).cast("bigint")))


def _blocks_up_to(limit: Column) -> Column:
    """Disjoint blocks that together hold exactly the rents up to ``limit``."""
    x = limit.cast("bigint") + (_RENT_SHIFT + 1)
    parts = []
    for n in range(_LEVELS):
        digit = F.shiftright(x, _BITS * n).bitwiseAND(F.lit((1 << _BITS) - 1))
        base = F.shiftleft(F.shiftright(x, _BITS * (n + 1)), _BITS)
        span = F.sequence(_block(n, base), _block(n, base + digit - 1))
        parts.append(F.when(digit > 0, span).otherwise(F.array().cast("array<bigint>")))
    return F.when(limit.isNotNull(), F.concat(*parts)).otherwise(F.array(F.lit(_ANY_RENT).cast("bigint")))


def match_saved_searches(searches: DataFrame, units: DataFrame) -> DataFrame:
    """Every active saved search run over all units: total hits and the first one in search order.

    The order is newest first, behind units without a broker fee where the search prefers
    them; both firsts are kept per block, as minima.

    No search is compared with single units. Units are summed up per place, block of
    rents and bedroom count; a search reads the few blocks that make up its rent range
    (equi-join on place and block) under its place, or under a wildcard place that
    every unit also enters. Searches shrink to their distinct limits first.
    """
    active = searches.filter("is_active")
    limits = active.select(
        F.coalesce(F.nullif("borough", F.lit("")), F.lit(_ANY)).alias("at_borough"),
        F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit(_ANY)).alias("at_hood"),
        "max_rent", "min_beds", "search_id", F.coalesce("no_fee_preferred", F.lit(False)).alias("no_fee"),
    )
    key = ["at_borough", "at_hood", "max_rent", "min_beds"]
    asked = limits.select(*key).distinct().withColumn("block", F.explode(_blocks_up_to(F.col("max_rent"))))

    places = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit(_ANY)), F.lit(_ANY)))
    by_age = [age("last_seen_at").alias("age"), F.col("unit_id"), F.col("last_seen_at")]
    by_fee = F.coalesce(F.col("broker_fee").cast("int"), F.lit(2)).alias("fee")
    summed = (
        units.groupBy("borough", "neighborhood", "best_rent_gross", "bedrooms")
        .agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct(*by_age)).alias("newest"), F.min(F.struct(by_fee, *by_age)).alias("no_fee_first")
        )
        .withColumn("at_borough", F.explode(places("borough")))
        .withColumn("at_hood", F.explode(places("neighborhood")))
        .withColumn("block", F.explode(_blocks_holding(F.col("best_rent_gross"))))
        .groupBy("at_borough", "at_hood", "block", "bedrooms")
        .agg(F.sum("n").alias("n"), F.min("newest").alias("newest"), F.min("no_fee_first").alias("no_fee_first"))
    )
    hits = (
        asked.join(summed, ["at_borough", "at_hood", "block"])
        .filter(F.col("min_beds").isNull() | (F.col("bedrooms") >= F.col("min_beds")))
        .groupBy(*key)
        .agg(F.sum("n").alias("total"), F.min("newest").alias("newest"), F.min("no_fee_first").alias("no_fee_first"))
        .select(*[F.col(c).alias(f"k_{c}") for c in key], "total", "newest", "no_fee_first")
    )
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    return limits.join(hits, same, "left").select(
        "search_id",
        F.coalesce("total", F.lit(0)).alias("total"),
        *[
            F.when(F.col("no_fee"), F.col(f"no_fee_first.{c}")).otherwise(F.col(f"newest.{c}")).alias(name)
            for c, name in (("unit_id", "first_unit_id"), ("last_seen_at", "first_hit_seen_at"))
        ],
    )


#: Levels of blocks that are cut one from the other; above, few units are left and enter all levels at once.
_CUT_LEVELS = 3


def _in_blocks(few: DataFrame, first: int) -> DataFrame:
    """Units in every ``block`` they may be shown for: per own place, bedroom count and fee the ``first`` newest of each.

    ``few`` holds the newest units per rent (level 0). A block's newest are among the newest of the blocks in it, so a
    level is cut from the one below instead of from all units.
    """
    newest = [F.col("age"), F.col("unit_id")]
    alike = ["borough", "neighborhood", "block", "bedrooms", "fee"]
    rent = F.col("best_rent_gross").cast("bigint") + _RENT_SHIFT
    index = lambda n: _block(n, F.shiftright(rent, _BITS * n))
    level = few.where(F.col("best_rent_gross").isNotNull()).withColumn("block", index(0))
    everything = F.lit(_ANY_RENT).cast("bigint")
    out = few.where(F.col("best_rent_gross").isNull()).withColumn("block", everything).unionByName(level)
    for n in range(1, _CUT_LEVELS):
        level = stage(top_rows(level.withColumn("block", index(n)), alike, newest, first, "_place").drop("_place"), "level")
        out = out.unionByName(level)
    above = F.array(*[index(n) for n in range(_CUT_LEVELS, _LEVELS)], everything)
    return out.unionByName(level.withColumn("block", F.explode(above)))


def saved_search_pages(searches: DataFrame, units: DataFrame, first: int = DEFAULT_LIMIT) -> DataFrame:
    """The first ``first`` hits of every active saved search, in its own order, with its total.

    ``search_id, total, place, unit_id, last_seen_at, broker_fee``; a search without hits has one row with
    place null. Like ``match_saved_searches``, but the summary of a block holds its newest units instead of
    one: ``first`` of each fee (none, charged, unknown), which is all that either order can show of it. The
    summary is cut in every task before it is shuffled. A larger block is made from the newest units of the blocks
    in it, and what a block shows under a bedroom limit and order is found once for all searches that ask for it, so
    a search reads ``first`` units per block of its range, however many match.
    """
    first = min(MAX_LIMIT, max(1, first))
    fee = F.coalesce(F.col("broker_fee").cast("int"), F.lit(2))
    rows = units.select(
        "borough", "neighborhood", "best_rent_gross", "bedrooms", fee.alias("fee"), age("last_seen_at").alias("age"),
        "unit_id", "last_seen_at", "broker_fee",
    )
    newest = ["age", "unit_id"]
    # rows of equal limits come first: they enter all blocks alike
    alike = ["borough", "neighborhood", "best_rent_gross", "bedrooms", "fee"]
    few = stage(top_rows(rows, alike, [F.col(c) for c in newest], first, "_place").drop("_place"), "newest")
    places = lambda c: F.array_distinct(F.array(F.coalesce(c, F.lit(_ANY)), F.lit(_ANY)))
    entered = (
        _in_blocks(few, first)
        .withColumn("at_borough", F.explode(places(F.col("borough"))))
        .withColumn("at_hood", F.explode(places(F.col("neighborhood"))))
    )
    block = ["at_borough", "at_hood", "block", "bedrooms", "fee"]
    summary = top_rows(entered, block, [F.col(c) for c in newest], first, "_place").select(
        *block, *newest, "last_seen_at", "broker_fee"
    )

    active = searches.filter("is_active").select(
        "search_id", F.coalesce(F.nullif("borough", F.lit("")), F.lit(_ANY)).alias("at_borough"),
        F.coalesce(F.nullif("neighborhood", F.lit("")), F.lit(_ANY)).alias("at_hood"),
        "max_rent", "min_beds", F.coalesce("no_fee_preferred", F.lit(False)).alias("no_fee"),
    )
    # searches of equal limits and order are answered once
    limits = ["at_borough", "at_hood", "max_rent", "min_beds", "no_fee"]
    number = F.xxhash64(*limits)
    asked = active.select(*limits).distinct().withColumn("ask", number)
    part = ["at_borough", "at_hood", "block", "any_beds", "beds_from", "no_fee"]
    read = (
        asked.withColumn("block", F.explode(_blocks_up_to(F.col("max_rent"))))
        .withColumns({"any_beds": F.col("min_beds").isNull(), "beds_from": F.coalesce("min_beds", F.lit(0.0))})
        .select("ask", *part)
    )
    # what a block shows is the same for all who ask for it under one bedroom limit and order
    shown = (
        read.select(*part).distinct()
        .join(summary, ["at_borough", "at_hood", "block"])
        .filter(F.col("any_beds") | (F.col("bedrooms") >= F.col("beds_from")))
        .withColumn("shown_fee", F.when(F.col("no_fee"), F.col("fee")).otherwise(F.lit(0)))
    )
    order = [F.col("shown_fee"), F.col("age"), F.col("unit_id")]
    firsts = top_rows(shown, part, order, first, "_place").drop("_place", "bedrooms", "fee")
    page = top_rows(read.join(firsts, part), ["ask"], order, first, "place").select("ask", "place", "unit_id", "last_seen_at", "broker_fee")
    totals = match_saved_searches(searches, units).select("search_id", "total")
    return (
        active.withColumn("ask", number).select("search_id", "ask")
        .join(totals, "search_id").join(page, "ask", "left").drop("ask")
    )
