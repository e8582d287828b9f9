"""A whole run: ingest, link, refresh, freshness."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.linkage import LinkResult, link_postings, oldest_first
from ..operators.merge import upsert_links, upsert_listings, upsert_raw
from ..operators.registry import (
    LINKED_BY, attach_changes, found_units, refresh_newer, refresh_units, unlinked, update_freshness,
)
from ..session import stage


@dataclass
class Registry:
    """Tables of the registry at one moment."""

    raw: DataFrame
    listings: DataFrame
    units: DataFrame
    postings: DataFrame


@dataclass
class LinkRun:
    units: DataFrame
    postings: DataFrame
    changes: DataFrame
    result: LinkResult


def apply_links(
    listings: DataFrame, units: DataFrame, postings: DataFrame, result: LinkResult, as_of: Column, strict: bool = True
) -> LinkRun:
    """Units, postings and change records after a linkage."""
    run = _linked(listings, units, result, as_of, strict)
    run.postings = upsert_links(postings, run.postings)
    return run


def _linked(listings: DataFrame, units: DataFrame, result: LinkResult, as_of: Column, strict: bool) -> LinkRun:
    """Units and change records after a linkage, and as postings the links to write."""
    founded = found_units(listings, result.links, as_of, strict)
    # A posting linked again founds the same id it founded before.
    founded = founded.join(units.select("unit_id"), "unit_id", "left_anti")
    all_units = units.unionByName(founded.select(*units.columns))
    links = result.links.select("unit_id", "listing_id", "match_score", as_of.alias("created_at"))
    changes = attach_changes(result.links.filter("not founds_unit"), all_units, listings, as_of)
    return LinkRun(all_units, links, changes, result)


def link_new(
    listings: DataFrame, units: DataFrame, postings: DataFrame, as_of: Column, strict: bool = True, newest_id: bool = False
) -> LinkRun:
    """Link every posting without a unit, newest first, then refresh all posted units (``newest_id``: see there)."""
    todo = stage(unlinked(listings, postings).select(*LINKED_BY), "todo")
    run = apply_links(
        todo, units, postings, link_postings(todo, units, strict=strict), as_of, strict
    )
    run.postings = stage(run.postings, "links")  # read by the refresh and by whoever keeps the tables
    run.units = refresh_units(run.units, run.postings, listings, newest_id=newest_id)
    return run


def arrival_changes(
    arrived: DataFrame, units: DataFrame, postings: DataFrame, as_of: Column, strict: bool = True, refound: bool = False
) -> LinkRun:
    """What linking arriving postings in order of arrival adds or changes.

    ``units`` of the result are the founded ones and those that got a posting, ``postings`` the
    links to write; nothing else in the registry is touched. ``postings`` given need only hold
    those of the arrivals. Units take the time of the posting attached last, other fields wait
    for a full run. ``refound``: a posting that has a unit, but matches none now, founds a second one.
    """
    known = postings.select("unit_id", "listing_id").join(arrived.select("listing_id"), "listing_id", "left_semi")
    result = link_postings(arrived, units, order=oldest_first(), linked=known, strict=strict, refound=refound)
    seen = (
        result.links.join(arrived.select("listing_id", "last_seen_at"), "listing_id")
        .groupBy("unit_id")
        .agg(F.max("last_seen_at").alias("attached_at"))
    )
    founded = found_units(arrived, result.links, as_of, strict)
    # A posting linked again founds the same id it founded before.
    fresh = founded.join(units.select("unit_id"), "unit_id", "left_anti").select(*units.columns)
    before = stage(units.join(seen.select("unit_id"), "unit_id", "left_semi").unionByName(fresh), "attached")
    after = before.join(seen, "unit_id", "left").withColumn("last_seen_at", F.coalesce("attached_at", "last_seen_at"))
    links = result.links.select("unit_id", "listing_id", "match_score", as_of.alias("created_at"))
    changes = attach_changes(result.links.filter("not founds_unit"), before, arrived, as_of)
    return LinkRun(after.select(*units.columns), links, changes, result)


def link_arrivals(
    arrived: DataFrame, units: DataFrame, postings: DataFrame, as_of: Column, strict: bool = True, refound: bool = False
) -> LinkRun:
    """Whole tables after ``arrival_changes``; some of the arrivals may have a unit already."""
    run = arrival_changes(arrived, units, postings, as_of, strict, refound)
    rest = units.join(run.units.select("unit_id"), "unit_id", "left_anti")
    return LinkRun(rest.unionByName(run.units), upsert_links(postings, run.postings), run.changes, run.result)


def _together(batches: list, part: str) -> DataFrame:
    """The batches' records as one, with their batch's place: one merge however many sources there are."""
    parts = [getattr(b, part).withColumn("batch", F.lit(n)) for n, b in enumerate(batches)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def run_batch(registry: Registry, batches: list, as_of: Column, strict: bool = True) -> tuple[Registry, DataFrame]:
    """Ingest batches into the registry, link, refresh and set states.

    Returns the new registry (each table written once) and the change records.
    """
    done, changes, _ = _run_batch(registry, batches, as_of, strict, newest_id=False)
    return done, changes


def run_batch_newest(
    registry: Registry, batches: list, as_of: Column, strict: bool = True
) -> tuple[Registry, DataFrame, DataFrame]:
    """``run_batch``, and (unit_id, newest_id): the newest posting of each unit, where it has one."""
    return _run_batch(registry, batches, as_of, strict, newest_id=True)


def _run_batch(registry, batches, as_of, strict, newest_id):
    raw, listings = registry.raw, registry.listings
    if batches:
        raw, listings = upsert_raw(raw, _together(batches, "raw")), upsert_listings(listings, _together(batches, "listings"))
    raw, listings = stage(raw, "raw"), stage(listings, "listings")
    run = link_new(listings, registry.units, registry.postings, as_of, strict, newest_id)
    units = stage(update_freshness(run.units, as_of).drop("state_changed"), "units")
    newest = units.select("unit_id", "newest_id") if newest_id else None
    return Registry(raw, listings, units.select(*registry.units.columns), run.postings), run.changes, newest


@dataclass
class UnseenRun:
    """What a run over unseen postings adds to raw, listings and postings; units, and their newest postings, are whole."""

    raw: DataFrame
    listings: DataFrame
    postings: DataFrame
    units: DataFrame
    newest: DataFrame
    changes: DataFrame


def run_unseen(registry: Registry, newest: DataFrame, batches: list, as_of: Column, strict: bool = True) -> UnseenRun:
    """``run_batch`` for postings that the registry does not hold, without a pass over those it does.

    The registry is as a run left it: its postings have units, which show the newest of them (``newest``: unit_id,
    newest_id). Raw pages may be known; they are returned as fetched now.
    """
    raw = stage(upsert_raw(registry.raw.limit(0), _together(batches, "raw")), "raw")
    listings = stage(upsert_listings(registry.listings.limit(0), _together(batches, "listings")), "listings")
    todo = listings.select(*LINKED_BY)
    run = _linked(todo, registry.units, link_postings(todo, registry.units, strict=strict), as_of, strict)
    units = refresh_newer(run.units, newest, run.postings, todo)
    units = stage(update_freshness(units, as_of).drop("state_changed"), "units")
    return UnseenRun(
        raw, listings, run.postings, units.select(*registry.units.columns), units.select("unit_id", "newest_id"), run.changes
    )
