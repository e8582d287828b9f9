"""Which urls to visit next, and the book-keeping of crawl jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..functions.urls import url_host, url_id
from .merge import keyed_upsert
from .ranking import number_rows, top_rows

# Caps of a run, and milliseconds between two visits of a host.
TARGET_UNITS, MAX_URLS, BATCH, PER_SEARCH = 200, 200, 30, 20
DEFAULT_DELAY_MS = 1000
HOST_DELAY_MS = {"www.leasebreak.com": 1200, "leasebreak.com": 1200}
# Longest prompt that enters a query text, opening words of every query.
PROMPT_BELOW = 200
QUERY_START = "NYC apartment for rent"
# How a query text gives the limits of a search.
RENT_BELOW, BEDROOMS, WITHOUT_FEE = "under $", " bedroom", "no fee"


def unseen_urls(discovered: DataFrame, listings: DataFrame) -> DataFrame:
    """Discovered urls that are no posting of the same source yet; input order stays in ``seq``."""
    known = listings.select("source", F.col("source_url").alias("url"))
    return discovered.join(known, ["source", "url"], "left_anti")


def known_urls(discovered: DataFrame, listings: DataFrame) -> DataFrame:
    known = listings.select("source", F.col("source_url").alias("url"))
    return discovered.join(known, ["source", "url"], "left_semi")


def plan_frontier(
    discovered: DataFrame,
    listings: DataFrame,
    batch: int = BATCH,
    max_urls: int = MAX_URLS,
    attempted: int = 0,
    units: int = 0,
    target: int = TARGET_UNITS,
) -> DataFrame:
    """Urls of the next round: up to ``batch`` unseen ones per source, ``max_urls`` in all.

    Sources take their share in name order out of what the run may still attempt. A
    registry at its target gets an empty plan.
    """
    room = max(0, max_urls - attempted) if units < target else 0
    fresh = unseen_urls(discovered, listings)
    per_source = top_rows(fresh, ["source"], [F.col("seq"), F.col("url")], batch, "place")
    # At most ``batch`` urls per source are left, ``room`` of them are taken.
    return per_source.orderBy("source", "place").limit(room).withColumn("source_listing_id", url_id(F.col("url")))


def host_delay() -> Column:
    """Milliseconds between two visits of the host in column ``host``."""
    delay = F.lit(DEFAULT_DELAY_MS)
    for name, ms in HOST_DELAY_MS.items():
        delay = F.when(F.col("host") == name, F.lit(ms)).otherwise(delay)
    return delay


def host_schedule(urls: DataFrame, delay: Column | None = None) -> DataFrame:
    """Earliest start of each visit, keeping visits of one host apart by ``delay``."""
    placed = number_rows(urls.withColumn("host", url_host(F.col("url"))), ["host"], [F.col("seq"), F.col("url")], "visit")
    return placed.withColumn("start_ms", (F.col("visit") - 1) * (host_delay() if delay is None else delay))


def discovery_query(
    prompt: Column, max_rent: Column, min_beds: Column, borough: Column, neighborhood: Column, no_fee: Column
) -> Column:
    """Search text of a saved search; zero rent and zero bedrooms count as not given."""
    beds = F.regexp_replace(min_beds.cast("string"), r"\.0\z", "")
    return F.concat_ws(
        " ",
        F.lit(QUERY_START),
        F.nullif(borough, F.lit("")),
        F.nullif(neighborhood, F.lit("")),
        F.when(max_rent != 0, F.concat(F.lit(RENT_BELOW), max_rent.cast("string"))),
        F.when(min_beds != 0, F.concat(beds, F.lit(BEDROOMS))),
        F.when(no_fee, F.lit(WITHOUT_FEE)),
        F.when((F.length(prompt) > 0) & (F.length(prompt) < PROMPT_BELOW), prompt),
    )


def plan_searches(searches: DataFrame, sources: list[str]) -> DataFrame:
    """One crawl task per active saved search and source, with its query text."""
    return searches.filter("is_active").select(
        "search_id",
        F.explode(F.array(*[F.lit(s) for s in sources])).alias("source"),
        discovery_query(
            *[F.col(c) for c in ("prompt", "max_rent", "min_beds", "borough", "neighborhood", "no_fee_preferred")]
        ).alias("query"),
    )


def plan_targeted(tasks: DataFrame, discovered: DataFrame, listings: DataFrame, cap: int = PER_SEARCH) -> DataFrame:
    """Up to ``cap`` unseen urls of each task; ``discovered`` carries search_id and source."""
    fresh = unseen_urls(discovered, listings)
    kept = top_rows(fresh, ["search_id", "source"], [F.col("seq"), F.col("url")], cap, "place")
    return kept.join(tasks, ["search_id", "source"]).withColumn("source_listing_id", url_id(F.col("url")))


MODE_TARGETED, MODE_REGISTRY = "user_targeted", "seed_registry"


def assign_jobs(tasks: DataFrame, jobs: DataFrame, mode: str = MODE_TARGETED) -> DataFrame:
    """Job of each task: the active one with the same source and query, else a new id."""
    active = (
        jobs.filter((F.col("status") == "active") & (F.col("mode") == mode))
        .groupBy("source", "query")
        .agg(F.min(F.struct("created_at", "job_id"))["job_id"].alias("active_job"))
    )
    fresh = stable_id(F.lit("job"), F.lit(mode), F.col("source"), F.col("query"))
    return (
        tasks.join(active, ["source", "query"], "left")
        .withColumn("job_id", F.coalesce("active_job", fresh))
        .withColumn("is_new", F.col("active_job").isNull())
        .drop("active_job")
    )


def open_jobs(assigned: DataFrame, jobs: DataFrame, opened_at: Column, mode: str = MODE_TARGETED, target: int | None = None) -> DataFrame:
    """``jobs`` with a row for every new job of ``assigned`` (see ``assign_jobs``), its counters at zero."""
    types = dict(jobs.dtypes)
    fresh = assigned.filter("is_new").select("job_id", "source", "query").distinct().join(jobs.select("job_id"), "job_id", "left_anti")
    known = {
        "mode": F.lit(mode), "status": F.lit("active"), "target_count": F.lit(target),
        "discovered": F.lit(0), "ingested": F.lit(0), "units_added": F.lit(0),
        "created_at": opened_at, "updated_at": opened_at,
    }
    return jobs.unionByName(fresh.select(*[known.get(c, F.col(c)).cast(types[c]).alias(c) for c in jobs.columns]))


def add_job_counts(jobs: DataFrame, deltas: DataFrame, updated_at: Column | None = None) -> DataFrame:
    """Targeted jobs: counters of the run are added to the job's own, which counts as an update.

    Jobs the run has begun must have been opened (``open_jobs``).
    """
    names = ("discovered", "ingested", "units_added")
    run = deltas.groupBy("job_id").agg(*[F.sum(c).alias(f"d_{c}") for c in names], F.lit(True).alias("counted"))
    added = jobs.join(run, "job_id", "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"d_{c}"), F.lit(0)) for c in names})
    if updated_at is not None:
        added = added.withColumn("updated_at", F.when(F.col("counted"), updated_at).otherwise(F.col("updated_at")))
    return added.select(*jobs.columns)


def set_job_counts(jobs: DataFrame, totals: DataFrame) -> DataFrame:
    """Registry jobs: counters are replaced, and a job at its target pauses.

    ``totals``: job_id, updated_at, discovered, ingested, units_added, ending_units.
    """
    rows = totals.join(jobs.select("job_id", "target_count"), "job_id").withColumn(
        "status", F.when(F.col("ending_units") >= F.col("target_count"), "paused").otherwise("active")
    )
    return keyed_upsert(
        jobs, rows, ("job_id",), ("updated_at",),
        update=("discovered", "ingested", "units_added", "status", "updated_at"),
    )


def run_stats(
    discovered: DataFrame, fresh: DataFrame, ingested: DataFrame, units_before: DataFrame, links: DataFrame
) -> DataFrame:
    """One row about a registry run; each of its stages is read once, for all its counts.

    ``ingested`` carries ``error``; ``links`` carries ``founds_unit``.
    """
    every, failed = F.count(F.lit(1)), F.count_if(F.col("error").isNotNull())
    parts = [
        units_before.agg(every.alias("starting_units")),
        discovered.agg(every.alias("discovered")),
        fresh.agg(every.alias("new_urls")),
        ingested.agg((every - failed).alias("ingested"), failed.alias("errors")),
        links.agg(F.count_if("founds_unit").alias("units_added")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)  # one row of each, nulls in the columns of others
    counts = rows.agg(*[F.max(c).alias(c) for c in rows.columns])
    return counts.withColumn("ending_units", F.col("starting_units") + F.col("units_added"))
