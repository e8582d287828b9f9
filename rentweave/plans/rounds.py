"""Crawl rounds as one call: plan, ingest what was fetched, link, count.

What a crawler fetched is a table here (source, source_url, source_listing_id, http_status,
raw_content, seen_at, seq); a round takes from it the urls it planned. ``fill_registry``
repeats rounds until the target and can be stopped and started again; the caller may also
repeat rounds by hand, each on the registry and jobs that the last one returned.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators import frontier
from ..operators.ingest import IngestBatch, ingest_batch
from ..operators.merge import join_raw, rows_among
from ..schemas import CHANGE_LOG, CRAWL_JOBS, LISTINGS, POSTINGS, RAW_LISTINGS, ROUND_STATS, UNITS
from ..session import stage
from ..sources.adapters import BUILT_IN, SourceAdapter
from .run import Registry, UnseenRun, run_batch, run_batch_newest, run_unseen


@dataclass
class Round:
    """Registry and jobs after a round, its change records and, of a registry round, its one row of counts.

    Of a registry round also (unit_id, newest_id), the newest posting of each unit, with which the next one goes on
    (``newest``), and, if it went on so itself, what it added.
    """

    registry: Registry
    jobs: DataFrame
    changes: DataFrame
    stats: DataFrame | None = None
    newest: DataFrame | None = None
    added: UnseenRun | None = None


def _ingest(plan: DataFrame, fetched: DataFrame, adapters: Sequence[SourceAdapter]) -> list[IngestBatch]:
    """Batches of the planned urls, one per source."""
    wanted = plan.select("source", F.col("url").alias("source_url")).distinct()
    key = ["source", "source_url"]
    # a round's rows often lie together in the input: spread, else one task parses them all
    got = stage(rows_among(fetched, wanted, key).repartition(*key), "fetched")
    return [ingest_batch(got.filter(F.col("source") == a.name).drop("source"), a) for a in adapters]


def _outcomes(batches: list[IngestBatch]) -> DataFrame:
    """``source, source_url, error`` of every ingested row."""
    columns = ("source", "source_url")
    parts = [b.listings.select(*columns, F.lit(None).cast("string").alias("error")) for b in batches]
    parts += [b.errors.select(*columns, "error") for b in batches]
    return reduce(DataFrame.unionByName, parts)


def registry_round(
    registry: Registry,
    jobs: DataFrame,
    discovered: DataFrame,
    fetched: DataFrame,
    as_of: Column,
    adapters: Sequence[SourceAdapter] = BUILT_IN,
    attempted: int = 0,
    batch: int = frontier.BATCH,
    max_urls: int = frontier.MAX_URLS,
    target: int = frontier.TARGET_UNITS,
    newest: DataFrame | None = None,
) -> Round:
    """Fill the registry: unseen urls up to the caps, ingested and linked, until ``target`` units.

    ``discovered``: source, url, seq. A registry at its target plans nothing and only counts.
    The round has one job of its own (source ``all``, query ``registry``), whose counters
    are replaced and which pauses at its target. With ``newest`` of the round that left the registry, postings it
    holds are not merged, linked or compared again: those planned are none of them.
    """
    before = registry.units
    plan = stage(
        frontier.plan_frontier(
            discovered, registry.listings, batch=batch, max_urls=max_urls, attempted=attempted,
            units=before.count(), target=target,
        ),
        "plan",
    )
    batches = _ingest(plan, fetched, adapters)
    run = None
    if newest is None:
        after, changes, newest = run_batch_newest(registry, batches, as_of)
    else:
        run = run_unseen(registry, newest, batches, as_of)
        after, changes, newest = _with_run(registry, run), run.changes, run.newest
    added = after.units.join(before.select("unit_id"), "unit_id", "left_anti").select(F.lit(True).alias("founds_unit"))
    stats = stage(frontier.run_stats(discovered, plan, _outcomes(batches), before, added), "stats")
    task = stats.select(F.lit("all").alias("source"), F.lit("registry").alias("query"))
    given = stage(frontier.assign_jobs(task, jobs, frontier.MODE_REGISTRY), "jobs")
    opened = frontier.open_jobs(given, jobs, as_of, frontier.MODE_REGISTRY, target)
    totals = stats.withColumns({"job_id": F.lit(given.first().job_id), "updated_at": as_of})
    return Round(after, frontier.set_job_counts(opened, totals), changes, stats, newest, run)


def _with_run(registry: Registry, run: UnseenRun) -> Registry:
    return Registry(
        join_raw(registry.raw, [run.raw]), registry.listings.unionByName(run.listings), run.units,
        registry.postings.unionByName(run.postings),
    )


#: Rounds of one fill at most.
MAX_ROUNDS = 10
NEWEST = "unit_id string, newest_id string"


class RoundLedger:
    """Finished rounds of one fill, below a folder.

    ``round=n`` holds the tables a round left, ``done/round=n`` its row of counts, written last: a round
    without that row never happened, and running it again overwrites what it had begun. Of tables that only
    grow (``GROWING``) a round after the first holds what it added, so a row is not written again by each round.
    """

    TABLES = {
        "raw": RAW_LISTINGS, "listings": LISTINGS, "units": UNITS, "postings": POSTINGS, "jobs": CRAWL_JOBS, "changes": CHANGE_LOG,
        "newest": NEWEST,
    }
    GROWING = ("raw", "listings", "postings")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        spark.createDataFrame([], ROUND_STATS).write.mode("ignore").parquet(f"{root}/done/round=0")

    def finished(self) -> list[Row]:
        """Counts of the rounds so far, in order; at most ``MAX_ROUNDS`` rows."""
        return self.spark.read.schema(f"{ROUND_STATS}, round int").parquet(f"{self.root}/done").orderBy("round").collect()

    def read(self, number: int, table: str) -> DataFrame:
        """A table as a round left it."""
        first = 1 if table in self.GROWING else number
        reader = self.spark.read.schema(self.TABLES[table])
        paths = [f"{self.root}/round={n}/{table}" for n in range(first, number + 1)]
        if table == "raw" and len(paths) > 1:  # a url that could not be read is fetched again
            return join_raw(reader.parquet(paths[0]), [reader.parquet(p) for p in paths[1:]])
        return reader.parquet(*paths)

    def registry(self, number: int) -> Registry:
        return Registry(*[self.read(number, t) for t in ("raw", "listings", "units", "postings")])

    def changes(self) -> DataFrame:
        """Change records of all finished rounds."""
        parts = [self.read(r.round, "changes") for r in self.finished()]
        return reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], CHANGE_LOG))

    def save(self, number: int, done: Round) -> None:
        tables = {**vars(done.registry), "jobs": done.jobs, "changes": done.changes, "newest": done.newest}
        if number > 1:
            tables.update({name: getattr(done.added, name) for name in self.GROWING})
        for name, schema in self.TABLES.items():
            columns = [c.split()[0] for c in schema.split(",")]
            tables[name].select(*columns).write.mode("overwrite").parquet(f"{self.root}/round={number}/{name}")
        done.stats.write.mode("overwrite").parquet(f"{self.root}/done/round={number}")


def fill_registry(
    ledger: RoundLedger,
    registry: Registry,
    jobs: DataFrame,
    discovered: DataFrame,
    fetched: DataFrame,
    as_of: Column,
    adapters: Sequence[SourceAdapter] = BUILT_IN,
    batch: int = frontier.BATCH,
    max_urls: int = frontier.MAX_URLS,
    target: int = frontier.TARGET_UNITS,
    max_rounds: int = MAX_ROUNDS,
) -> Round:
    """Repeat registry rounds until the target, the url cap or ``max_rounds``, or until nothing is left to visit.

    ``registry`` and ``jobs`` are those before the first round; a fill whose ledger holds finished rounds
    goes on after the last of them. The counts, and the job's counters, are those of all rounds. Urls that could not
    be read stay unseen and are planned again, so they use up the cap.
    """
    task = discovered.sparkSession.createDataFrame([("all", "registry")], "source string, query string")
    job = frontier.assign_jobs(task, jobs, frontier.MODE_REGISTRY).first().job_id
    before = registry.units.count()
    unlinked = not (registry.listings.isEmpty() and registry.postings.isEmpty())
    newest = None if unlinked else discovered.sparkSession.createDataFrame([], NEWEST)
    while True:
        rounds = ledger.finished()
        if rounds:
            registry, jobs, newest = ledger.registry(rounds[-1].round), *[ledger.read(rounds[-1].round, t) for t in ("jobs", "newest")]
        attempted = sum(r.new_urls for r in rounds)
        units = rounds[-1].ending_units if rounds else before
        over = bool(rounds) and not rounds[-1].new_urls
        if over or len(rounds) >= max_rounds or attempted >= max_urls or units >= target:
            break
        done = registry_round(
            registry, jobs, discovered, fetched, as_of, adapters, attempted=attempted, batch=batch, max_urls=max_urls, target=target,
            newest=newest,
        )
        ledger.save(len(rounds) + 1, done)
    names = ("discovered", "new_urls", "ingested", "errors", "units_added")
    total = {n: sum(r[n] for r in rounds) for n in names}
    stats = discovered.sparkSession.createDataFrame(
        [(before, *[total[n] for n in names], before + total["units_added"])], ROUND_STATS
    )
    if rounds:
        jobs = frontier.set_job_counts(jobs, stats.withColumns({"job_id": F.lit(job), "updated_at": as_of}))
    return Round(registry, jobs, ledger.changes(), stats)


def targeted_round(
    registry: Registry,
    jobs: DataFrame,
    searches: DataFrame,
    discovered: DataFrame,
    fetched: DataFrame,
    as_of: Column,
    adapters: Sequence[SourceAdapter] = BUILT_IN,
    cap: int = frontier.PER_SEARCH,
) -> Round:
    """Follow saved searches: a task per active search and source, its unseen urls, its job's counters added.

    ``discovered``: search_id, source, url, seq. A unit counts for each job that planned the
    url of one of its postings.
    """
    tasks = frontier.plan_searches(searches, [a.name for a in adapters])
    given = stage(frontier.assign_jobs(tasks, jobs), "tasks")
    opened = frontier.open_jobs(given, jobs, as_of)
    plan = stage(frontier.plan_targeted(tasks, discovered, registry.listings, cap=cap), "plan")
    batches = _ingest(plan, fetched, adapters)
    after, changes = run_batch(registry, batches, as_of)

    task = ["search_id", "source"]
    job_of = given.select(*task, "job_id")
    planned = plan.select(*task, F.col("url").alias("source_url")).join(job_of, task)
    new_units = after.units.join(registry.units.select("unit_id"), "unit_id", "left_anti").select("unit_id")
    posted = (
        after.postings.join(new_units, "unit_id")
        .join(after.listings.select("listing_id", "source", "source_url"), "listing_id")
        .select("unit_id", "source", "source_url")
    )
    key = ["source", "source_url"]
    good = _outcomes(batches).filter(F.col("error").isNull()).select(*key)
    zero = F.lit(0).cast("bigint")
    found = discovered.join(job_of, task).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    taken = planned.join(good, key).groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))
    units = planned.join(posted, key).groupBy("job_id").agg(F.countDistinct("unit_id").alias("n"))
    names = ("discovered", "ingested", "units_added")
    deltas = reduce(
        DataFrame.unionByName,
        [
            counts.select("job_id", *[F.col("n").alias(c) if c == name else zero.alias(c) for c in names])
            for name, counts in zip(names, (found, taken, units))
        ],
    )
    return Round(after, frontier.add_job_counts(opened, deltas, as_of), changes)
