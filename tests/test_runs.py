"""Whole runs: golden postings through ingest, linkage, refresh and freshness."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_linkage import CLASSIFIED, STRUCTURED

from rentweave.operators.ingest import ingest_batch
from rentweave.operators.registry import append_changes
from rentweave.plans.rounds import RoundLedger, fill_registry, registry_round, targeted_round
from rentweave.plans.run import Registry, run_batch
from rentweave.schemas import CRAWL_JOBS, LISTINGS, POSTINGS, RAW_LISTINGS, SAVED_SEARCHES, UNITS
from rentweave.sources.adapters import SourceRegistry

T0 = datetime(2026, 2, 1)
# Location texts of the classifieds records.
LOCATIONS = {
    "cl-001": "245 E 7th St Apt 3A", "cl-002": "156 N 4th St, Unit 5B", "cl-003": "31-15 Broadway",
    "cl-004": "487 Fifth Ave, Apt 1", "cl-005": "280 W 135th Street",
}


def raw(spark, records, hours):
    rows = [
        (f"file:///{key}.json", key, 200, json.dumps(body) if body is not None else '{"cut', T0 + timedelta(hours=hours), i)
        for i, (key, body) in enumerate(records)
    ]
    return spark.createDataFrame(
        rows, "source_url string, source_listing_id string, http_status int, raw_content string, seen_at timestamp_ntz, seq int"
    )


def batches(spark):
    structured = [
        (r[0], dict(title=r[0], address=r[1], unit=r[2], lat=r[3], lng=r[4], bedrooms=r[5], bathrooms=r[6], rent=r[7], brokerFee=r[8], borough="queens"))
        for r in STRUCTURED
    ] + [("broken", None)]
    classified = [
        (r[0], dict(post_title=r[0], location=LOCATIONS[r[0]], latitude=r[3], longitude=r[4], br=r[5], ba=r[6], price=r[7],
                    fee="broker fee" if r[8] else "no fee"))
        for r in CLASSIFIED
    ]
    one, two = SourceRegistry().route("structured_json,classified_json")
    return [ingest_batch(raw(spark, structured, 0), one), ingest_batch(raw(spark, classified, 1), two)]


def empty(spark):
    return Registry(*[spark.createDataFrame([], s) for s in (RAW_LISTINGS, LISTINGS, UNITS, POSTINGS)])


def test_golden_run_and_rerun(spark, tmp_path):
    both = batches(spark)
    stats = [tuple(b.stats.collect()[0]) for b in both]
    assert stats == [("structured_json", 5, 1), ("classified_json", 5, 0)]
    assert [r.error for r in both[0].errors.collect()] == ["malformed json"]

    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    registry, changes = run_batch(empty(spark), both, now)
    assert (registry.raw.count(), registry.listings.count(), registry.units.count(), registry.postings.count()) == (11, 10, 9, 10)
    log = [(c.kind, c.old_value, c.new_value, json.loads(c.payload)) for c in changes.collect()]
    assert log == [("price_change", "4600", "4500", {"oldRentGross": 4600, "newRentGross": 4500})]
    units = {u.canonical_address: u for u in registry.units.collect()}
    assert units["156 n 4th st"].best_rent_gross == 4600
    assert {u.active_state for u in units.values()} == {"unknown"}

    for run in ("one", "one"):
        append_changes(changes, str(tmp_path / "log"), run)
    again, more = run_batch(registry, both, now)
    assert more.count() == 0
    for name in ("listings", "units", "postings"):
        before, after = getattr(registry, name), getattr(again, name)
        assert sorted(map(str, before.collect())) == sorted(map(str, after.collect()))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def fetched_and_found(spark):
    """The golden records as fetched content, and their urls as discovered."""
    both = batches(spark)
    rows = [
        (b.stats.first().source, r.source_url, r.source_listing_id, r.http_status, r.raw_content, r.fetched_at, r.seq)
        for b in both for r in b.raw.collect()
    ]
    fetched = spark.createDataFrame(
        rows, "source string, source_url string, source_listing_id string, http_status int, raw_content string, seen_at timestamp_ntz, seq int"
    )
    return fetched, fetched.select("source", F.col("source_url").alias("url"), "seq")


def test_registry_rounds(spark):
    fetched, found = fetched_and_found(spark)
    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    jobs = spark.createDataFrame([], CRAWL_JOBS)
    adapters = SourceRegistry().route("structured_json,classified_json")
    one = registry_round(empty(spark), jobs, found, fetched, now, adapters, batch=3, target=8)
    assert one.stats.first().asDict() == {
        "starting_units": 0, "discovered": 11, "new_urls": 6, "ingested": 6, "errors": 0, "units_added": 5, "ending_units": 5
    }
    two = registry_round(one.registry, one.jobs, found, fetched, now, adapters, batch=3, target=8)
    (job,) = two.jobs.collect()
    assert (job.source, job.mode, job.status, job.discovered, job.ingested, job.units_added) == (
        "all", "seed_registry", "paused", 11, 4, 4
    )
    assert two.registry.units.count() == 9
    three = registry_round(two.registry, two.jobs, found, fetched, now, adapters, batch=3, target=8)
    assert three.stats.first().new_urls == 0 and three.registry.units.count() == 9


def test_fill_goes_on_where_it_was_lost(spark, tmp_path, monkeypatch):
    """A fill that is lost while it writes its second round ends like one that was not."""
    fetched, found = fetched_and_found(spark)
    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    jobs = spark.createDataFrame([], CRAWL_JOBS)
    adapters = SourceRegistry().route("structured_json,classified_json")

    def fill(name):
        ledger = RoundLedger(spark, str(tmp_path / name))
        return ledger, fill_registry(ledger, empty(spark), jobs, found, fetched, now, adapters, batch=3, max_urls=20, target=8)

    def state(done):
        tables = {**vars(done.registry), "jobs": done.jobs, "changes": done.changes, "stats": done.stats}
        return {n: sorted(map(str, t.collect())) for n, t in tables.items()}

    ledger, whole = fill("whole")
    want = state(whole)
    assert [r.new_urls for r in ledger.finished()] == [6, 5] and whole.registry.units.count() == 9
    stats = whole.stats.first().asDict()
    assert stats.pop("errors") + stats.pop("ingested") == 11
    assert stats == {"starting_units": 0, "discovered": 22, "new_urls": 11, "units_added": 9, "ending_units": 9}
    (job,) = whole.jobs.collect()
    assert (job.status, job.discovered, job.units_added) == ("paused", 22, 9)

    save = RoundLedger.save

    def lost(self, number, done):
        if number == 2:
            done.registry.units.limit(1).write.parquet(f"{self.root}/round=2/units")
            raise OSError("lost")
        save(self, number, done)

    monkeypatch.setattr(RoundLedger, "save", lost)
    with pytest.raises(OSError, match="lost"):
        fill("lost")
    monkeypatch.undo()
    ledger, again = fill("lost")
    assert state(again) == want and len(ledger.finished()) == 2
    assert state(fill("lost")[1]) == want  # a finished fill does nothing


def test_rounds_of_a_fill_add_only_what_is_new(spark, tmp_path):
    """a round after the first stores and links its own postings; the fill ends as rounds over everything do."""
    known = "source string, source_url string, source_listing_id string, http_status int, raw_content string, seen_at timestamp_ntz, seq int"
    day = [None, T0, T0, T0 + timedelta(days=1), T0, None, T0 + timedelta(days=2)]  # ties and unknown times within one home

    def body(k):
        if k % 11 == 5:
            return '{"cut'  # stays unseen and is fetched by every round
        return json.dumps(dict(address=f"{k % 4} West Street", unit="1A", rent=1000 + k, brokerFee=k % 3 == 0))

    rows = [("structured_json", f"u{k}", f"{k}", 200, body(k), day[k % 7], k) for k in range(44)]
    fetched = spark.createDataFrame(rows, known)
    found = fetched.select("source", F.col("source_url").alias("url"), "seq")
    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    jobs, adapters = spark.createDataFrame([], CRAWL_JOBS), SourceRegistry().route("structured_json")

    def tables(registry):
        return {n: sorted(str(r.asDict()) for r in t.collect()) for n, t in vars(registry).items()}

    given = registry_round(empty(spark), jobs, found, fetched.where("seq < 9"), now, adapters, batch=9, max_urls=99, target=99).registry
    for start, name in ((empty(spark), "empty"), (given, "given")):
        ledger = RoundLedger(spark, str(tmp_path / name))
        done = fill_registry(ledger, start, jobs, found, fetched, now, adapters, batch=12, max_urls=99, target=99, max_rounds=4)
        plain, plain_jobs = start, jobs
        for _ in range(4):
            one = registry_round(plain, plain_jobs, found, fetched, now, adapters, batch=12, max_urls=99, target=99)
            plain, plain_jobs = one.registry, one.jobs
        assert tables(done.registry) == tables(plain)
        finished = ledger.finished()
        assert len(finished) == 4 and sum(r.errors for r in finished) > 4
        for r in finished[1:]:
            stored = {t: spark.read.parquet(f"{ledger.root}/round={r.round}/{t}").count() for t in ledger.GROWING}
            assert stored == {"raw": r.ingested + r.errors, "listings": r.ingested, "postings": r.ingested}


def test_rows_of_a_round_are_spread_over_tasks(spark, tmp_path, monkeypatch):
    """planned rows that lie in one file of the input are parsed by many tasks."""
    from rentweave.plans import rounds
    from rentweave.session import stage

    staged = []
    monkeypatch.setattr(rounds, "stage", lambda df, name: staged.append(stage(df, name)) or staged[-1])
    rows = spark.range(20000).select(
        F.lit("structured_json").alias("source"), F.concat(F.lit("u"), "id").alias("source_url"), F.col("id").cast("string").alias("source_listing_id"),
        F.lit(200).alias("http_status"), F.sha2(F.col("id").cast("string"), 512).alias("raw_content"), F.lit(T0).cast("timestamp_ntz").alias("seen_at"),
        F.col("id").alias("seq"),
    )
    rows.coalesce(1).write.parquet(str(tmp_path / "fetched"))
    fetched = spark.read.parquet(str(tmp_path / "fetched"))
    plan = fetched.select("source", F.col("source_url").alias("url"))
    (batch,) = rounds._ingest(plan, fetched, SourceRegistry().route("structured_json"))
    assert batch.errors.count() == 20000 and len(staged[0].inputFiles()) > 1


def test_fill_stops_at_its_cap(spark, tmp_path):
    """The broken record stays unseen and is planned again, which uses up the cap."""
    fetched, found = fetched_and_found(spark)
    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    ledger = RoundLedger(spark, str(tmp_path / "fill"))
    done = fill_registry(
        ledger, empty(spark), spark.createDataFrame([], CRAWL_JOBS), found, fetched, now,
        SourceRegistry().route("structured_json,classified_json"), batch=30, target=99, max_urls=12,
    )
    assert [r.new_urls for r in ledger.finished()] == [11, 1] and done.stats.first().errors == 2


def test_targeted_round(spark):
    fetched, found = fetched_and_found(spark)
    now = F.lit("2026-02-10 00:30:00").cast("timestamp_ntz")
    searches = spark.createDataFrame(
        [("a", "A", None, 4000, None, None, None, True, True, T0), ("b", "B", None, None, 2.0, None, None, False, True, T0),
         ("c", "C", None, None, None, None, None, False, False, T0)], SAVED_SEARCHES
    )
    discovered = found.withColumn("search_id", F.when(F.col("seq") < 2, "a").otherwise("b"))
    adapters = SourceRegistry().route("structured_json,classified_json")
    done = targeted_round(empty(spark), spark.createDataFrame([], CRAWL_JOBS), searches, discovered, fetched, now, adapters)
    jobs = {(j.source, "no fee" in j.query): (j.discovered, j.ingested, j.units_added) for j in done.jobs.collect()}
    assert jobs == {
        ("structured_json", True): (2, 2, 2), ("classified_json", True): (2, 2, 2),
        ("structured_json", False): (4, 3, 3), ("classified_json", False): (3, 3, 3),
    }
    again = targeted_round(done.registry, done.jobs, searches, discovered, fetched, now, adapters)
    assert again.jobs.count() == 4
    more = {(j.source, "no fee" in j.query): (j.discovered, j.ingested, j.units_added) for j in again.jobs.collect()}
    assert more[("structured_json", True)][0] == 4 and more[("classified_json", False)] == (6, 3, 3)


def test_a_run_writes_links_once_and_few_columns(spark, monkeypatch):
    """links are merged once, and linking carries only what it reads."""
    from rentweave.operators.registry import LINKED_BY
    from rentweave.plans import run
    from rentweave.session import stage

    staged, merged, upsert = [], [], run.upsert_links
    monkeypatch.setattr(run, "stage", lambda df, name: staged.append((name, tuple(df.columns))) or stage(df, name))
    monkeypatch.setattr(run, "upsert_links", lambda *tables: merged.append(1) or upsert(*tables))
    listings = spark.createDataFrame([], LISTINGS)
    done = run.link_new(listings, spark.createDataFrame([], UNITS), spark.createDataFrame([], POSTINGS), F.lit(None).cast("timestamp_ntz"))
    assert staged == [("todo", LINKED_BY), ("links", ("unit_id", "listing_id", "match_score", "created_at"))]
    assert len(merged) == 1 and done.units.count() == 0
