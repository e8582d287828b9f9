"""Merges, positions, search and detail on small tables, against plain Python."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rentweave.operators import detail, history, merge, ranking, search
from rentweave.operators.frontier import host_schedule, plan_frontier, run_stats
from rentweave.operators.merge import FOLDER_IMPORT_COLUMNS, keyed_upsert, upsert_listings
from rentweave.operators.registry import refresh_units
from rentweave.schemas import LISTINGS, PARSED_FIELDS, POSTINGS, UNITS, column_types
from rentweave.sources.intake import check_pages, check_searches

T0 = datetime(2026, 1, 1)


def table(spark, ddl, rows):
    names = list(column_types(ddl))
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl)


def test_upsert_semantics(spark):
    old = spark.createDataFrame([("k1", "a", "first", "kept")], "k string, v string, ins string, other string")
    batch = spark.createDataFrame(
        [("k1", 1, "b", "x"), ("k1", 2, None, "y"), ("k2", 5, "late", "p"), ("k2", 3, "early", "q")],
        "k string, seq int, v string, ins string",
    )
    both = lambda t: keyed_upsert(t, batch, ("k",), ("seq",), ("v",), ("ins",))
    once = {tuple(r) for r in both(old).collect()}
    assert once == {("k1", None, "first", "kept"), ("k2", "late", "q", None)}
    assert {tuple(r) for r in both(both(old)).collect()} == once


def parsed(spark, rows):
    types = column_types(LISTINGS)
    ddl = "source string, source_url string, seen_at timestamp_ntz, " + ", ".join(f"{c} {types[c]}" for c in PARSED_FIELDS)
    return table(spark, ddl, rows)


def test_listings_keep_first_seen_and_partial_columns(spark):
    empty = spark.createDataFrame([], LISTINGS)
    one = parsed(spark, [dict(source="s", source_url="u", seen_at=T0, title="t", lat=1.0, lng=2.0, rent_gross=5)])
    two = parsed(spark, [dict(source="s", source_url="u", seen_at=T0 + timedelta(days=1), title="t2", images=["i"])])
    full = upsert_listings(upsert_listings(empty, one), two).collect()[0]
    assert (full.first_seen_at, full.last_seen_at, full.lat, full.rent_gross) == (T0, T0 + timedelta(days=1), None, None)
    part = upsert_listings(upsert_listings(empty, one), two, columns=FOLDER_IMPORT_COLUMNS).collect()[0]
    assert (part.title, part.lat, part.rent_gross, part.images) == ("t2", 1.0, None, ["i"])


def test_positions_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, T0 + timedelta(hours=rng.randrange(200))) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp_ntz")
    by_key = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        by_key.setdefault(r[0], []).append(r[1])
    want = {i: n for ids in by_key.values() for n, i in enumerate(ids, 1)}
    order = [F.col("ts"), F.col("i")]
    for most in (ranking.PLAIN_ROWS, 10):  # one window, or a scan because of the hot key
        monkeypatch.setattr(ranking, "PLAIN_ROWS", most)
        got = ranking.number_rows(df, ["k"], order, "n").collect()
        assert {r.i: r.n for r in got} == want
    dense = ranking.dense_position(df, order, "n").collect()
    assert {r.i: r.n for r in dense} == {r[1]: n for n, r in enumerate(sorted(rows, key=lambda r: (r[2], r[1])), 1)}


def test_price_history_crosses_buckets(spark, monkeypatch):
    rng = random.Random(4)
    rows = [("u", i, T0 + timedelta(hours=7 * i), rng.choice([1, 2, None])) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp_ntz, price int")
    want, last = [], None
    for _, i, _, p in rows:
        if p is None:
            continue
        if last is not None and p != last:
            want.append((i, last, p))
        last = p
    for most in (ranking.PLAIN_ROWS, 10):
        monkeypatch.setattr(ranking, "PLAIN_ROWS", most)
        got = history.price_history(df, ["k"], "ts", "i", "price").collect()
        assert sorted((r.i, r.old_price, r.new_price) for r in got) == want


@pytest.fixture
def many_sort_partitions(spark, monkeypatch):
    """Small sort partitions stay apart and keys are hot, as large ones would."""
    monkeypatch.setattr(ranking, "PLAIN_ROWS", 0)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_scans_cross_sort_partitions(spark, many_sort_partitions):
    """One key has almost all rows, all on one day or with one place in the order; null keys are a key."""
    rng = random.Random(5)
    rows = [("hot" if i % 50 else rng.choice(["a", None]), i, T0, rng.choice([1, 2, 3])) for i in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp_ntz, price int")
    want, last, n, seen = [], {}, {}, {}
    for k, i, _, p in sorted(rows, key=lambda r: r[1]):
        n[k] = seen[i] = n.get(k, 0) + 1
        if k in last and last[k] != p:
            want.append((i, last[k], p))
        last[k] = p
    assert {r.i: r.n for r in ranking.number_rows(df, ["k"], [F.col("ts"), F.col("i")], "n").collect()} == seen
    got = history.price_history(df, ["k"], "ts", "i", "price").collect()
    assert sorted((r.i, r.old_price, r.new_price) for r in got) == sorted(want)
    placed, carried = ranking._segments(df, ["k"], [F.col("ts"), F.col("i")])
    sizes = sorted(r["count"] for r in placed.groupBy("_part").count().collect())
    assert len(sizes) >= 6 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert carried.count() <= len(sizes)


def test_visits_of_one_host_at_one_place(spark, many_sort_partitions):
    urls = spark.createDataFrame([(f"https://h.example.com/{i:04}", 7) for i in range(3000)], "url string, seq long")
    starts = sorted((r.url, r.start_ms) for r in host_schedule(urls).collect())
    assert [s for _, s in starts] == [1000 * i for i in range(3000)]


@pytest.mark.parametrize("k", [3, ranking.SMALL_K, ranking.SMALL_K + 1, 250])
def test_top_rows_either_way(spark, many_sort_partitions, k):
    rows = [(None if i % 7 == 0 else "hot" if i % 5 else "few", (i * 37) % 1000) for i in range(1000)]
    got = ranking.top_rows(spark.createDataFrame(rows, "k string, v int"), ["k"], [F.col("v")], k, "n").collect()
    want = {(key, v, n) for key in (None, "hot", "few") for n, v in enumerate(sorted(v for x, v in rows if x == key)[:k], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_merge_passes_other_keys_without_a_shuffle(spark, tmp_path, monkeypatch):
    """Also with a filter so small that most stored keys hit it by chance; null keys are keys."""
    rows = [(i, f"s{i % 3}" if i % 10 else None, f"v{i}") for i in range(2000)]
    spark.createDataFrame(rows, "k int, s string, v string").write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    # keys of another width than the table's
    batch = spark.createDataFrame([(i, f"s{i % 3}" if i % 10 else None, "new", i) for i in range(1990, 2010)], "k long, s string, v string, seq int")
    merged = keyed_upsert(stored, batch, ("k", "s"), ("seq",), ("v",))
    want = {(k, s, v) for k, s, v in rows if k < 1990} | {(i, f"s{i % 3}" if i % 10 else None, "new") for i in range(1990, 2010)}
    assert {tuple(r) for r in merged.collect()} == want
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    marked = merge.mark_touched(stored, merge.key_filter(batch, ("k", "s"), dict(stored.dtypes)), ("k", "s")).filter("not _touched")
    assert "hashpartitioning(k" not in marked._jdf.queryExecution().executedPlan().toString()
    assert marked.count() > 1900
    monkeypatch.setattr(merge, "FILTER_BITS", 64)
    assert {tuple(r) for r in keyed_upsert(stored, batch, ("k", "s"), ("seq",), ("v",)).collect()} == want


def units(spark, rows):
    return table(spark, UNITS, [{"last_seen_at": T0, "created_at": T0, "active_state": "active", **r} for r in rows])


def test_search_order_limits_and_images(spark):
    u = units(
        spark,
        [
            dict(unit_id="a", best_rent_gross=1000, bedrooms=1.0, broker_fee=None, borough="Queens"),
            dict(unit_id="b", best_rent_gross=1000, bedrooms=1.0, broker_fee=True, borough="Queens"),
            dict(unit_id="c", best_rent_gross=1000, bedrooms=1.0, broker_fee=False, borough="Queens"),
            dict(unit_id="d", best_rent_gross=None, bedrooms=1.0, borough="Queens"),
            dict(unit_id="e", best_rent_gross=900, bedrooms=None, borough="Queens"),
            dict(unit_id="f", best_rent_gross=900, bedrooms=1.0, borough="queens"),
        ],
    )
    postings = table(spark, POSTINGS, [dict(unit_id="a", listing_id="l1"), dict(unit_id="a", listing_id="l2")])
    listings = table(
        spark, LISTINGS,
        [dict(listing_id="l1", last_seen_at=T0, images=["old"]), dict(listing_id="l2", last_seen_at=T0 + timedelta(1), images=["new", "x"])],
    )
    found = search.search_units(
        u, postings, listings, no_fee_preferred=True, page=0, limit=1000, max_rent=1000, min_beds=0.5, borough="Queens"
    ).collect()
    assert [(r.unit_id, r.sources_count, r.image_url) for r in found] == [("c", 0, None), ("b", 0, None), ("a", 2, "new")]
    meta = search.search_meta(u, page=-1, limit=2, max_rent=1000).collect()[0]
    assert tuple(meta) == (1, 2, 5, 3)
    assert search.search_units(u, postings, listings, page=4, limit=2).collect() == []


def test_searches_skip_row_groups(spark, tmp_path):
    rng = random.Random(6)
    rows = [
        dict(unit_id=f"u{i:05}", borough=rng.choice("ABCD"), neighborhood=rng.choice("wxyz"), best_rent_gross=rng.randrange(9000), bedrooms=1.0,
             canonical_address="a" * 200 + str(i))
        for i in range(8000)
    ]
    stored = search.write_search_table(units(spark, rows), str(tmp_path / "t"), row_group_bytes=4096)
    hits = search.filter_units(stored, borough="B", neighborhood="x", max_rent=2000)
    want = {r["unit_id"] for r in rows if (r["borough"], r["neighborhood"]) == ("B", "x") and r["best_rent_gross"] <= 2000}
    assert {r.unit_id for r in hits.collect()} == want
    scans = hits._jdf.queryExecution().executedPlan().collectLeaves()
    read = scans.apply(0).metrics().apply("numOutputRows").value()
    assert len(want) <= read < 8000 / 4


def test_saved_searches_against_brute_force(spark):
    rng = random.Random(9)
    pick = lambda *xs: rng.choice(xs)
    us = [
        dict(unit_id=f"u{i:03d}", best_rent_gross=pick(None, -5, 0, 15, 16, 17, 255, 256, 4095, 4096, 2147483647, rng.randrange(9000)),
             bedrooms=pick(None, 0.0, 1.0, 1.5, 3.0), borough=pick("A", "B", None), neighborhood=pick("x", "y", None),
             last_seen_at=T0 + timedelta(hours=rng.randrange(50)), broker_fee=pick(True, False, None))
        for i in range(200)
    ]
    ss = [
        dict(search_id=f"s{i:03d}", max_rent=pick(None, -6, -5, 0, 15, 16, 255, 4096, 2147483647, rng.randrange(9000)),
             min_beds=pick(None, 0.0, 1.2, 3.0), borough=pick("A", "B", None, ""), neighborhood=pick("x", "y", None), is_active=i % 5 != 0,
             no_fee_preferred=pick(True, False, None))
        for i in range(150)
    ]
    searches = table(spark, "search_id string, max_rent int, min_beds double, borough string, neighborhood string, is_active boolean, no_fee_preferred boolean", ss)
    got = {r.search_id: (r.total, r.first_unit_id) for r in search.match_saved_searches(searches, units(spark, us)).collect()}
    want = {}
    for s in ss:
        if not s["is_active"]:
            continue
        hits = [
            u for u in us
            if (s["max_rent"] is None or u["best_rent_gross"] is not None and u["best_rent_gross"] <= s["max_rent"])
            and (s["min_beds"] is None or u["bedrooms"] is not None and u["bedrooms"] >= s["min_beds"])
            and (not s["borough"] or u["borough"] == s["borough"])
            and (not s["neighborhood"] or u["neighborhood"] == s["neighborhood"])
        ]
        fee = lambda u: (2 if u["broker_fee"] is None else int(u["broker_fee"])) if s["no_fee_preferred"] else 0
        hits.sort(key=lambda u: (fee(u), -u["last_seen_at"].timestamp(), u["unit_id"]))
        want[s["search_id"]] = (len(hits), [u["unit_id"] for u in hits])
    assert got == {i: (n, ids[0] if ids else None) for i, (n, ids) in want.items()}
    for first in (1, 7, 20):
        shown: dict = {}
        for r in sorted(search.saved_search_pages(searches, units(spark, us), first).collect(), key=lambda r: r.place or 0):
            total, ids = shown.setdefault(r.search_id, (r.total, []))
            if r.place is not None:
                ids.append(r.unit_id)
                assert (r.place, r.total) == (len(ids), total)
        assert shown == {i: (n, ids[:first]) for i, (n, ids) in want.items()}


def test_refresh_overwrites_with_null_unless_told(spark):
    u = units(spark, [dict(unit_id="a", best_rent_gross=10, bedrooms=2.0, canonical_unit="1"), dict(unit_id="b", best_rent_gross=7)])
    postings = table(spark, POSTINGS, [dict(unit_id="a", listing_id=x) for x in ("l1", "l2")])
    listings = table(
        spark, LISTINGS,
        [dict(listing_id="l1", last_seen_at=T0, rent_gross=11, bedrooms=3.0), dict(listing_id="l2", last_seen_at=T0 + timedelta(1), rent_gross=12)],
    )
    rows = {r.unit_id: r for r in refresh_units(u, postings, listings).collect()}
    assert (rows["a"].best_rent_gross, rows["a"].bedrooms, rows["a"].canonical_unit) == (12, None, "1")
    assert rows["b"].best_rent_gross == 7
    kept = {r.unit_id: r for r in refresh_units(u, postings, listings, keep_known=True).collect()}
    assert kept["a"].bedrooms == 2.0


def test_detail_of_a_unit(spark):
    u = units(spark, [dict(unit_id="a"), dict(unit_id="b")])
    postings = table(spark, POSTINGS, [dict(unit_id="a", listing_id=f"l{i}", match_score=100.0) for i in range(3)])
    listings = table(
        spark, LISTINGS,
        [dict(listing_id=f"l{i}", last_seen_at=T0 + timedelta(i), images=[f"i{i}", "same"] + [f"z{j}" for j in range(6)]) for i in range(3)],
    )
    changes = spark.createDataFrame(
        [("a", f"l{i:02d}", "price_change", T0 + timedelta(i)) for i in range(60)], "unit_id string, listing_id string, kind string, created_at timestamp_ntz"
    )
    one, posted, log = detail.unit_detail(u, postings, listings, changes, "a")
    assert one.count() == 1
    assert [r.listing_id for r in posted.collect()] == ["l2", "l1", "l0"]
    assert [r.listing_id for r in log.collect()] == [f"l{i:02d}" for i in range(59, 9, -1)]
    gallery = detail.unit_gallery(postings, listings).collect()[0].gallery
    assert gallery == ["i2", "same", "z0", "z1", "z2", "z3", "z4", "z5", "i1", "i0"]
    assert detail.unit_postings(u, postings, listings).count() == 4


def test_frontier_stops_at_caps(spark):
    found = spark.createDataFrame([(s, f"https://h/{s}/{i}", i) for s in "ab" for i in range(50)], "source string, url string, seq int")
    listings = spark.createDataFrame([("a", "https://h/a/0")], "source string, source_url string")
    plan = plan_frontier(found, listings, batch=30, max_urls=200, attempted=160).collect()
    assert [(r.source, r.seq) for r in plan] == [("a", i) for i in range(1, 31)] + [("b", i) for i in range(10)]
    assert plan_frontier(found, listings, units=200).count() == 0


def test_intake_reasons(spark):
    pages = spark.createDataFrame([(None, "x"), ("u", ""), ("u", "12345"), ("u", "\U0001f600\U0001f600"), ("u", "1234")], "url string, html string")
    got = [r.reject_reason for r in check_pages(pages, max_html=4).collect()]
    assert got == ["missing url", "missing html", "html too large", None, None]
    saved = spark.createDataFrame([("", "p"), ("n", None), ("n", "p")], "name string, prompt string")
    assert [r.reject_reason for r in check_searches(saved).collect()] == ["missing name", "missing prompt", None]


def test_run_stats(spark):
    found = spark.range(5)
    ingested = spark.createDataFrame([(None,), ("bad",)], "error string")
    links = spark.createDataFrame([(True,), (False,)], "founds_unit boolean")
    row = run_stats(found, spark.range(3), ingested, spark.range(7), links).collect()[0]
    assert row.asDict() == dict(
        starting_units=7, discovered=5, new_urls=3, ingested=1, errors=1, units_added=1, ending_units=8
    )


def test_equal_times_apply_in_order_of_arrival(spark):
    from rentweave.operators.merge import upsert_links

    rows = [("u", f"l{i % 3}", float(i), i) for i in range(30)]
    schema = "unit_id string, listing_id string, match_score double, seq long"
    known = spark.createDataFrame([("u", "l0", -1.0), ("v", "l0", -2.0)], "unit_id string, listing_id string, match_score double")
    noon = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    for order in (rows, rows[::-1]):
        batch = spark.createDataFrame(order, schema).withColumn("created_at", noon)
        got = upsert_links(known.withColumn("created_at", noon), batch)
        assert {(r.unit_id, r.listing_id): r.match_score for r in got.collect()} == {
            ("u", "l0"): 27.0, ("u", "l1"): 28.0, ("u", "l2"): 29.0, ("v", "l0"): -2.0
        }


@pytest.mark.parametrize("k", [3, 5000])
def test_top_rows_at_any_k(spark, k):
    from rentweave.operators.ranking import top_rows

    rows = spark.range(20_000).select(
        F.when(F.col("id") % 4 == 0, F.lit("small")).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.lit("hot")).alias("source"),
        (F.col("id") * 7919 % 20_011).alias("seq"),
    )
    got = top_rows(rows, ["source"], [F.col("seq")], k, "place")
    want: dict = {}
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        want.setdefault(r.source, []).append(r.seq)
    found: dict = {}
    for r in sorted(got.collect(), key=lambda r: r.place):
        found.setdefault(r.source, []).append(r.seq)
        assert r.place == len(found[r.source])
    assert found == {s: v[:k] for s, v in want.items()}


def test_ids_are_made_behind_the_merge(spark):
    """ids made from a row's key are no part of what a merge shuffles."""
    types = column_types(LISTINGS)
    rows = spark.range(1).select(
        F.lit("s").alias("source"), F.lit("u").alias("source_url"), F.lit(0).cast("timestamp").cast("timestamp_ntz").alias("seen_at"),
        *[F.lit(None).cast(types[c]).alias(c) for c in PARSED_FIELDS],
    )
    merged = upsert_listings(spark.createDataFrame([], LISTINGS), rows)
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan and "sha2" not in plan[plan.index("max_by(") :]
    (row,) = merged.collect()
    assert len(row.listing_id) == 64 == len(row.raw_id) and row.listing_id != row.raw_id


def test_blocks_hold_the_newest_units_of_their_rents(spark):
    """a level is made from the cut level below it, and holds what a cut of all units would."""
    rng = random.Random(3)
    units = spark.createDataFrame(
        [(rng.choice(["a", "b", None]), rng.choice(["h", None]), rng.choice([None, *range(1000, 1600)]), rng.choice([1.0, None]),
          rng.randrange(2), rng.randrange(50), f"u{i}") for i in range(1500)],
        "borough string, neighborhood string, best_rent_gross int, bedrooms double, fee int, age int, unit_id string",
    )
    alike, newest = ["borough", "neighborhood", "bedrooms", "fee"], [F.col("age"), F.col("unit_id")]
    few = ranking.top_rows(units, [*alike, "best_rent_gross"], newest, 2, "place").drop("place")
    held = search._in_blocks(few, 2)
    every = units.withColumn("block", F.explode(search._blocks_holding(F.col("best_rent_gross"))))
    cut = lambda df: sorted(
        (str(r.block), r.unit_id) for r in ranking.top_rows(df, [*alike, "block"], newest, 2, "place").collect()
    )
    assert cut(held) == cut(every)
    assert held.count() < 0.7 * few.withColumn("block", F.explode(search._blocks_holding(F.col("best_rent_gross")))).count()
