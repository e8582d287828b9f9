"""Continuous import and running first/last-seen state."""

from __future__ import annotations

from datetime import datetime, timedelta
from pathlib import Path

import pytest

from rentweave.operators.merge import keyed_upsert
from rentweave.schemas import PAGES
from rentweave.session import dropping_stages, stage
from rentweave.sources.adapters import SourceRegistry
from rentweave.streaming.keyed_table import KeyedTable
from rentweave.streaming.page_import import RegistryFolder, import_pages, read_landing, stream_first_last_seen

T0 = datetime(2026, 1, 1)


def page(unit, rent, lng="-73.9"):
    return (
        f'<html><head><meta name="ICBM" content="40.7,{lng}"></head><h1>5 West Street #{unit}</h1>'
        f'<h4 class="PriceInfo_price">${rent}</h4><p>2 beds</p><p>1 bath</p></html>'
    )


def land(spark, folder, rows):
    spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(folder))


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_import_stream(spark, tmp_path):
    landing, registry = tmp_path / "landing", RegistryFolder(spark, str(tmp_path / "registry"))
    (adapter,) = SourceRegistry().route("building_pages")

    def run():
        stream = read_landing(spark, str(landing))
        drain(import_pages(stream, registry, adapter, str(tmp_path / "checkpoint")).start())

    land(
        spark, landing,
        [("https://h/1", 200, page("1A", 1000), T0), ("https://h/2", 200, page("1a", 1100), T0 + timedelta(hours=1)), (None, 200, "x", T0)],
    )
    run()
    assert registry.read("listings", 0).count() == 2
    assert registry.read("units", 0).count() == 1
    scores = {r.match_score for r in registry.read("postings", 0).collect()}
    assert scores == {100.0}
    changes = [(r.kind, r.old_value, r.new_value) for r in registry.changes().collect()]
    assert changes == [("price_change", "1000", "1100")]
    refused = spark.read.parquet(str(tmp_path / "registry" / "refused" / "batch=0")).collect()
    assert [r.reject_reason for r in refused] == ["missing url"]

    land(
        spark, landing,
        [("https://h/1", 200, page("1A", 900), T0 + timedelta(days=1)), ("https://h/3", 200, page("9Z", 800, "-73.8"), T0 + timedelta(days=1))],
    )
    run()
    listings = {r.source_url: (r.rent_gross, r.first_seen_at, r.last_seen_at) for r in registry.read("listings", 1).collect()}
    assert listings["https://h/1"] == (900, T0, T0 + timedelta(days=1))
    assert len(listings) == 3
    assert registry.read("units", 1).count() == 2
    assert registry.read("postings", 1).count() == 3


def test_batch_touches_few_folders_and_repeats(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v string", ("k",), buckets=32)
    apply = lambda old, new: keyed_upsert(old, new, ("k",), ("seq",), ("v",))
    rows = lambda ids, v: spark.createDataFrame([(i, v, 0) for i in ids], "k int, v string, seq int")
    assert len(table.merge(0, rows(range(1000), "a"), apply)) == 32
    hit = table.merge(1, rows([3, 5000], "b"), apply)
    assert 1 <= len(hit) <= 2
    folders = lambda b: sorted(p.name for p in (tmp_path / "t" / "data" / f"batch={b}").glob("bucket=*"))
    assert folders(1) == sorted(f"bucket={n}" for n in hit)
    want = {**{i: "a" for i in range(1000)}, 3: "b", 5000: "b"}
    assert {r.k: r.v for r in table.read(1).collect()} == want
    assert table.merge(1, rows([3, 5000], "b"), apply) == hit  # the batch again
    assert {r.k: r.v for r in table.read(1).collect()} == want and table.read(1).count() == 1001
    assert {r.k: r.v for r in table.read(0).collect()} == {i: "a" for i in range(1000)}  # readers of the batch before
    assert table.merge(2, rows([], "c"), apply) == [] and table.read(2).count() == 1001


def test_replayed_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """The stream fails after the tables are written, starts again and runs the batch anew."""
    landing, registry = tmp_path / "landing", RegistryFolder(spark, str(tmp_path / "registry"), buckets=16)
    (adapter,) = SourceRegistry().route("building_pages")
    start = lambda: import_pages(read_landing(spark, str(landing)), registry, adapter, str(tmp_path / "checkpoint")).start()
    land(spark, landing, [(f"https://h/{i}", 200, page(f"{i}A", 1000 + i, f"-73.{i:02}"), T0 + timedelta(hours=i)) for i in range(10, 60)])
    drain(start())
    land(spark, landing, [("https://h/10", 200, page("10A", 1500, "-73.10"), T0 + timedelta(days=9)), ("https://h/99", 200, page("99A", 1, "-73.99"), T0 + timedelta(days=9))])
    state = lambda: {t: sorted(map(str, registry.read(t, 1).collect())) for t in registry.tables}
    write, kept = RegistryFolder.write_batch, []

    def fails(self, name, batch, df):
        write(self, name, batch, df)
        if name == "changes":
            kept.append(state())
            raise OSError("lost")

    monkeypatch.setattr(RegistryFolder, "write_batch", fails)
    query = start()
    with pytest.raises(Exception, match="lost"):
        query.processAllAvailable()
    monkeypatch.undo()
    drain(start())
    assert kept == [state()] and len(kept[0]["units"]) == 51 and registry.changes().count() == 1
    rewritten = {t: {n for n, b in registry.tables[t].live(1).items() if b == 1} for t in registry.tables}
    assert all(1 <= len(n) <= 2 for n in rewritten.values())


def test_batch_leaves_only_the_registry(spark, tmp_path):
    """What a batch stages on the way goes with it, whether it ends well or not; tables are zstd."""
    staged = lambda: {p.name for p in Path(spark.conf.get("spark.checkpoint.dir")).iterdir()}
    landing, registry = tmp_path / "landing", RegistryFolder(spark, str(tmp_path / "registry"), buckets=4)
    (adapter,) = SourceRegistry().route("building_pages")
    land(spark, landing, [(f"https://h/{i}", 200, page(f"{i}A", 1000 + i, f"-73.{i:02}"), T0) for i in range(10, 20)])
    before = staged()
    drain(import_pages(read_landing(spark, str(landing)), registry, adapter, str(tmp_path / "checkpoint")).start())
    assert staged() == before and registry.read("postings", 0).count() == 10
    assert all(p.name.endswith(".zstd.parquet") for p in (tmp_path / "registry" / "raw" / "data").rglob("*.parquet"))
    with pytest.raises(ValueError), dropping_stages(spark):
        assert stage(spark.range(3), "lost").count() == 3 and staged() != before
        raise ValueError
    assert staged() == before
    kept = stage(spark.range(3), "kept")
    assert kept.count() == 3


def test_first_last_seen_stream_equals_batch(spark, tmp_path):
    from rentweave.operators.history import first_last_seen

    ddl = "source string, source_url string, ts timestamp_ntz"
    rows = [("s", f"u{i % 3}", T0 + timedelta(minutes=i * 7 % 50)) for i in range(60)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, ddl).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    seen = {}

    def collect(batch, _):
        for r in batch.collect():
            seen[(r.source, r.source_url)] = (r.first_seen_at, r.last_seen_at)

    drain(stream_first_last_seen(stream, ["source", "source_url"], "ts").foreachBatch(collect).option("checkpointLocation", str(tmp_path / "cp")).start())
    batch = first_last_seen(spark.createDataFrame(rows, ddl), ["source", "source_url"], "ts").collect()
    assert seen == {(r.source, r.source_url): (r.first_seen_at, r.last_seen_at) for r in batch}
