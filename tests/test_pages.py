"""Page parsers on hand-written pages, folder readers and the source registry."""

from __future__ import annotations

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rentweave.plans.queries_sources import sublet_pages_view
from rentweave.sources.adapters import SourceAdapter, SourceRegistry
from rentweave.sources.adapters import discovered_by_source
from rentweave.sources.building_page import parse_building_pages, parse_with_page_meta, with_page_meta
from rentweave.sources.files import parse_html_folder, read_html_folder, read_json_folder
from rentweave.sources.html import all_attrs, all_text, first_attr, first_text, shred, shred_pages, tagged
from rentweave.sources.links import discover_links
from rentweave.sources.sublet_page import parse_sublet_pages

SUBLET = """<!doctype html><html><head><title>Page | LeaseBreak.com</title></head><body>
<h2> 12 Oak Street </h2>
<div class="title-detail-apartments-text">east village, MANHATTAN</div>
<div class="outer"><div><span class="title-icon">Bedrooms</span><span class="nums-icon">2 br</span><span class="nums-icon">9</span></div>
<div><span class="title-icon">Bathrooms</span><b class="nums-icon">1.5</b></div>
<div><span class="title-icon">Move-In</span><i class="date-icon">Mar 1</i></div>
<div><span class="title-icon">Move-Out</span></div></div>
<h3>Pricing Based on Lease Term (gross)</h3>
<table><tr><th>Term<th>Rent<tr><td>8 months<td>$3,100<tr><td>5 Months<td>$3,300<tr><td>0 months<td>x</table>
<table><tr><td>other</td></tr><tr><td>1 month</td><td>$1</td></tr></table>
<span class="listing-details-value">Owner is not charging a brokerage fee</span>
<h2>Property Details</h2><p>Bright &amp; quiet.</p><div>Second <b>part</b></div>
<h2>Features</h2><p>skipped</p><ul><li>Elevator<li>Laundry in Building<li>Washer / Dryer in Unit<li>Cats only<li></ul>
<ul><li>Doorman</ul>
<img src="https://images.leasebreak.com/uploads/1.jpg"><img src="https://images.leasebreak.com/x.png"><img src=" ">
</body></html>"""

BUILDING = """<html><head><title>350 East 52nd #2G in Turtle Bay, Manhattan | Site</title>
<meta name="ICBM" content="40.75, -73.96"><script>var a = "<p>studio</p>";</script></head><body>
<h1>350 East 52nd Street #2G</h1>
<div class="x AboutBuildingSection_address__1">350 E 52nd St, New York, NY</div>
<h4 class="PriceInfo_price__q">from $4,200</h4><p>$4,000 net effective rent</p><p>2 beds</p><p>1.5 baths</p>
<p>{first}</p><p>{second}</p><p>Similar Homes {long}</p>
<p>You can't be charged a broker fee</p><p>Washer/dryer in unit, laundry in building, elevator</p>
<img src="https://p.zillowstatic.com/a.jpg"><img src="https://streeteasy.com/icon.png"><img>
</body></html>""".format(first="a" * 120, second="b" * 120, long="c" * 300)


def one(df):
    (row,) = df.collect()
    return row.asDict()


def pages(spark, html):
    return spark.createDataFrame([("u1", html)], "url string, html string")


def test_sublet_page(spark):
    row = one(parse_sublet_pages(pages(spark, SUBLET)))
    assert row == dict(
        url="u1", title="12 Oak Street", address="12 Oak Street", unit=None, neighborhood="East Village", borough="Manhattan",
        lat=None, lng=None, rent_gross=3100, rent_net=None, bedrooms=2.0, bathrooms=1.5, broker_fee=False, lease_term_months=5,
        move_in_notes="Move-In Mar 1", pet_policy="cats_only", laundry="in_unit", elevator=True, doorman=None,
        images=["https://images.leasebreak.com/uploads/1.jpg"],
        description="Bright & quiet.\nSecond part\n\nFeatures: Elevator, Laundry in Building, Washer / Dryer in Unit, Cats only",
    )


def test_sublet_page_without_anything(spark):
    row = one(parse_sublet_pages(pages(spark, "<title>X | LeaseBreak.com</title><p>now $ 900 / mo")))
    assert (row["title"], row["rent_gross"], row["neighborhood"], row["description"], row["images"]) == ("X", 900, None, None, [])
    assert all(row[c] is None for c in ("bedrooms", "broker_fee", "lease_term_months", "elevator", "move_in_notes"))
    assert one(parse_sublet_pages(pages(spark, "")))["title"] == "Unknown"


def test_building_page(spark):
    row = one(parse_building_pages(pages(spark, BUILDING)))
    assert row == dict(
        url="u1", title="350 East 52nd Street #2G", address="350 E 52nd St", unit="2G", neighborhood="Turtle Bay",
        borough="Manhattan", lat=40.75, lng=-73.96, rent_gross=4200, rent_net=4000, bedrooms=2.0, bathrooms=1.5,
        broker_fee=False, lease_term_months=None, move_in_notes=None, pet_policy=None, laundry="in_unit", elevator=True,
        doorman=None, description="a" * 120, images=["https://p.zillowstatic.com/a.jpg"],
    )


def test_building_page_fallbacks_and_meta(spark):
    html = "<title></title><h2>Explore Astoria</h2><h3>$400</h3><h2>Now $2,500</h2>Queens rentals. Studio, 1 bath. Broker fee."
    row = one(parse_building_pages(pages(spark, html)))
    assert (row["title"], row["neighborhood"], row["borough"], row["rent_gross"]) == ("Unknown", "Astoria", "Queens", 2500)
    assert (row["bedrooms"], row["bathrooms"], row["broker_fee"], row["lat"]) == (0.0, 1.0, True, None)
    meta = spark.createDataFrame(
        [("u1", None, "9 Elm #4 in Harlem, manhattan | Site", ["m1"], "40.8;0", "1,2")],
        "url string, title string, og_title string, og_images array<string>, geo_position string, icbm string",
    )
    row = one(parse_building_pages(with_page_meta(pages(spark, html), meta)))
    assert (row["title"], row["unit"], row["address"]) == ("9 Elm #4", "4", "9 Elm")
    assert (row["neighborhood"], row["borough"], row["lat"], row["lng"], row["images"]) == ("Harlem", "manhattan", 40.8, None, ["m1"])


def exchanged(df):
    """Columns that cross an exchange of a plan."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    parts = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]", plan)
    assert parts
    return {c.strip().split("#")[0] for p in parts for c in p.split(",")}


@pytest.mark.parametrize("kind", ["array<string>", "string"])
def test_page_meta_joins_parsed_fields(spark, kind):
    """The same as with the metadata beside the markup, but no markup is shuffled; an image may be one text."""
    urls = ["u1", "u2", "u3", "u4"]
    html = [BUILDING, "<title></title><h2>Now $2,500</h2>", "", None]
    rows = spark.createDataFrame(list(zip(urls, html)), "url string, html string")
    image = (lambda x: x) if kind == "string" else (lambda x: [x] if x else [])
    meta = spark.createDataFrame(
        [("u1", "T in Harlem, Bronx", None, image(""), None, "1,2"), ("u2", None, "9 Elm #4 in Harlem, manhattan | Site", image("m1"), "40.8;0", "1,2")],
        f"url string, title string, og_title string, og_images {kind}, geo_position string, icbm string",
    )
    got = parse_with_page_meta(rows, meta)
    want = parse_building_pages(with_page_meta(rows, meta))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    images = {r.url: r.images for r in got.collect()}
    assert images["u1"] == ["https://p.zillowstatic.com/a.jpg"] and images["u2"] == ["m1"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert not exchanged(got) & {"html", "elements", "text_runs", "page_text"}
        assert "html" in exchanged(want) or "elements" in exchanged(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_shredder_details(spark):
    text, elements = shred('<p a="1>2" B=x>one<p>two<br>three</p></div><!-- <i> --><textarea><b>&lt;</textarea><script>&lt;</script>')
    assert [e[0] for e in elements] == ["p", "p", "br", "textarea", "script"]
    assert elements[0][3] == {"a": "1>2", "b": "x"}
    assert "".join(text) == "onetwothree<b><&lt;"
    assert ["".join(text[e[4] : e[4] + e[5]]) for e in elements] == ["one", "twothree", "", "<b><", "&lt;"]
    page = shred_pages(spark.createDataFrame([("<a href=' /x '>  </a><a href='/y'>Y</a><a>Z</a>",), (None,)], "html string"))
    rows = page.select(
        first_text(tagged("a")).alias("t"), all_text(tagged("a")).alias("ts"), first_attr(tagged("a"), "href").alias("h"),
        all_attrs(tagged("a"), "href").alias("hs"),
    ).collect()
    assert tuple(rows[0]) == (None, ["Y", "Z"], "/x", ["/x", "/y"])
    assert rows[1].t is None


def test_references_cut_short():
    """titles are cut at a length; read as browsers do, or left as they are."""
    markup = '<a href="/x?a=1&amp">a &amp;&lt; &#65; b &am</a><title>c &amp</title>'
    (whole, elements), (read, _) = shred(markup, cut_references=False), shred(markup)
    assert whole == ["a &< A b &am", "c &amp"] and read == ["a &< A b &am", "c &"]
    assert elements[0][3] == {"href": "/x?a=1&amp"}


def test_page_meta_never_repeats_a_page(spark):
    """a url captured twice counts once, by its last capture; by visit, each page has its own."""
    rows = spark.createDataFrame([("u1", 1, "<h2>x</h2>"), ("u1", 2, None)], "url string, visit int, html string")
    meta = spark.createDataFrame(
        [("u1", 1, None, "A #1 in Harlem, Bronx", ["b"], None, None, 2), ("u1", 2, None, "B #2 in Harlem, Bronx", ["a"], None, None, 1)],
        "url string, visit int, title string, og_title string, og_images array<string>, geo_position string, icbm string, captured_at int",
    ).withColumn("captured_at", F.timestamp_seconds("captured_at").cast("timestamp_ntz"))
    for parsed in (parse_with_page_meta(rows, meta), parse_building_pages(with_page_meta(rows, meta.drop("visit")))):
        assert sorted((r.visit, r.title) for r in parsed.collect()) == [(1, "A #1"), (2, "A #1")]
    parsed = parse_with_page_meta(rows, meta.drop("captured_at"), on=("url", "visit"))
    assert sorted((r.visit, r.title) for r in parsed.collect()) == [(1, "A #1"), (2, "B #2")]


def test_pages_carry_their_time(spark):
    """the stream's pages come with their time, without a join that shuffles markup."""
    from rentweave.plans.queries_sources import building_pages_view

    pages = building_pages_view(spark, "/root/testdata/sf0.001", F.col("last_seen_at").alias("fetched_at"))
    assert pages.columns == ["listing_id", "html", "fetched_at"] and "html" not in exchanged(pages)


def test_folders(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>1")
    (tmp_path / "a.url").write_text("\n https://h/a \n")
    (tmp_path / "b.html").write_text("<p>2")
    (tmp_path / "r-1.json").write_text('{\n "title": "T"\n}')
    rows = {r.html: r.url for r in read_html_folder(spark, str(tmp_path)).collect()}
    assert rows == {"<p>1": "https://h/a", "<p>2": f"file://{tmp_path}/b.html"}
    raw = read_json_folder(spark, str(tmp_path), "structured_json")
    assert [r.source_listing_id for r in raw.collect()] == ["r-1"]
    adapter = SourceRegistry().route("structured_json")[0]
    assert one(adapter.parse(raw))["title"] == "T"
    parsed = parse_html_folder(spark, str(tmp_path), parse_building_pages)
    assert {(r.url, r.title) for r in parsed.collect()} == {("https://h/a", "Unknown"), (f"file://{tmp_path}/b.html", "Unknown")}
    assert "html" not in exchanged(parsed.repartition(2))


@pytest.mark.parametrize("stream", [False, True])
def test_sources_discover_what_lies_in_folders(spark, tmp_path, stream):
    records, lists = tmp_path / "records", tmp_path / "lists"
    for folder in (records, lists):
        folder.mkdir()
    (records / "r-1.json").write_text("{}")
    (records / "notes.txt").write_text("x")
    (lists / "seeds.txt").write_text("https://h/building/b1/2g\n https://h/short-term-rental-details/7/a\nhttps://h/other\n\n")
    (lists / "dump.json").write_text('{"links": ["https://h/building/b1/2g", "https://h/building/b2/3h", null]}\n{"cut\n')
    folders = {"structured_json": str(records), "building_pages": str(lists), "sublet_pages": str(lists)}
    found = discovered_by_source(spark, folders, stream=stream)
    if stream:
        run = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp"))
        run.trigger(availableNow=True).start().awaitTermination()
        found = spark.table("found")
    rows = sorted((r.source, r.url.rsplit("/", 3)[-3:] if "/h/" in r.url else r.url.rsplit("/", 1)[1], r.source_listing_id) for r in found.collect())
    copies = [("building_pages", ["building", "b1", "2g"], "b1/2g")] * (2 if stream else 1)
    assert rows == [
        *copies, ("building_pages", ["building", "b2", "3h"], "b2/3h"), ("structured_json", "r-1.json", "r-1"),
        ("sublet_pages", ["short-term-rental-details", "7", "a"], "7"),
    ]


def test_registry_of_sources():
    registry = SourceRegistry()
    registry.register(SourceAdapter("mine", lambda raw: raw))
    assert [a.name for a in registry.route("mine, sublet_pages")] == ["mine", "sublet_pages"]
    assert registry.names()[-1] == "mine" and len(registry.route()) == 5
    with pytest.raises(ValueError, match="unknown source x"):
        registry.route("x")
    with pytest.raises(ValueError, match="already registered"):
        registry.register(SourceAdapter("mine", lambda raw: raw))


def test_discover_links(spark):
    hit = 'href="/short-term-rental-details/{}/a"'
    df = spark.createDataFrame(
        [(1, 200, hit.format(7) + hit.format(8) + hit.format(7)), (0, 404, hit.format(9)), (2, 200, hit.format(8))],
        "seq int, http_status int, html string",
    )
    rows = {(r.url.rsplit("/", 2)[1], r.source_listing_id, r.seq, r.pos) for r in discover_links(df).collect()}
    assert rows == {("7", "7", 1, 0), ("8", "8", 1, 1)}


@pytest.mark.parametrize("markup", ["<div>" * 1_000_000, "<b>" * 500_000 + "</i>" * 900_000, "<p>x" * 1_300_000])
def test_large_broken_pages_are_linear(markup):
    start = time.process_time()
    _, elements = shred(markup)
    assert len(elements) >= 500_000
    assert time.process_time() - start < 60


def test_sublet_postings_are_dealt_evenly_before_their_pages_are_parsed(spark, tmp_path):
    """One small file of postings makes pages for all tasks."""
    rows = [(i, i % 7, "F", 1000.0 + i, datetime(1995, 1, 1), "1-URGENT") for i in range(4000)]
    tables = {
        "orders": (rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "customer": ([(i, i % 2) for i in range(7)], "c_custkey long, c_nationkey int"),
        "nation": ([(0, "HERE", 0), (1, "THERE", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": ([(0, "ASIA")], "r_regionkey int, r_name string"),
    }
    for name, (values, ddl) in tables.items():
        spark.createDataFrame(values, ddl).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    merged = "spark.sql.adaptive.coalescePartitions.enabled"  # of partitions as small as these
    spark.conf.set(merged, "false")
    try:
        pages = sublet_pages_view(spark, str(tmp_path))
        counts = [r["count"] for r in pages.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset(merged)
    assert sum(counts) == 4000 and len(counts) == 8 and max(counts) < 700


def test_attributes_are_kept_apart_by_how_references_are_read():
    markup = '<a title="1 &amp 2" class=x><b title="1 &amp 2" class=x>'
    for cut, want in ((True, "1 & 2"), (False, "1 &amp 2"), (True, "1 & 2")):
        elements = shred(markup, cut)[1]
        assert [e[3] for e in elements] == [{"title": want, "class": "x"}] * 2
    assert shred("<TITLE>a<b></title ><p><!-- <i> --><script>'<p>'")[1] == [
        ["title", -1, 1, {}, 0, 1], ["p", -1, 3, {}, 1, 1], ["script", 1, 3, {}, 1, 1],
    ]
