"""Queries over whole runs: crawl rounds, a batch run from raw records to states, the continuous import."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..operators.ingest import ingest_batch
from ..schemas import CRAWL_JOBS, LISTINGS, POSTINGS, RAW_LISTINGS, UNITS
from ..session import checkpoint_root, stage
from ..sources.adapters import SourceRegistry
from ..streaming.page_import import RegistryFolder, import_pages, read_landing
from .catalog import query
from .queries_frontier import _QUERY_SQL
from .queries_linkage import LINK_SQL
from .queries_registry import SEARCHES_SQL, searches_view
from .queries_sources import building_pages_view
from .rounds import RoundLedger, fill_registry
from .rounds import targeted_round as run_targeted_round
from .run import Registry, run_batch
from .views import AS_OF, ntz, postings_view, table

# --- records of two sources; a customer's orders are postings of one home ----------------

_SOURCES = ("classified_json", "structured_json")


def records_view(spark, sf_dir):
    """Every order as a fetched record of the source its number gives."""
    orders = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    rent, fee = F.floor(F.col("o_totalprice") / 100).cast("int"), F.col("o_orderstatus") == "F"
    street = F.concat(cust, F.lit(" West Street"))
    structured = F.to_json(F.struct(street.alias("address"), F.lit("1A").alias("unit"), rent.alias("rent"), fee.alias("brokerFee")))
    classified = F.to_json(
        F.struct(
            F.concat(street, F.lit(", Unit 1A")).alias("location"), rent.alias("price"),
            F.when(fee, "broker fee").otherwise("no fee").alias("fee"),
        )
    )
    odd = key % 2 == 1
    return orders.select(
        F.when(odd, _SOURCES[1]).otherwise(_SOURCES[0]).alias("source"),
        F.concat(F.lit("file:///o/"), key.cast("string")).alias("source_url"), key.cast("string").alias("source_listing_id"),
        F.lit(200).alias("http_status"), F.when(odd, structured).otherwise(classified).alias("raw_content"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("seen_at"), key.alias("seq"), F.col("o_custkey").alias("custkey"),
    )


_RECORDS_SQL = """
rec AS (SELECT CASE WHEN o_orderkey % 2 = 1 THEN 'structured_json' ELSE 'classified_json' END AS source, 'file:///o/' || o_orderkey AS url,
               o_orderkey AS seq, o_custkey AS custkey, CAST(floor(o_totalprice / 100) AS INTEGER) AS rent, o_orderstatus = 'F' AS fee,
               CAST(o_orderdate AS TIMESTAMP) AS seen_at FROM orders)"""


def _empty(spark):
    return Registry(*[spark.createDataFrame([], s) for s in (RAW_LISTINGS, LISTINGS, UNITS, POSTINGS)])


def _adapters():
    return SourceRegistry().route(",".join(_SOURCES))


# Every round takes an eighth of the urls; three fifths of the homes are asked for.
@query(f"""
WITH {_RECORDS_SQL},
size AS (SELECT CAST(ceil(count(*) / 16.0) AS BIGINT) AS b, CAST(floor(count(DISTINCT custkey) * 0.6) AS BIGINT) AS target FROM rec),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY seq, url) AS place FROM rec),
reached AS (SELECT n, count(DISTINCT custkey) AS units FROM r, size, range(1, 11) AS t(n) WHERE place <= n * b GROUP BY n),
stop AS (SELECT coalesce(min(n) FILTER (units >= target), 10) AS n FROM reached, size)
SELECT custkey || ' w st' AS address, count(*) AS postings, count(DISTINCT source) AS sources, CAST(any_value(stop.n) AS BIGINT) AS rounds,
       any_value(CASE WHEN target <= (SELECT units FROM reached WHERE reached.n = stop.n) THEN 'paused' ELSE 'active' END) AS job
FROM r, size, stop WHERE place <= stop.n * b GROUP BY custkey
""")
def registry_fill(spark, sf_dir):
    """Rounds until the registry holds three fifths of the homes."""
    records = stage(records_view(spark, sf_dir), "records")
    size = records.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("custkey").alias("homes")).first()
    ledger = RoundLedger(spark, f"{checkpoint_root(spark)}/fill-{uuid4().hex}")
    done = fill_registry(
        ledger, _empty(spark), spark.createDataFrame([], CRAWL_JOBS), records.select("source", F.col("source_url").alias("url"), "seq"),
        records, ntz(AS_OF), _adapters(), batch=-(-size.n // 16), max_urls=2 * size.n, target=size.homes * 6 // 10,
    )
    posted = done.registry.postings.join(done.registry.listings.select("listing_id", "source"), "listing_id")
    counts = posted.groupBy("unit_id").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("source").alias("sources"))
    (job,) = done.jobs.collect()
    return done.registry.units.join(counts, "unit_id").select(
        F.col("canonical_address").alias("address"), "postings", "sources",
        F.lit(len(ledger.finished())).cast("bigint").alias("rounds"), F.lit(job.status).alias("job"),
    )


@query(f"""
WITH {_RECORDS_SQL},
l AS (SELECT *, sha256('listing' || chr(1) || source || chr(1) || url) AS listing_id FROM rec),
n AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY custkey ORDER BY seen_at DESC, listing_id) = 1)
SELECT custkey || ' w st' AS address, '1A' AS unit, rent, fee, seen_at AS last_seen_at,
       (SELECT count(*) FROM l WHERE l.custkey = n.custkey) AS postings,
       CASE WHEN seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 'active'
            WHEN seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY THEN 'unknown' ELSE 'stale' END AS state
FROM n
""")
def whole_run(spark, sf_dir):
    """From raw records of two sources to units with their best fields and states."""
    records = records_view(spark, sf_dir)
    batches = [ingest_batch(records.where(F.col("source") == a.name).drop("source", "custkey"), a) for a in _adapters()]
    registry, _ = run_batch(_empty(spark), batches, ntz(AS_OF))
    counts = registry.postings.groupBy("unit_id").agg(F.count(F.lit(1)).alias("postings"))
    return registry.units.join(counts, "unit_id").select(
        F.col("canonical_address").alias("address"), F.col("canonical_unit").alias("unit"), F.col("best_rent_gross").alias("rent"),
        F.col("broker_fee").alias("fee"), "last_seen_at", "postings", F.col("active_state").alias("state"),
    )


# A customer's search finds the customer's own orders.
@query(f"""
WITH {_RECORDS_SQL}, s AS ({SEARCHES_SQL}),
tasks AS (SELECT search_id, unnest(['classified_json', 'structured_json']) AS source, {_QUERY_SQL} AS query FROM s WHERE is_active),
found AS (SELECT t.search_id, t.source, t.query, r.custkey, row_number() OVER (PARTITION BY t.search_id, t.source ORDER BY r.seq, r.url) AS place
          FROM tasks t LEFT JOIN rec r ON r.source = t.source AND lpad(CAST(r.custkey AS VARCHAR), 20, '0') = t.search_id)
SELECT source, query, count(custkey) AS discovered, count(custkey) FILTER (place <= 3) AS ingested,
       count(DISTINCT custkey) FILTER (place <= 3) AS units_added
FROM found GROUP BY source, query
""")
def targeted_round(spark, sf_dir):
    """One round of all active saved searches over both sources, three urls each; counters of their jobs."""
    records = stage(records_view(spark, sf_dir), "records")
    discovered = records.select(
        F.lpad(F.col("custkey").cast("string"), 20, "0").alias("search_id"), "source", F.col("source_url").alias("url"), "seq"
    )
    done = run_targeted_round(
        _empty(spark), spark.createDataFrame([], CRAWL_JOBS), searches_view(spark, sf_dir), discovered,
        records.drop("custkey"), ntz(AS_OF), _adapters(), cap=3,
    )
    return done.jobs.select("source", "query", "discovered", "ingested", "units_added")


# --- continuous import -----------------------------------------------------------------

#: Days before which pages land in the first and in the second batch.
BATCH_DAYS = ("1994-01-01", "1996-06-01")
_SITE = "https://homes.example.com/"
_BATCH_SQL = f"""CASE WHEN last_seen_at < TIMESTAMP '{BATCH_DAYS[0]}' THEN 0 WHEN last_seen_at < TIMESTAMP '{BATCH_DAYS[1]}' THEN 1 ELSE 2 END"""


def _stream_sql() -> str:
    """Pages visited in order of arrival; of equal scores units of earlier batches win, those by batch and id."""
    visited = LINK_SQL.replace("ORDER BY last_seen_at DESC, listing_id", "ORDER BY last_seen_at, orderkey")
    given = visited.index("picked AS")
    return f"""WITH RECURSIVE {visited[:given]}
ids AS (SELECT v.pos, k.last_seen_at, k.orderkey, k.rent_gross, {_BATCH_SQL} AS batch, '{_SITE}' || v.listing_id AS url,
               sha256('unit' || chr(1) || sha256('listing' || chr(1) || 'building_pages' || chr(1) || '{_SITE}' || v.listing_id)) AS unit_id
        FROM v JOIN keyed k ON k.listing_id = v.listing_id),
picked AS (SELECT e.later AS pos, w.unit_id, e.score FROM e JOIN final f ON f.pos = e.earlier AND f.mark = 1
           JOIN ids w ON w.pos = e.earlier JOIN ids m ON m.pos = e.later
           QUALIFY row_number() OVER (PARTITION BY e.later ORDER BY e.score DESC, w.batch,
               CASE WHEN w.batch = m.batch THEN lpad(CAST(w.pos AS VARCHAR), 20, '0') ELSE w.unit_id END) = 1)
SELECT i.url AS source_url, last_seen_at + to_microseconds(orderkey) AS first_seen_at,
       CASE WHEN f.mark = 1 THEN i.unit_id ELSE p.unit_id END AS unit_id,
       CASE WHEN f.mark = 1 THEN CAST(100 AS DOUBLE) ELSE CAST(p.score AS DOUBLE) END AS match_score
FROM ids i JOIN final f ON f.pos = i.pos LEFT JOIN picked p ON p.pos = i.pos AND f.mark = 2"""


@query(_stream_sql())
def page_import_stream(spark, sf_dir):
    """Postings' pages land in three lots; each is imported by a run of the stream that ends with what is there."""
    root = f"{checkpoint_root(spark)}/import-{uuid4().hex}"
    key = F.col("orderkey")
    fetched_at = F.col("last_seen_at") + F.make_dt_interval(secs=key.cast("decimal(18,6)") / 1000000)
    pages = building_pages_view(spark, sf_dir, fetched_at.alias("fetched_at")).select(
        F.concat(F.lit(_SITE), F.col("listing_id")).alias("url"), F.lit(200).alias("http_status"), "html", "fetched_at"
    )
    (adapter,) = SourceRegistry().route("building_pages")
    registry = RegistryFolder(spark, f"{root}/registry")
    first, second = (ntz(day) for day in BATCH_DAYS)
    at = F.col("fetched_at")
    lots = (at < first, (at >= first) & (at < second), at >= second)
    for lot in lots:
        pages.where(lot).write.mode("append").parquet(f"{root}/landing")
        stream = read_landing(spark, f"{root}/landing")
        run = import_pages(stream, registry, adapter, f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
    listings, postings = (registry.read(t, len(lots) - 1) for t in ("listings", "postings"))
    return listings.join(postings, "listing_id").select("source_url", "first_seen_at", "unit_id", "match_score")
