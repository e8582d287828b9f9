"""Continuous import of landed pages and running first/last-seen state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.history import first_last_seen
from ..operators.ingest import ingest_batch
from ..operators.merge import LISTING_KEY, keyed_upsert, upsert_links, upsert_listings, upsert_raw
from ..plans.run import arrival_changes
from ..schemas import CHANGE_LOG, LISTINGS, PAGES, POSTINGS, RAW_LISTINGS, UNITS
from ..session import dropping_shuffle_files, dropping_stages, stage
from ..sources.adapters import SourceAdapter
from ..sources.intake import accepted, check_pages, quarantined
from .keyed_table import KeyedTable


class RegistryFolder:
    """Registry tables below one folder, each in folders of hashed keys (``KeyedTable``).

    Raw pages and postings lie by url, units by id, links by posting.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root
        layout = {
            "raw": (RAW_LISTINGS, LISTING_KEY), "listings": (LISTINGS, LISTING_KEY),
            "units": (UNITS, ("unit_id",)), "postings": (POSTINGS, ("listing_id",)),
        }
        self.tables = {name: KeyedTable(spark, f"{root}/{name}", *how, buckets) for name, how in layout.items()}

    def read(self, table: str, batch: int) -> DataFrame:
        """A table as ``batch`` left it."""
        return self.tables[table].read(batch)

    def write_batch(self, name: str, batch: int, df: DataFrame) -> None:
        with dropping_shuffle_files(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}/batch={batch}")

    def changes(self) -> DataFrame:
        return self.spark.read.schema(CHANGE_LOG).parquet(f"{self.root}/changes/*")


def read_landing(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of pages landing as parquet files."""
    return spark.readStream.schema(PAGES).parquet(folder)


def replace_rows(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Units of ``rows`` in place of the stored ones of the same id."""
    return keyed_upsert(stored, rows, ("unit_id",), ("last_seen_at",), update=[c for c in stored.columns if c != "unit_id"])


def import_pages(
    pages: DataFrame, registry: RegistryFolder, adapter: SourceAdapter, checkpoint: str
) -> DataStreamWriter:
    """Writer that checks, parses, merges and links each micro-batch; start() it.

    A batch is dated by its newest page, so a batch that runs again writes the same rows. It reads
    the compared columns of all units, and rewrites the key folders its own urls, units and links are in.
    What it stages on the way goes when it ends, so that the registry's own tables are all that a batch leaves.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        with dropping_stages(registry.spark):
            load(batch, epoch)

    def load(batch: DataFrame, epoch: int) -> None:
        # one reading of the batch and one time for all its tables
        checked = stage(check_pages(batch), "checked")
        newest = checked.agg(F.max("fetched_at").alias("at")).first()["at"]
        now = F.lit(newest).cast("timestamp_ntz")
        registry.write_batch("refused", epoch, quarantined(checked).select("url", "fetched_at", "reject_reason"))
        fetched = accepted(checked).select(
            F.col("url").alias("source_url"), F.lit(None).cast("string").alias("source_listing_id"),
            "http_status", F.col("html").alias("raw_content"), F.col("fetched_at").alias("seen_at"),
        )
        parsed = ingest_batch(fetched, adapter)
        raw, listings, units, postings = (registry.tables[t] for t in ("raw", "listings", "units", "postings"))
        raw.merge(epoch, parsed.raw, upsert_raw)
        hit = listings.merge(epoch, parsed.listings, upsert_listings)
        urls = parsed.listings.select(*LISTING_KEY).distinct()
        arrived = stage(listings.read(epoch, hit).join(urls, list(LISTING_KEY), "left_semi"), "arrived")
        linked = postings.read(epoch - 1, postings.touched(arrived))
        run = arrival_changes(arrived, units.read(epoch - 1), linked, now)
        postings.merge(epoch, run.postings, upsert_links)
        units.merge(epoch, stage(run.units, "units"), replace_rows)
        registry.write_batch("changes", epoch, run.changes)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def stream_first_last_seen(observations: DataFrame, keys: list[str], ts: str) -> DataStreamWriter:
    """Running first and last sighting per posting, updated rows only."""
    return first_last_seen(observations, keys, ts).writeStream.outputMode("update")
