"""Tables in folders of hashed keys, of which a batch rewrites only those it touches."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import column_types
from ..session import dropping_shuffle_files


class KeyedTable:
    """A table whose rows lie in ``buckets`` folders by a hash of ``keys``.

    ``data/batch=b/bucket=n`` holds a whole bucket as batch ``b`` left it; ``live/batch=b`` names, for
    every bucket with rows, the batch that wrote it last (at most ``buckets`` rows). A batch reads what
    the batch before it left, rewrites the buckets its own keys fall into, and then publishes its list, so

    * its cost is that of the touched buckets, not of the table,
    * readers see the batch before until the list is there,
    * running a batch again, also after a failure half-way, reads and writes the same.

    Folders that no list of interest names can be expired at any time. Choose ``buckets`` so that one
    of them is a few files; it is fixed for the life of the table.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, tuple(keys), buckets
        self._types = column_types(schema)

    def bucket(self) -> Column:
        """Bucket of a row; types are the table's own, so equal keys always meet."""
        return F.pmod(F.xxhash64(*[F.col(k).cast(self._types[k]) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that the keys of ``rows`` fall into."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("bucket")).distinct().collect())

    def live(self, batch: int) -> dict[int, int]:
        """Batch that last wrote each bucket, as of ``batch``."""
        if batch < 0:
            return {}
        rows = self.spark.read.schema("bucket int, written int").parquet(f"{self.root}/live/batch={batch}")
        return {r.bucket: r.written for r in rows.collect()}

    def read(self, batch: int, buckets: Collection[int] | None = None) -> DataFrame:
        """The table as ``batch`` left it, or only some of its buckets."""
        folders = [
            f"{self.root}/data/batch={written}/bucket={n}"
            for n, written in sorted(self.live(batch).items())
            if buckets is None or n in buckets
        ]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, batch: int, rows: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Write ``apply(stored rows of the touched buckets, rows)`` as ``batch``; the buckets rewritten.

        ``apply`` must keep every stored key (an upsert does), and ``rows`` should be cheap to read twice.
        """
        hit = self.touched(rows)
        before = self.live(batch - 1)
        if hit:
            merged = apply(self.read(batch - 1, hit), rows).select(*self._types).withColumn("bucket", self.bucket())
            # as many tasks per bucket as its size asks for; ids are hex digits, which only an entropy coder shrinks
            writer = merged.hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd")
            with dropping_shuffle_files(merged.sparkSession):
                writer.partitionBy("bucket").parquet(f"{self.root}/data/batch={batch}")
        now = sorted((before | dict.fromkeys(hit, batch)).items())
        listed = self.spark.createDataFrame(now, "bucket int, written int")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/live/batch={batch}")
        return hit
