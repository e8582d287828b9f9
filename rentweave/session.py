"""Session settings and staged tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect (UTC, AQE with skew joins)."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        # Python steps see bounded batches, stream state lives on disk.
        .config("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: ``spark.checkpoint.dir`` where it is set.

    Only a local master falls back to a temporary folder; on a cluster a folder
    on one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="rentweave-stage-")
    spark.sparkContext.setCheckpointDir(root)
    return root


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when it ends, not when the driver collects its garbage."""
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)


#: Of each thread, the folders that ``stage`` wrote inside ``dropping_stages``.
_written = threading.local()


@contextmanager
def dropping_stages(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside go at the end; whatever is read from them must be written by then."""
    before, mine = getattr(_written, "paths", None), []
    _written.paths = mine
    try:
        yield
    finally:
        _written.paths = before
        for path in mine:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of iterative plans and gives the optimizer real file sizes;
    the files outlive any executor. Shuffle files of the write go when it ends.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (paths := getattr(_written, "paths", None)) is not None:
        paths.append(path)
    with dropping_shuffle_files(df.sparkSession):
        # ids are hex digits, which only an entropy coder shrinks
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
