"""What the corpus operators share: tables, staged results, text buffers and n-gram hashes.

Hashing works on whole Arrow batches: the words or bytes of a batch form one
buffer, an n-gram's hash is a difference of prefix sums, and n-grams that cross
a document's end are masked out. Document ids may be any bigint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from rentweave.session import checkpoint_root, stage  # noqa: F401

#: Bytes of text that one step handles at a time; a longer document is a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def bound_batches(spark: SparkSession, size: str = "256k") -> None:
    """Arrow batches of about ``size`` from here on: the JVM and the Python worker of a task each hold a few, and arrays of some 30 times that."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that executors write, below ``spark.checkpoint.dir``."""
    import uuid

    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text buffers


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    ends = ends.astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``STEP_BYTES`` of text, so that a step's memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = utf8(batch.column(column))[1]
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[start] + STEP_BYTES, "right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop


# ---------------------------------------------------------------- hashes

#: Odd, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SIZE_CODE = 0xD6E8FEB86659FD93
_BYTE_CODES = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[np.uint64, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** 0 .. base ** n`` modulo 2**64, kept for the next call."""
    known = _POWERS.get(base)
    if known is None or len(known) <= n:
        out = np.full(max(n, STEP_BYTES) + 1, base, np.uint64)
        out[0] = 1
        known = np.cumprod(out, dtype=np.uint64)
        if n <= STEP_BYTES:
            _POWERS[base] = known
    return known[: n + 1]


class RangeHash:
    """Hashes of arbitrary ranges of a sequence of 64-bit codes from two arrays."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _powers(_BASE, max(n - 1, 0))[:n], dtype=np.uint64, out=self.sums[1:])
        self.back = _powers(_BASE_INVERSE, n)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(_SIZE_CODE))

    def grams(self, n: int) -> np.ndarray:
        """Of every n-gram of the sequence, by its start."""
        count = max(len(self.sums) - n, 0)
        raw = (self.sums[n : n + count] - self.sums[:count]) * self.back[:count]
        return mix(raw + np.uint64(n * _SIZE_CODE % (1 << 64)))


def byte_codes(data: np.ndarray) -> np.ndarray:
    return _BYTE_CODES[data]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words ``[^\\x20\\x09-\\x0D]+``; first word of each document and the total."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = edges[edges > 0] - 1
    ends[last] = inside[last]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of every window of ``width``, by the upper 32 bits, leftmost of equals.

    Depends on a window's values alone, so equal windows choose equal places wherever they are.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rows = -(-len(values) // width)
    key = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    key[: len(values)] = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(values), dtype=np.uint64)
    block = key.reshape(rows, width)
    tail = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    head = np.minimum.accumulate(block, axis=1).reshape(-1)
    least = np.minimum(tail[:n], head[width - 1 : width - 1 + n])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def within_documents(firsts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Mask over the starts ``0..n-width``: the window stays in one document."""
    count = max(n - width + 1, 0)
    ok = np.ones(count, bool)
    reach = np.zeros(count + 1, np.int64)
    inner = firsts[(firsts > 0) & (firsts < n)]
    np.add.at(reach, np.clip(inner - width + 1, 0, count), 1)
    np.add.at(reach, np.clip(inner, 0, count), -1)
    ok &= np.cumsum(reach)[:count] == 0
    return ok


def owners(firsts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Document number of each place."""
    return np.searchsorted(firsts, at, "right") - 1


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of ``0..n-1``: lies in one of the ranges."""
    deep = np.zeros(n + 1, np.int64)
    np.add.at(deep, starts, 1)
    np.add.at(deep, ends, -1)
    return np.cumsum(deep)[:n] > 0


# ---------------------------------------------------------------- rows and results


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: ``key`` tells rows that share a doc_id apart by their text."""
    return docs.select(F.col("`doc_id`"), F.xxhash64(F.col("`text`")).alias("key"), F.col("`text`"))


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def only(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns only; others, whatever their names, never meet the operator's own."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
