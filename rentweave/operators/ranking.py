"""Ordered positions without one task per group.

A top-k, a full numbering or a lag over a group that holds a third of all rows is split
here into sort partitions or buckets that keep the order; only their summaries meet in one
place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def age(ts: str | Column) -> Column:
    """Orders newest first; for taking the newest row as a minimum. Needs no time zone."""
    return F.lit("2100-01-01").cast("timestamp_ntz") - (F.col(ts) if isinstance(ts, str) else ts)


#: Sizes up to which a top-k is cut in every task before the shuffle: a key's task then gets at most this many rows per task.
SMALL_K = 100


def _segments(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows sorted by keys and order in sort partitions, and what each partition takes over from those before it.

    The sort is range-partitioned on keys and order together, so a key with very many rows spreads over
    partitions, whatever its order values are. Only a partition's first key can have begun in an earlier one: the second
    table has at most one row per partition, with that key's rows so far and its last ``value``.
    """
    placed = sorted_position(df, [*[F.col(c) for c in keys], *order], "_at").withColumn("_part", F.shiftright("_at", 33))
    last = F.lit(None) if value is None else value
    pieces = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"), F.max("_at").alias("_end"),
        F.max_by(F.struct(last.alias("v")), "_at").alias("_last"),
    )
    # of a partition's keys only the first and the last can reach beyond it
    ends = pieces.groupBy("_part").agg(F.max("_end").alias("_end"))
    edge = pieces.join(F.broadcast(ends.withColumnRenamed("_end", "_part_end")), "_part")
    edge = edge.where((F.col("_first").bitwiseAND(F.lit((1 << 33) - 1)) == 0) | (F.col("_end") == F.col("_part_end")))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select(
        *keys, "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.last("_last").over(before).alias("_carried"),
    )
    return placed, carried.where(F.col("_before") > 0)


#: Rows of a key up to which one task may sort them.
PLAIN_ROWS = 1_000_000


def _all_small(df: DataFrame, keys: Sequence[str]) -> bool:
    """No key has more than ``PLAIN_ROWS`` rows; counted with map-side combine."""
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= PLAIN_ROWS


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position within ``keys`` by ``order``, which must be unique per row of a key.

    A window where every key is small; else a scan over sort partitions, so that no task holds a hot key, also where
    all its rows share the leading order value.
    """
    if _all_small(df, keys):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    placed, carried = _segments(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    numbered = placed.withColumn("_inside", F.row_number().over(inside))
    return (
        _join_null_safe(numbered, F.broadcast(carried.drop("_carried")), [*keys, "_part"], "left")
        .withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_inside"))
        .drop("_at", "_part", "_before", "_inside")
    )


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``value`` of the row before within ``keys`` by ``order``; null for the first row. A window or a scan, as in ``number_rows``."""
    if _all_small(df, keys):
        return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))
    placed, carried = _segments(df, keys, [F.col(c) for c in order], F.col(value))
    inside = Window.partitionBy("_part", *keys).orderBy("_at")
    lagged = placed.withColumns({"_first": F.row_number().over(inside) == 1, "_lag": F.lag(value).over(inside)})
    return (
        _join_null_safe(lagged, F.broadcast(carried.drop("_before")), [*keys, "_part"], "left")
        .withColumn(name, F.when(F.col("_first"), F.col("_carried.v")).otherwise(F.col("_lag")))
        .drop("_at", "_part", "_carried", "_first", "_lag")
    )


def _join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str) -> DataFrame:
    """First ``k`` rows of each key by ``order``, with their place.

    A small ``k`` is cut in every task before the shuffle. A large one is a range sort by key and order: a
    key with very many rows spreads over sort partitions, whose row counts per key place it. Neither way
    brings a whole key into one task, and both give the same rows.
    """
    if k <= SMALL_K:
        ranked = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(ranked)).filter(F.col(name) <= k)
    placed = sorted_position(df, [*[F.col(c) for c in keys], *order], "_at")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    parts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(*keys, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        _join_null_safe(placed, starts.where(F.col("_before") < k), [*keys, "_part"])
        .withColumn(name, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .filter(F.col(name) <= k)
        .drop("_at", "_part", "_first", "_before")
    )


def sorted_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Staged copy of ``df`` with a bigint that rises with ``order`` (unique, with gaps).

    ``order`` must be unique per row. The sort is range-partitioned on all of it, so
    equal leading values spread over tasks; the position is fixed by being written.
    """
    return stage(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()), "sorted")


def dense_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Staged copy of ``df`` with its 1-based position in the whole table by ``order``."""
    placed = sorted_position(df, order, "_at")
    # The upper bits of the position number the sort partition, the lower 33 the row.
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumns({"_part": part, "_row": row})
    sizes = placed.groupBy("_part").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per sort partition: small whatever the table holds, so safe to broadcast.
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + F.col("_row") + 1)
        .drop("_at", "_part", "_row", "_before")
    )
