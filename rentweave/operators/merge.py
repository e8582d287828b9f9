"""Keyed merge: insert new keys, update chosen columns of known ones."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..schemas import PARSED_FIELDS

#: Bits of a batch's key filter. Its rows hold 64 bits each, so at most 2**20 of them, 16 MiB, go to all tasks.
FILTER_BITS = 1 << 26


def keyed_upsert(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    update: Sequence[str],
    insert_only: Sequence[str] = (),
) -> DataFrame:
    """Merge a batch into a table that holds each key once.

    Records of one key apply in ``order``, as if they arrived one by one: a new key
    takes ``insert_only`` columns from its first record, ``update`` columns always
    come from its last one (nulls included), all other columns keep the old value.

    Stored rows are tested against a Bloom filter of the batch's keys (``key_filter``), whose size
    does not grow with the batch. Rows that miss it pass through without a shuffle; a row that hits
    it by chance is merged with nothing and stays as it is. The rest is aggregated, with map-side
    combine: a key repeated in a third of the batch shrinks to one row per map task before the shuffle.
    """
    columns = existing.columns
    marked = mark_touched(existing, key_filter(incoming, keys, dict(existing.dtypes)), keys)
    touched = marked.filter("_touched").select(*columns)
    untouched = marked.filter("not _touched").select(*columns)
    return untouched.unionByName(_merge(touched, incoming, keys, order, update, insert_only))


def _slot(keys: Sequence[str], types: dict[str, str]) -> dict[str, Column]:
    """Word and bit of a key in the filter; equal keys, nulls included, have equal slots."""
    place = F.xxhash64(*[F.col(k).cast(types[k]) for k in keys]).bitwiseAND(F.lit(FILTER_BITS - 1))
    return {"_word": F.shiftright(place, 6), "_bit": place.bitwiseAND(F.lit(63)).cast("int")}


def key_filter(incoming: DataFrame, keys: Sequence[str], types: dict[str, str]) -> DataFrame:
    """Bloom filter of one hash function: ``_word, _bits``, at most ``FILTER_BITS / 64`` rows; one aggregate."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    return incoming.select(*[c.alias(n) for n, c in _slot(keys, types).items()]).groupBy("_word").agg(F.bit_or(bit).alias("_bits"))


def mark_touched(existing: DataFrame, batch_filter: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` with ``_touched``: false only where the batch certainly does not hold the key."""
    placed = existing.withColumns(_slot(keys, dict(existing.dtypes)))
    hit = F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False))
    return placed.join(F.broadcast(batch_filter), "_word", "left").withColumn("_touched", hit).drop("_word", "_bit", "_bits")


def rows_among(rows: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key ``wanted`` holds. Most others miss its key filter, so that a large table is not shuffled for them."""
    marked = mark_touched(rows, key_filter(wanted, keys, dict(rows.dtypes)), keys)
    return marked.filter("_touched").drop("_touched").join(wanted.select(*keys), list(keys), "left_semi")


def _merge(existing, incoming, keys, order, update, insert_only) -> DataFrame:
    columns = existing.columns
    written = {*keys, *update, *insert_only}
    types = dict(existing.dtypes)
    old = existing.select(
        *columns, F.struct(F.lit(False).alias("fresh"), *[_null(incoming, c) for c in order]).alias("ord")
    )
    new = incoming.select(
        *[
            (F.col(c) if c in written else F.lit(None)).cast(types[c]).alias(c)
            for c in columns
        ],
        F.struct(F.lit(True).alias("fresh"), *[F.col(c) for c in order]).alias("ord"),
    )
    kept = [c for c in columns if c not in keys and c not in update]
    aggs = [F.max_by(F.struct(*update), "ord").alias("last")]
    if kept:
        aggs.append(F.min_by(F.struct(*kept), "ord").alias("first"))
    merged = old.unionByName(new).groupBy(*keys).agg(*aggs)
    return merged.select(
        *[
            F.col(c) if c in keys else F.col(f"last.{c}" if c in update else f"first.{c}").alias(c)
            for c in columns
        ]
    )


def _in_order(rows: DataFrame) -> DataFrame:
    """With ``batch`` and ``seq``, the order of arrival of batches and, at equal times, of their records."""
    for c in ("batch", "seq"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("bigint"))
    return rows


def _null(df: DataFrame, name: str):
    return F.lit(None).cast(df.schema[name].dataType).alias(name)


LISTING_KEY = ("source", "source_url")
#: Stands for an id made from the row's key until the merge is done, so that ids are not shuffled beside their keys.
FROM_KEY = ""


def _with_ids(merged: DataFrame, **kinds: str) -> DataFrame:
    """``FROM_KEY`` in the given id columns replaced by the id of that kind."""
    ids = {c: stable_id(F.lit(kind), *[F.col(k) for k in LISTING_KEY]) for c, kind in kinds.items()}
    return merged.withColumns({c: F.when(F.col(c) == FROM_KEY, made).otherwise(F.col(c)) for c, made in ids.items()})


RAW_MERGE = {
    "update": ("fetched_at", "http_status", "raw_content", "extracted_json", "parse_version"),
    "insert_only": ("raw_id", "source_listing_id"),
}


def upsert_raw(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Raw pages by (source, source_url); the source's own id is set on insert only."""
    rows = fetched.withColumn("raw_id", F.lit(FROM_KEY))
    merged = keyed_upsert(
        existing, _in_order(rows), LISTING_KEY, ("batch", "fetched_at", "seq"), **RAW_MERGE
    )
    return _with_ids(merged, raw_id="raw")


# Columns the folder import overwrites; all others keep what is known.
FOLDER_IMPORT_COLUMNS = (
    "raw_id", "title", "description", "address", "unit", "neighborhood", "borough",
    "rent_gross", "rent_net", "bedrooms", "bathrooms", "broker_fee", "images", "last_seen_at",
)


def join_raw(first: DataFrame, later: Sequence[DataFrame]) -> DataFrame:
    """Raw pages of several rounds, in order, as if each had been merged into those before."""
    parts = [rows.withColumn("round", F.lit(n)) for n, rows in enumerate(later)]
    return keyed_upsert(first, reduce(DataFrame.unionByName, parts), LISTING_KEY, ("round",), **RAW_MERGE)


def upsert_listings(existing: DataFrame, parsed: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Postings by (source, source_url).

    Every parsed field is overwritten, also by null, unless ``columns`` names fewer.
    ``parsed`` carries ``seen_at``: it becomes last_seen_at, and first_seen_at of
    new postings.
    """
    rows = parsed.withColumns(
        {
            "listing_id": F.lit(FROM_KEY),
            "raw_id": F.lit(FROM_KEY),
            "images": F.coalesce("images", F.array().cast("array<string>")),
            "first_seen_at": F.col("seen_at"),
            "last_seen_at": F.col("seen_at"),
        }
    )
    update = tuple(columns) if columns else ("raw_id", *PARSED_FIELDS, "last_seen_at")
    merged = keyed_upsert(
        existing, _in_order(rows), LISTING_KEY, ("batch", "seen_at", "seq"), update=update,
        insert_only=("listing_id", "first_seen_at"),
    )
    return _with_ids(merged, listing_id="listing", raw_id="raw")


def upsert_links(existing: DataFrame, links: DataFrame) -> DataFrame:
    """Unit-listing links; a known pair only gets the new score."""
    return keyed_upsert(
        existing, _in_order(links), ("unit_id", "listing_id"), ("batch", "created_at", "seq"),
        update=("match_score",), insert_only=("created_at",),
    )
