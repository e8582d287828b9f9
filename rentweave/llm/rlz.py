"""Repeated word passages by relative Lempel-Ziv parsing.

The reference of a document is every document with a smaller id. It is indexed in blocks
of ``BLOCK`` words: in each window of ``window`` words the block of smallest hash is taken,
so a window that occurs twice is reached through one block in both places, and no
document has to be parsed against reference text it shares no block with. A block's
founder is the first document that holds it.

A document is parsed from left to right: at a block the founder's text is the
reference, and the factor goes on as long as the next indexed block stands at the same
distance in the same founder (neighbouring blocks overlap or touch, so the text between
them is equal too). A factor of at least ``window`` words is a duplicate span. At factor
boundaries, windows that no factor holds as a whole are looked up one by one, by hash,
against the founders' windows at these blocks and the other documents' boundary windows:
the first document that has such a window has it in one of those two places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentweave.llm.common import (
    RangeHash, as_signed, byte_codes, covered, keyed, owners, slices, stage, utf8, window_min, within_documents, words,
)

BLOCK = 7
#: A place is the text key's lower half above the word number, so rows that share a doc_id stay apart.
_LOW = (1 << 32) - 1
_PIECE = "kind int, doc_id long, key long, start int, n_words int, ref_doc_id long, ref_start int, hash long"


def _blocks(batch: pa.RecordBatch, window: int):
    """Word starts and ends, first words of documents, block hashes, window starts and their blocks, range hash."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, firsts = words(data, offsets)
    codes = RangeHash(byte_codes(data))(starts, ends)
    hashes = RangeHash(codes)
    blocks = hashes.grams(BLOCK)
    at = np.flatnonzero(within_documents(firsts[:-1], len(starts), window))
    return firsts, hashes, blocks, at, window_min(blocks, window - BLOCK + 1)[at]


def block_index(docs: DataFrame, window: int) -> DataFrame:
    """``block, doc_id, place``: the blocks that the windows of all documents are reached through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            firsts, _, blocks, at, chosen = _blocks(batch, window)
            chosen = np.unique(chosen)
            doc = owners(firsts[:-1], chosen)
            rows = pa.array(doc)
            low = batch.column("key").take(rows).to_numpy(zero_copy_only=False) & _LOW
            place = (low << 32) | (chosen - firsts[doc])
            yield pa.RecordBatch.from_arrays(
                [pa.array(as_signed(blocks[chosen])), batch.column("doc_id").take(rows), pa.array(place)],
                ["block", "doc_id", "place"],
            )

    return docs.where("doc_id is not null").mapInArrow(run, "block long, doc_id long, place long")


def _shared_blocks(docs: DataFrame, window: int) -> DataFrame:
    """Per document the blocks that a second document has too, with their founder."""
    index = block_index(docs, window)
    # a table of its own, so that the join is of plain shuffles, which adaptive execution can split at a hot block
    founders = stage(
        index.groupBy("block").agg(
            F.min("doc_id").alias("ref_doc_id"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("ref_place")
        ).where("ref_doc_id < last").drop("last"),
        "founders",
    )
    return index.join(founders, "block").select("doc_id", "place", "ref_doc_id", "ref_place")


def _parse(docs: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """Factors (kind 0) and the windows to look up (kind 1) of every document with shared blocks."""
    per_document = shared.groupBy("doc_id", F.shiftrightunsigned("place", 32).alias("low")).agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("place").bitwiseAND(F.lit(_LOW)).alias("at"), "ref_doc_id", "ref_place"
        ))).alias("blocks")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            firsts, hashes, _, at, chosen = _blocks(batch, window)
            lists = batch.column("blocks")
            flat = lists.flatten()
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            own = flat.field("at").to_numpy(zero_copy_only=False) + firsts[row]
            ref_doc = flat.field("ref_doc_id").to_numpy(zero_copy_only=False)
            ref_place = flat.field("ref_place").to_numpy(zero_copy_only=False)
            founder = ref_doc == batch.column("doc_id").to_numpy(zero_copy_only=False)[row]
            # factors: neighbouring blocks that touch and stand equally far apart in one founder
            goes_on = (
                (row[1:] == row[:-1]) & (own[1:] - own[:-1] <= BLOCK) & (ref_doc[1:] == ref_doc[:-1])
                & (ref_place[1:] - ref_place[:-1] == own[1:] - own[:-1])
            )
            begin = np.flatnonzero(np.r_[True, ~goes_on][: len(own)])
            finish = np.r_[begin[1:], len(own)] - 1
            start, stop = own[begin], own[finish] + BLOCK
            factor = (~founder[begin]) & (stop - start >= window)
            begin, start, stop = begin[factor], start[factor], stop[factor]
            owner = row[begin]
            # windows reached through a shared block, but not held by a factor as a whole
            n = len(hashes.sums) - 1
            is_shared = np.zeros(n + 1, bool)
            is_shared[own] = True
            held = covered(start, stop - window + 1, n + 1)
            look = at[is_shared[chosen] & ~held[at]]
            look_row = owners(firsts[:-1], look)
            rows = pa.array(np.concatenate([owner, look_row]))
            zero = np.zeros(len(look), np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.r_[np.zeros(len(owner)), np.ones(len(look))].astype(np.int32)),
                    batch.column("doc_id").take(rows), batch.column("key").take(rows),
                    pa.array(np.r_[start - firsts[owner], look - firsts[look_row]].astype(np.int32)),
                    pa.array(np.r_[stop - start, zero + window].astype(np.int32)),
                    pa.array(np.r_[ref_doc[begin], zero]),
                    pa.array(np.r_[ref_place[begin] & _LOW, zero].astype(np.int32)),
                    pa.array(np.r_[np.zeros(len(owner), np.int64), as_signed(hashes(look, look + window))]),
                ],
                ["kind", "doc_id", "key", "start", "n_words", "ref_doc_id", "ref_start", "hash"],
            )

    d, p = docs.alias("d"), per_document.alias("p")
    low = F.col("d.key").bitwiseAND(F.lit(_LOW))
    return d.join(p, (F.col("d.doc_id") == F.col("p.doc_id")) & (low == F.col("p.low"))).select(
        "d.doc_id", "d.key", "d.text", "p.blocks"
    ).mapInArrow(run, _PIECE)


def factors(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, key, start, n_words, ref_doc_id, ref_start`` (in words): what each document copies from earlier ones.

    Long factors first parsed, then single windows confirmed at factor boundaries (their
    ``ref_start`` is null). Together they hold every window whose words also start in a
    document with a smaller doc_id. ``docs`` is ``common.keyed``; rows without a doc_id
    neither copy nor are copied from.
    """
    shared = stage(_shared_blocks(docs, window), "blocks")
    pieces = stage(_parse(docs, shared, window), "factors")
    look = pieces.where("kind = 1").select("hash", "doc_id", "key", "start", "n_words")
    first = look.groupBy("hash").agg(F.min("doc_id").alias("ref_doc_id"), F.max("doc_id").alias("last")).where(
        "ref_doc_id < last"
    ).drop("last")
    confirmed = look.join(first, "hash").where("ref_doc_id < doc_id").select(
        "doc_id", "key", "start", "n_words", "ref_doc_id", F.lit(None).cast("int").alias("ref_start")
    )
    return pieces.where("kind = 0").drop("kind", "hash").union(confirmed)


def remove_copies(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words of every text that no earlier document's passage covers.

    Words are runs of bytes other than white space, unchanged; kept words are joined by one
    space. Null or empty text has no words. Rows that share a doc_id are not earlier than
    each other. An empty table gives an empty result.
    """
    rows = keyed(docs)
    spans = stage(factors(rows, window).select("doc_id", "key", "start", "n_words").distinct(), "spans")
    per_document = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            begins, ends, firsts = words(data, offsets)
            lists = batch.column("spans")
            flat = lists.flatten()
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            start = flat.field("start").to_numpy(zero_copy_only=False) + np.repeat(firsts[:-1], sizes)
            gone = covered(start, start + flat.field("n_words").to_numpy(zero_copy_only=False), len(begins))
            stay = ~gone
            n_kept = np.r_[0, np.cumsum(stay)][firsts]
            raw, kept = data.tobytes(), []
            whole = np.diff(n_kept) == np.diff(firsts)
            b, e = begins.tolist(), ends.tolist()
            for i, (lo, hi) in enumerate(zip(firsts[:-1].tolist(), firsts[1:].tolist())):
                if whole[i]:
                    kept.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                else:
                    kept.append(b" ".join([raw[b[w] : e[w]] for w in (np.flatnonzero(stay[lo:hi]) + lo).tolist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(np.diff(firsts).astype(np.int64)),
                    pa.array((np.diff(firsts) - np.diff(n_kept)).astype(np.int64)), pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    d, p = rows.alias("d"), per_document.alias("p")
    return d.join(p, (F.col("d.doc_id") == F.col("p.doc_id")) & (F.col("d.key") == F.col("p.key")), "left").select(
        "d.doc_id", "d.text", "p.spans"
    ).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")
