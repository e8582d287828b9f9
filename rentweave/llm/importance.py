"""Importance resampling towards a target distribution, by hashed word n-grams.

One 256-byte table lower-cases ASCII letters and blanks every separator in UTF-8 text, so
``bytes.split`` yields the words; the crc-32 of an n-gram continues that of its first
words, so no n-gram is ever put together. A task reduces its texts to one Counter of at most
``BUCKETS`` entries, and only these are shuffled; the gains of all buckets, again ``BUCKETS``
numbers, go to all tasks for a second pass that weighs every document. Texts are never
shuffled. The draw adds Gumbel noise of the document's id to its weight and takes the
highest scores by a range-partitioned sort.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rentweave.llm.common import STEP_BYTES, only, slices, stage, utf8
from rentweave.operators.ranking import dense_position

BUCKETS = 10_000
#: Words of the longest n-gram.
LONGEST = 3
#: Digits, letters a-z and all bytes of other characters stay; A-Z become a-z; the rest is blank.
TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Below any random number of 32 bits plus a half: the noise's unit.
_UNIT = 4294967296.0


def _pieces(blanked: bytes, start: int, stop: int) -> Iterator[list[bytes]]:
    """Words of one text in lists of bounded size; a cut falls between words."""
    while start < stop:
        end = min(start + STEP_BYTES, stop)
        if end < stop:
            cut = blanked.find(b" ", end, stop)
            end = stop if cut < 0 else cut
        yield blanked[start:end].split()
        start = end


def features(blanked: bytes, start: int, stop: int, buckets: int = BUCKETS) -> Iterator[tuple[int, list[int]]]:
    """Number of words and buckets of the n-grams of a text, piece by piece."""
    before: list[bytes] = []
    for new in _pieces(blanked, start, stop):
        words, held = before + new, len(before)
        # grams of one size more: the crc of the first words is the seed of the next
        seeds = list(map(crc32, words))
        sizes = [seeds[held:]]
        spaced = [b" " + w for w in words]
        for n in range(1, LONGEST):
            seeds = list(map(crc32, spaced[n:], seeds))
            sizes.append(seeds[max(held - n, 0) :])  # grams that end in a new word
        yield len(new), [c % buckets for c in chain.from_iterable(sizes)]
        before = words[-(LONGEST - 1) :]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        yield batch, data.tobytes().translate(TABLE), offsets


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """Features per bucket over all rows of ``texts(text)``; at most ``BUCKETS`` entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, blanked, offsets in _texts(batches):
            for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                for _, found in features(blanked, start, stop):
                    total.update(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.int32()), pa.array(total.values(), pa.int64())], ["bucket", "n"]
        )

    counted = only(texts, "text").mapInArrow(count, "bucket int, n long")
    return {r.bucket: r.n for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(corpus: dict[int, int], target: dict[int, int]) -> list[int]:
    """Thousandths of the log ratio of target to corpus, smoothed by one per bucket and rounded down."""
    every, wanted = float(sum(corpus.values()) + BUCKETS), float(sum(target.values()) + BUCKETS)
    return [
        math.floor(1000 * math.log((target.get(b, 0) + 1.0) * every / ((corpus.get(b, 0) + 1.0) * wanted)))
        for b in range(BUCKETS)
    ]


def weigh(docs: DataFrame, gains: list[int]) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(np.array(gains, np.int64))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value.tolist()
        for batch, blanked, offsets in _texts(batches):
            out = []
            for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = grams = weight = 0
                for n, found in features(blanked, start, stop):
                    words += n
                    grams += len(found)
                    weight += sum(map(table.__getitem__, found))
                out.append((words, grams, weight))
            columns = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_words", "n_features", "weight"],
            )

    kept = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`text`"))
    return kept.mapInArrow(weights, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int) -> Column:
    """Noise of an id in thousandths, rounded down: the first 32 bits of a SHA-256 as a uniform number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")).cast("binary"), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(_UNIT)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, min_words: int = 20, seed: int = 42) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs(doc_id, text)``; ``rank`` is null where not drawn.

    ``target(text)`` is what the draw should look like. Of the N rows with ``min_words`` words or more,
    ``percent * N // 100`` are drawn, highest scores first, ties by smaller doc_id, then by fewer features.

    A null text has no words, weight 0, and counts in no statistic; a row without a doc_id is weighed
    and counted in the statistics, but has no score, is no part of N and is never drawn. Rows that repeat, or
    share, a doc_id are rows of their own. Without target texts all target counts are 0; an empty
    table gives no rows. Other columns are ignored.
    """
    gains = bucket_gains(bucket_counts(docs), bucket_counts(target))
    weighed = stage(weigh(docs, gains).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "weighed")
    eligible = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    drawn = weighed.where(eligible).count() * percent // 100
    order = [F.desc("score"), F.col("doc_id"), F.col("n_features"), F.col("weight"), F.col("n_words")]
    placed = dense_position(weighed.where(eligible), order, "place")
    rest = weighed.where(~eligible).withColumn("place", F.lit(None).cast("long"))
    rank = F.when(F.col("place") <= drawn, F.col("place")).cast("long")
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
