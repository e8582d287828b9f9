"""Document fingerprints from Lempel-Ziv phrases.

A text's UTF-8 bytes are parsed from left to right into phrases: each is the shortest piece that is
not yet in the dictionary and joins it. Texts that compress well together share phrases, so the
overlap of their phrase sets is a likeness much like a compression distance, but it can be
estimated from minimum hashes: a fingerprint holds the ``SIGNATURE`` smallest 32-bit hashes of
the set in ascending order, and the share of common ones among the smallest of two fingerprints together
estimates the sets' Jaccard index. It is exact where both sets are smaller than a fingerprint.

Every document is also compared with its neighbour, the next by descending id, and with an
edited text whose end comes from that neighbour. Documents are dealt out in blocks of
consecutive ids whose bounds are taken from ids alone; the first document of a block is
also sent to the block before it, so texts cross the network once and no task needs another's.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rentweave.llm.common import mix, shuffle_partitions, slices, utf8

#: Hashes of a fingerprint.
SIGNATURE = 128
#: Text of a block and of a shuffle partition, about.
BLOCK_BYTES, PARTITION_BYTES = 4 << 20, 32 << 20
#: Blocks whose bounds all tasks hold and which Spark draws by a sample of 100 ids each; a larger corpus has larger blocks.
MOST_BLOCKS = 1 << 14
#: Results handed over at once.
RESULTS = 512
_SEED, _PRIME, _BITS = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1  # FNV-1a


class Phrases:
    """The dictionary of an incremental parse as a trie.

    ``table[node * 256 + byte]`` is the phrase one byte longer; ``codes[node]`` is the FNV-1a hash of a
    phrase, which continues that of the phrase without its last byte. Every byte is one look-up.
    """

    def __init__(self) -> None:
        self.table: dict[int, int] = {}
        self.codes = [_SEED]
        self.node = 0

    def feed(self, data: bytes) -> None:
        table, codes, node = self.table, self.codes, self.node
        get = table.get
        for byte in data:
            key = node << 8 | byte
            child = get(key)
            if child is None:
                table[key] = len(codes)
                codes.append((codes[node] ^ byte) * _PRIME & _BITS)
                node = 0
            else:
                node = child
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.codes), self.node

    def rewind(self, mark: tuple[int, int]) -> None:
        """Forget the phrases added since ``mark``."""
        size, self.node = mark
        for _ in range(len(self.codes) - size):
            self.table.popitem()
        del self.codes[size:]

    def signature(self) -> np.ndarray:
        """Smallest different hashes of all phrases, ascending; empty for an empty text."""
        hashes = (mix(np.array(self.codes[1:], np.uint64)) >> np.uint64(32)).astype(np.uint32)
        if len(hashes) > 4 * SIGNATURE:  # enough of the smallest to hold that many different ones, most likely
            least = np.unique(np.partition(hashes, 2 * SIGNATURE)[: 2 * SIGNATURE])
            if len(least) >= SIGNATURE:
                return least[:SIGNATURE]
        return np.unique(hashes)[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard index of two phrase sets, 0 to 1; two empty fingerprints are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIGNATURE]
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.searchsorted(common, both[-1], "right")) / len(both)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


@dataclass
class _Document:
    """A parsed document: ``phrases`` stands at the end of the part that its edited text keeps."""

    doc_id: int | None
    key: int
    copies: int
    text: str
    kept: bytes
    phrases: Phrases
    signature: np.ndarray


def _decoded(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def _open(doc_id: int | None, key: int, copies: int, data: bytes) -> _Document:
    text = _decoded(data)
    stays = len(text) - len(text) // 3
    kept, end = _encoded(text[:stays]), _encoded(text[stays:])
    phrases = Phrases()
    phrases.feed(kept)
    mark = phrases.mark()
    phrases.feed(end)
    signature = phrases.signature()
    phrases.rewind(mark)
    return _Document(doc_id, key, copies, text, kept, phrases, signature)


def _close(doc: _Document, after: _Document) -> tuple:
    """A result row, once the next document is known."""
    n = len(doc.text)
    head = _encoded(after.text[: n // 3])
    doc.phrases.feed(head)
    edited = doc.phrases.signature()
    return (
        doc.doc_id, n, hashlib.sha256(doc.kept + head).hexdigest(), as_text(doc.signature), as_text(edited),
        likeness(doc.signature, edited), likeness(doc.signature, after.signature), doc.copies,
    )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, copies long"
)
_TYPES = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.int64()]
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``block, lead, doc_id, key, copies, text`` in order, with the text as bytes."""
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        raw, offsets = data.tobytes(), offsets.tolist()
        columns = [batch.column(c).to_pylist() for c in ("block", "lead", "doc_id", "key", "copies")]
        for i, row in enumerate(zip(*columns)):
            yield *row, raw[offsets[i] : offsets[i + 1]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of whole blocks whose rows come in order, their lead last."""
    out: list[tuple] = []
    current: _Document | None = None
    for block, lead, doc_id, key, copies, data in _rows(batches):
        if current is None:
            if lead:  # a further copy of a lead that has closed its block
                continue
        elif not lead and (current.doc_id, current.key) == (doc_id, key):
            current.copies += copies
            continue
        after = _open(doc_id, key, copies, data)
        if current is not None:
            out.append(_close(current, after))
        current = None if lead else after
        if len(out) >= RESULTS:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _deal(bounds):
    """Task that gives every row its block, merges equal rows of a batch and sends blocks' first rows ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = bounds.value
        for batch in batches:
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
            copies: dict[tuple, int] = {}
            first: dict[tuple, int] = {}
            for i, (doc_id, key) in enumerate(zip(ids, keys)):
                at = (doc_id is None, 0 if doc_id is None else ~doc_id, key)
                first.setdefault(at, i)
                copies[at] = copies.get(at, 0) + 1
            rows, block, lead, n = [], [], [], []
            for at, i in first.items():
                mine = bisect_right(starts, at) - 1
                rows.append(i)
                block.append(mine)
                lead.append(False)
                n.append(copies[at])
                if starts[mine] == at:
                    rows.append(i)
                    block.append((mine - 1) % len(starts))
                    lead.append(True)
                    n.append(0)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block, pa.int32()), pa.array(lead), taken.column("doc_id"), taken.column("key"),
                    pa.array(n, pa.int64()), taken.column("text"),
                ],
                ["block", "lead", "doc_id", "key", "copies", "text"],
            )

    return run


def _descending() -> list[Column]:
    return [F.col("doc_id").desc_nulls_last(), F.col("key")]


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for ``docs(doc_id, text)``.

    The next document is the one of next smaller doc_id, after the last one the first; a single document is
    its own next. The edited text replaces a third of the code points, at the end, by as many (or all) of the
    next document's first ones.

    A null text is an empty one, with an empty fingerprint. Rows without a doc_id come last, texts that share a
    doc_id follow each other in the order of a hash of the text, and rows of equal doc_id and text are one document,
    whose result each of them gets. A text is parsed whole; the parse holds its phrases, about one per
    5 to 10 bytes of it. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    given = given.select("doc_id", F.xxhash64("text").alias("key"), "text")
    ids = given.groupBy("doc_id", "key").agg(F.max(F.octet_length("text").cast("long")).alias("size"))
    total = ids.agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).first()
    if not total.n:
        return spark.createDataFrame([], RESULT).drop("copies")
    blocks = max(1, min(MOST_BLOCKS, -(-total.size // BLOCK_BYTES)))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.bitwise_not("doc_id"), F.lit(0)).alias("down"), "key")
    ranges = ids.repartitionByRange(blocks, *_descending()).groupBy(F.spark_partition_id()).agg(F.min(order).alias("start"))
    bounds = spark.sparkContext.broadcast(sorted(tuple(r.start) for r in ranges.collect()))
    dealt = given.mapInArrow(_deal(bounds), "block int, lead boolean, doc_id long, key long, copies long, text string")
    partitions = max(shuffle_partitions(spark), -(-total.size // PARTITION_BYTES))
    ordered = dealt.repartition(partitions, "block").sortWithinPartitions("block", "lead", *_descending())
    found = ordered.mapInArrow(_compare, RESULT)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
