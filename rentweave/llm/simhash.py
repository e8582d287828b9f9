"""SimHash near-duplicates by anchor-point covering.

The 64 bits of a fingerprint are three blocks of 23, 23 and 18 bits. The words of the binary
Golay code (23 bits, every word within 3 bits of exactly one code word) are the anchors of
a block; an anchor of the whole space is one code word per block, so its covering radius is 9.

Two fingerprints at most ``t`` bits apart have a point between them that is at most
``ceil(t / 2)`` from both, and the anchor covering that point is within the covering
radius plus ``ceil(t / 2)`` of both. So a fingerprint is replicated to the anchors that
cover the points of its own ball of that size (about 14 anchors for ``t = 2``), and
comparing per anchor misses no link. Equal fingerprints are one node throughout.

Near copies by shingle similarity (``near_copies``) differ in far more than two bits: at a
similarity of 0.8 about ten of 64. There every document also gets ``VIEWS`` fingerprints of
small samples of its shingles, which near copies often share exactly, and what meets at
an anchor is compared by its exact shingle sets.

An anchor with more than ``MOST_COMPARED`` fingerprints is not compared pair by pair:
its fingerprints meet at the points of their balls instead, which is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rentweave.llm.common import RangeHash, byte_codes, mix, only, slices, stage, utf8, within_documents, words
from rentweave.llm.components import components

SEED = 42
#: Fixed value: generator polynomial of the binary Golay code of length 23.
_GOLAY = 0b110001110101
_BLOCKS = ((0, 23), (23, 23), (46, 18))
#: Distinct fingerprints of one anchor that are compared with each other in one task.
MOST_COMPARED = 1024
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error of each syndrome."""

    def syndrome(v: int) -> int:
        for bit in range(22, 10, -1):
            if v >> bit & 1:
                v ^= _GOLAY << (bit - 11)
        return v

    low = np.array([syndrome(v) for v in range(1 << 12)], np.int64)
    high = np.array([syndrome(v << 12) for v in range(1 << 11)], np.int64)
    error = np.zeros(1 << 11, np.int64)
    for n in range(4):
        for places in combinations(range(23), n):
            e = sum(1 << p for p in places)
            error[low[e & 0xFFF] ^ high[e >> 12]] = e
    return low, high, error


_LOW, _HIGH, _ERROR = _golay_tables()


def anchor_of(points: np.ndarray) -> np.ndarray:
    """The anchor covering each 64-bit point: nearest code word of every block, side by side."""
    out = np.zeros_like(points)
    for shift, width in _BLOCKS:
        v = (points >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        v = v.astype(np.int64)
        word = v ^ _ERROR[_LOW[v & 0xFFF] ^ _HIGH[v >> 12]]
        # the code is systematic in its upper 12 bits, which name the word
        out = (out << np.uint64(12)) | (word >> 11).astype(np.uint64)
    return out


def ball(radius: int) -> np.ndarray:
    """Differences of at most ``radius`` bits, nothing changed first."""
    return np.array(
        [sum(1 << p for p in places) for n in range(radius + 1) for places in combinations(range(64), n)], np.uint64
    )


def fingerprint_of(words: list[bytes], shingle: int) -> int:
    """Majority bits over the hashes of all shingles of one document; the plain form of ``fingerprints``."""
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + shingle]) for i in range(max(len(words) - shingle + 1, 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def _hashes(text: bytes, shingle: int) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, SEED)]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp``: 64-bit SimHash of every whole text, A-Z lower-cased.

    Shingles of ``shingle`` words are hashed with XXH64 (seed 42), repeats included; fewer
    words are one shingle; no word, empty or null text gives 0. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            out = np.zeros(batch.num_rows, np.uint64)
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                hashes = np.array(_hashes(raw[a:b], shingle), ">u8")
                ones = np.zeros(64, np.int64)
                for lo in range(0, len(hashes), 65536):
                    part = hashes[lo : lo + 65536]
                    ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
                out[i] = np.packbits(2 * ones > len(hashes)).view(">u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def replicas(points: DataFrame, threshold: int) -> DataFrame:
    """``anchor, fp``: every fingerprint at every anchor where it can meet another one."""
    flips = ball((threshold + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 20) // len(flips))
            for lo in range(0, len(fps), step):
                own = fps[lo : lo + step]
                anchors = np.sort(anchor_of(own[:, None] ^ flips[None, :]), axis=1)
                first = np.ones(anchors.shape, bool)
                first[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
                rows = np.repeat(own, first.sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchors[first].view(np.int64)), pa.array(rows.view(np.int64))], ["anchor", "fp"]
                )

    return points.select("fp").mapInArrow(run, "anchor long, fp long")


def _links_in_groups(groups: DataFrame, threshold: int) -> DataFrame:
    """Per anchor, an edge from each fingerprint to the smallest one it is connected with there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column("fps"):
                fps = np.unique(np.asarray(group.values.to_numpy(zero_copy_only=False)).view(np.uint64))
                near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= threshold
                label = np.arange(len(fps))
                while True:
                    least = np.where(near, label[None, :], len(fps)).min(axis=1)
                    if (least == label).all():
                        break
                    label = least
                moved = np.flatnonzero(label != np.arange(len(fps)))
                a.append(fps[moved])
                b.append(fps[label[moved]])
            if a:
                a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def _links_at_points(points: DataFrame, threshold: int) -> DataFrame:
    """Links of fingerprints that share a point of their balls; minima per point, no comparison within a group.

    For an even threshold all fingerprints at one point are linked with each other.
    """
    flips = ball(threshold // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 20) // len(flips))
            for lo in range(0, len(fps), step):
                own = fps[lo : lo + step]
                at = (own[:, None] ^ flips[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at.view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))], ["at", "fp"]
                )

    met = points.select("fp").distinct().mapInArrow(run, "at long, fp long")
    first = met.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("last")).where("b < last").drop("last")
    return met.join(first, "at").where("fp <> b").select(F.col("fp").alias("a"), "b")


def fingerprint_links(points: DataFrame, threshold: int) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints with the connectivity of "at most ``threshold`` bits apart".

    ``threshold`` must be even: crowded anchors rely on it.
    """
    if threshold % 2:
        raise ValueError("an even threshold is needed")
    placed = stage(replicas(points, threshold), "anchors")
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    small = placed.join(sizes.where(F.col("n") <= MOST_COMPARED), "anchor").groupBy("anchor").agg(
        F.collect_list("fp").alias("fps")
    )
    crowded = placed.join(sizes.where(F.col("n") > MOST_COMPARED), "anchor")
    return stage(
        _links_in_groups(small, threshold).union(_links_at_points(crowded, threshold)).distinct(), "links"
    )


def near_duplicates(docs: DataFrame, threshold: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    Fingerprints at most ``threshold`` bits apart are linked; the component is named by
    the smallest doc_id reachable. Documents without words share fingerprint 0 and are
    linked like any other. Repeated doc_ids keep their rows; a null doc_id never names a
    component, which is null if no member has an id. An empty table gives an empty result.
    """
    found = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(found.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    connected = components(fingerprint_links(nodes, threshold)).withColumnRenamed("node", "fp")
    placed = nodes.join(connected, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "node")
    least = placed.groupBy("component").agg(F.min("node").alias("component_id"))
    named = placed.select("fp", "component").join(least, "component").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- near copies by similarity

VIEWS = 24
#: Turns in which texts are compared with one text of the largest component they meet, before what is left is compared exactly.
TURNS = 3
#: Shingles sampled for one view: the smallest under as many hash functions.
PER_VIEW = 5
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, VIEWS * PER_VIEW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = ball(1)


def _shingle_hashes(batch: pa.RecordBatch, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a batch's lower-cased words, and the first one of each document.

    A text of fewer words is one shingle, one without words has none.
    """
    data, offsets = utf8(batch.column("text"))
    data = np.frombuffer(data.tobytes().translate(_LOWER), np.uint8)
    starts, ends, firsts = words(data, offsets)
    hashes = RangeHash(RangeHash(byte_codes(data))(starts, ends))
    at = np.flatnonzero(within_documents(firsts[:-1], len(starts), shingle))
    n = np.diff(firsts)
    few = np.flatnonzero((n > 0) & (n < shingle))
    begin = np.r_[at, firsts[few]]
    stop = np.r_[at + shingle, firsts[few] + n[few]]
    order = np.argsort(begin, kind="stable")
    begin, stop = begin[order], stop[order]
    return hashes(begin, stop), np.searchsorted(begin, firsts)


def _fingerprints_of(hashes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """SimHash of consecutive groups of hashes; ``groups`` holds the first of each, none is empty."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = np.add.reduceat(bits, groups, axis=0, dtype=np.int32)
    n = np.diff(np.r_[groups, len(hashes)])[:, None]
    return np.packbits(2 * ones > n, axis=1).view(">u8").ravel().astype(np.uint64)


def _meeting_points(docs: DataFrame, shingle: int) -> DataFrame:
    """``point, node``: anchors of the whole fingerprint's ball and the home anchor of every view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, firsts = _shingle_hashes(batch, shingle)
            some = np.flatnonzero(np.diff(firsts))
            if not len(some):
                continue
            groups = firsts[some]
            nodes = batch.column("node").to_numpy(zero_copy_only=False)[some]
            whole = np.zeros(len(some), np.uint64)
            ends = np.r_[groups[1:], len(hashes)]
            lo = 0
            while lo < len(some):  # bit columns of a bounded number of shingles at a time
                hi = max(int(np.searchsorted(ends, groups[lo] + (1 << 18), "right")), lo + 1)
                whole[lo:hi] = _fingerprints_of(hashes[groups[lo] : ends[hi - 1]], groups[lo:hi] - groups[lo])
                lo = hi
            anchors = np.sort(anchor_of(whole[:, None] ^ _FLIPS[None, :]), axis=1)
            first = np.ones(anchors.shape, bool)
            first[:, 1:] = anchors[:, 1:] != anchors[:, :-1]
            points, owner = [mix(anchors[first])], [np.repeat(nodes, first.sum(axis=1))]
            for view in range(VIEWS):
                least = [
                    mix(np.minimum.reduceat(hashes * f, groups))
                    for f in _FACTORS[view * PER_VIEW : (view + 1) * PER_VIEW]
                ]
                sample = np.stack(least, axis=1).ravel()
                home = anchor_of(_fingerprints_of(sample, np.arange(len(some)) * PER_VIEW))
                points.append(mix(home ^ (np.uint64(view + 1) << np.uint64(48))))
                owner.append(nodes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(points).view(np.int64)), pa.array(np.concatenate(owner))], ["point", "node"]
            )

    return docs.mapInArrow(run, "point long, node long")


def _shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles``: the sorted distinct 32-bit shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, firsts = _shingle_hashes(batch, shingle)
            short = (hashes >> np.uint64(32)).astype(np.uint32)
            sets = [np.unique(short[a:b]).tobytes() for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def _similar(pairs: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                one, two = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(both >= similarity * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "a long, b long")


def _leads(placed: DataFrame, crowded: DataFrame) -> DataFrame:
    """``point, leads``: the smallest and largest node of a point and, if crowded, the one whose points hold most texts.

    The last is the text that the others were copied from rather than one of the copies.
    """
    weight = stage(crowded.groupBy("node").agg(F.sum("n").alias("weight")), "weights")
    heavy = crowded.join(weight, "node").groupBy("point").agg(F.max(F.struct("weight", "node"))["node"].alias("heavy"))
    ends = placed.groupBy("point").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    return ends.join(heavy, "point", "left").select(
        "point", F.array_distinct(F.array_compact(F.array("low", "high", "heavy"))).alias("leads")
    )


def _pairs_with_main(there: DataFrame, turn: int) -> DataFrame:
    """``a, b``: at each point of ``there(point, node, component)``, those outside its largest component with one text inside.

    That text is another one each turn; one pair per row at most.
    """
    draw = F.xxhash64(F.lit(turn), "node")
    parts = there.groupBy("point", "component").agg(
        F.count("*").alias("size"), F.min(F.struct(draw.alias("draw"), "node"))["node"].alias("lead")
    )
    main = stage(
        parts.groupBy("point").agg(F.max(F.struct("size", "component", "lead")).alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").select("point", "main.component", "main.lead"),
        "main",
    )
    outside = there.alias("t").join(main.alias("m"), "point").where(F.col("t.component") != F.col("m.component"))
    return outside.select(F.least("t.node", "m.lead").alias("a"), F.greatest("t.node", "m.lead").alias("b")).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, component`` after ``links(a, b)`` between texts, by the components they connect."""
    name = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(
        F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b")
    )
    up = stage(components(stage(between.where("a <> b").distinct(), "between")), "up").select(
        F.col("node").alias("component"), F.col("component").alias("above")
    )
    new = links.select("a").union(links.select("b")).distinct().withColumnRenamed("a", "node").join(labels, "node", "left_anti")
    every = labels.select("node", "component").union(new.select("node", F.col("node").alias("component")))
    return stage(every.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component")), "labels")


def _prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """``point, node, n, at``: every set of ``n`` shingles at those of its rarest shingles that a similar set must share.

    ``at`` is the shingle's place in the set's order.

    Sets of that similarity have ``similarity * n`` shingles in common, so in one order of all
    shingles they share one of the first ``n - ceil(similarity * n) + 1``. Shingles of one set only
    come first in the order and are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles"):
            values = [np.frombuffer(x, np.uint32).astype(np.int64) for x in batch.column("shingles").to_pylist()]
            n = np.array([len(v) for v in values])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values)), batch.column("node").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.repeat(n, n))],
                ["point", "node", "n"],
            )

    every = stage(sets.mapInArrow(run, "point long, node long, n long"), "shingles")
    # a table of its own, so that adaptive execution can split the join at a hot shingle
    held = stage(every.groupBy("point").agg(F.count("*").alias("held")).where("held > 1"), "held")
    met = every.join(held, "point").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("held", "point"))).alias("met"))
    wanted = F.col("n") - F.ceil(similarity * F.col("n") - F.lit(1e-6)) + 1
    taken = F.greatest(wanted - (F.col("n") - F.size("met")), F.lit(0)).cast("int")
    alone = F.col("n") - F.size("met")
    return met.select(F.posexplode(F.slice("met", F.lit(1), taken)).alias("place", "m"), "node", "n", alone.alias("alone")).select(
        "m.point", "node", "n", (F.col("alone") + F.col("place")).alias("at")
    )


def _pairs_between(placed: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: pairs of ``placed(point, node, n, at, component)`` that share a point but no component.

    At a point, whatever is outside the component with most nodes is paired with every other one, if enough
    shingles come after this one in both: the first shingle that similar sets share has that many behind it.
    """
    parts = placed.groupBy("point", "component").agg(F.count("*").alias("size"))
    mixed = stage(
        parts.groupBy("point").agg(F.max(F.struct("size", "component"))["component"].alias("main"), F.count("*").alias("parts"))
        .where("parts > 1").select("point", "main"),
        "mixed",
    )
    there = stage(placed.join(mixed, "point"), "there")
    outside = stage(there.where("component <> main").drop("main"), "outside")
    x, y = there.alias("x"), outside.alias("y")
    shared = similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n"))
    fits = (
        (F.col("x.component") != F.col("y.component"))
        & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - F.lit(1e-6))
        & (F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= shared - F.lit(1e-6))
    )
    return x.join(y, (F.col("x.point") == F.col("y.point")) & fits).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")
    ).distinct()


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``node, component``: texts (by ``xxhash64``) connected by shingle-set similarity of at least ``similarity``.

    Equal texts are one node. ``VIEWS`` points make it all but certain that similar texts meet.
    What meets is connected as comparing all texts of a point would: first every text is
    compared with two or three leads of the point, then what is outside a point's largest component with one
    text after another inside it; that is linear and joins most groups. Where
    a point of more than three texts still holds several components, its texts meet again at
    their rarest shingles, which loses no similar pair, and are compared across components.
    Texts without a partner are not listed. Null text is like the empty one.
    """
    texts = docs.select(
        F.xxhash64(F.coalesce(F.col("`text`"), F.lit(""))).alias("node"), F.coalesce(F.col("`text`"), F.lit("")).alias("text")
    )
    placed = stage(_meeting_points(texts, shingle).distinct(), "points")
    # tables of their own, so that adaptive execution can split the joins at a hot point
    sizes = stage(placed.groupBy("point").agg(F.count("*").alias("n")).where("n > 3"), "sizes")
    crowded = stage(placed.join(sizes, "point"), "crowded")
    leads = stage(_leads(placed, crowded), "leads")
    pairs = stage(
        placed.join(leads, "point").select(F.col("node").alias("a"), F.explode("leads").alias("b"))
        .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "pairs",
    )
    members = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node")
    sets = stage(
        _shingle_sets(texts.join(members, "node"), shingle).groupBy("node").agg(F.first("shingles").alias("shingles")), "sets"
    )

    def links(pairs: DataFrame) -> DataFrame:
        compared = (
            pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("one")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("two")), "b")
            .select("a", "b", "one", "two")
        )
        return stage(_similar(compared, similarity), "similar")

    linked = links(pairs)
    labels = stage(components(linked), "labels")

    def open_points() -> DataFrame:
        return crowded.join(labels, "node", "left").select("point", "node", F.coalesce("component", "node").alias("component"))

    for turn in range(TURNS):
        more = links(stage(_pairs_with_main(stage(open_points(), "there"), turn), "pairs"))
        if not more.limit(1).count():
            break
        labels = _joined(labels, more)
    there = open_points()
    mixed = stage(
        there.groupBy("point").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high"), "mixed"
    )
    open_nodes = stage(there.join(mixed, "point").select("node", "component").distinct(), "open")
    if not open_nodes.limit(1).count():
        return labels
    again = _prefixes(sets.join(open_nodes, "node", "left_semi"), similarity).join(open_nodes, "node")
    more = links(stage(_pairs_between(stage(again, "prefixes"), similarity), "pairs"))
    return _joined(labels, more)


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` without near copies: of each group the row with the smallest doc_id stays (null last).

    Equal rows, and rows that share a doc_id and text, leave one. Columns are those of ``docs``.
    """
    groups = near_copies(docs, similarity, shingle)
    node = F.xxhash64(F.coalesce(F.col("`text`"), F.lit("")))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), node.alias("node"))
    grouped = named.select(F.col("row.doc_id").alias("doc_id"), "node").join(groups, "node", "left").select(
        F.coalesce("component", "node").alias("component"), F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node").alias("who")
    )
    best = grouped.groupBy("component").agg(F.min("who").alias("who")).select("who.doc_id", "who.node")
    n, b = named.alias("n"), best.alias("b")
    kept = n.join(b, (F.col("n.node") == F.col("b.node")) & F.col("n.row.doc_id").eqNullSafe(F.col("b.doc_id")), "left_semi")
    return kept.dropDuplicates(["node"]).select("row.*")
