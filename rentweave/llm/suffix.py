"""Repeated byte strings by a sparse enhanced suffix array with common-prefix intervals.

A string of ``length`` bytes is a repeat if it starts at a second place, in any document.
Suffixes are taken at anchors only: in every window of ``length`` bytes the 64-byte gram
of smallest hash. Equal windows have equal anchors, so two equal windows meet in the
group of that gram. An occurrence of an anchor carries the windows that chose it, which
reach from its first window's start to its last window's end (its context).

1. Occurrences with equal contexts form a class. In a class of two or more everything is a
   repeat; that is decided on counts alone, however many copies there are. Those of one document are
   one row, so a line that a text repeats weighs no more there than once.
2. Where a gram has several classes, their contexts (one per class) form a suffix array:
   sorted by what follows from the anchor on, with the common-prefix length of
   neighbours. A stack scan walks its intervals from the deepest up. Each open interval
   keeps its members sorted by what precedes the anchor; when intervals merge, members
   that become neighbours there have ``l`` common bytes before and the interval's depth
   ``d`` after the anchor and differ on both sides (left-extension diversity), so
   ``l + d`` bytes are a maximal repeat within the contexts. All members get their
   strings recorded, not only neighbours in the array.
3. Grams with more than ``MOST_CLASSES`` classes are not put into one task: their windows
   are compared by hash with counts, which splits without limit.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from rentweave.llm.common import (
    RangeHash, as_signed, byte_codes, covered, keyed, mix, owners, slices, stage, utf8, window_min, within_documents, words,
)

GRAM = 64
#: Distinct contexts of one gram that form one suffix array in one task.
MOST_CLASSES = 512
#: Neighbouring windows of a crowded gram's context that are first told apart by their common core.
PIECE = 16
#: Words of the grams that anchor windows of words.
WORD_GRAM = 8
_OCCURRENCE = "anchor long, class long, doc_id long, key long, at int, first int, last int, starts array<int>"
_SPAN = "group_id long, doc_id long, key long, start int, stop int"


def _windows(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[RangeHash, np.ndarray, np.ndarray, np.ndarray]:
    """Range hashes; starts of all windows; their anchors; hash of every gram."""
    hashes = RangeHash(byte_codes(data))
    grams = hashes.grams(GRAM)
    anchor = window_min(grams, length - GRAM + 1)
    starts = np.flatnonzero(within_documents(offsets[:-1], len(data), length))
    return hashes, starts, anchor[starts], grams


def _together(doc: np.ndarray, anchor: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Order in which occurrences of one document, gram and class are neighbours, by place; the first of each; offsets of their lists."""
    order = np.lexsort((kind, anchor, doc))
    doc, anchor, kind = doc[order], anchor[order], kind[order]
    turn = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (kind[1:] != kind[:-1])
    begin = np.flatnonzero(np.r_[True, turn])
    return order, order[begin], pa.array(np.r_[begin, len(order)].astype(np.int32))


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """One row per gram, class of its context and document: the first place, its first and last window start; all places' first ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            hashes, starts, anchor, grams = _windows(data, offsets, length)
            if not len(starts):
                continue
            doc = owners(offsets[:-1], starts) if len(offsets) > 2 else np.zeros(len(starts), np.int64)
            turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))
            lo, hi = np.r_[0, turn + 1], np.r_[turn, len(starts) - 1]
            first, last, at, doc = starts[lo], starts[hi], anchor[lo], doc[lo]
            gram, kind = as_signed(grams[at]), as_signed(hashes(first, last + length))
            base = offsets[doc]
            order, one, lists = _together(doc, gram, kind)
            rows = pa.array(doc[one])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[one]), pa.array(kind[one]), batch.column("doc_id").take(rows), batch.column("key").take(rows),
                    *[pa.array((x - base)[one].astype(np.int32)) for x in (at, first, last)],
                    pa.ListArray.from_arrays(lists, pa.array((first - base)[order].astype(np.int32))),
                ],
                ["anchor", "class", "doc_id", "key", "at", "first", "last", "starts"],
            )

    return docs.mapInArrow(run, _OCCURRENCE)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def interval_scan(before: list[bytes], after: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(member, l, d)``: ``l`` bytes before and ``d`` from the anchor on also occur at another member, ``l + d >= length``.

    ``before`` holds what precedes the anchor, last byte first.
    """
    order = sorted(range(len(after)), key=after.__getitem__)
    depths = [common_prefix(after[a], after[b]) for a, b in zip(order, order[1:])]
    found: list[tuple[int, int, int]] = []

    def join(one: list[tuple[bytes, int]], two: list[tuple[bytes, int]], depth: int) -> list[tuple[bytes, int]]:
        small, large = (one, two) if len(one) < len(two) else (two, one)
        for entry in small:
            place = bisect_left(large, entry)
            for other in large[max(place - 1, 0) : place + 1]:
                left = common_prefix(entry[0], other[0])
                if left + depth >= length:
                    found.append((entry[1], left, depth))
                    found.append((other[1], left, depth))
            large.insert(place, entry)
        return large

    stack: list[tuple[int, list[tuple[bytes, int]]]] = []  # open intervals: depth to the next suffix, members
    for place, member in enumerate(order):
        members = [(before[member], member)]
        depth = depths[place] if place < len(depths) else 0
        while stack and stack[-1][0] >= depth:
            joined_at, earlier = stack.pop()
            members = join(earlier, members, joined_at)
        stack.append((depth, members))
    return found


def _contexts(reps: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Cut the contexts of one occurrence per class out of the texts."""
    wanted = reps.groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("anchor", "class", "n", "at", "first", "last", "crowded")).alias("cuts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), cuts.value_lengths().to_numpy(zero_copy_only=False))
            base = offsets[row]
            first, at, last = (flat.field(c).to_numpy(zero_copy_only=False) + base for c in ("first", "at", "last"))
            raw = data.tobytes()
            before = [raw[a:b] for a, b in zip(first.tolist(), at.tolist())]
            after = [raw[a : b + length] for a, b in zip(at.tolist(), last.tolist())]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *[flat.field(c) for c in ("anchor", "class", "n", "crowded", "at")],
                    batch.column("doc_id").take(rows), batch.column("key").take(rows),
                    pa.array(before, pa.binary()), pa.array(after, pa.binary()),
                ],
                ["anchor", "class", "n", "crowded", "at", "doc_id", "key", "before", "after"],
            )

    d, w = docs.alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.key").eqNullSafe(F.col("w.key"))
    return d.join(w, same).select("d.doc_id", "d.key", "d.text", "w.cuts").mapInArrow(
        run,
        "anchor long, class long, n long, crowded boolean, at int, doc_id long, key long, before binary, after binary",
    )


def _scan_groups(contexts: DataFrame, length: int) -> DataFrame:
    """Spans of the single-occurrence classes of every gram, from its suffix array."""
    groups = contexts.where("not crowded").groupBy("anchor").agg(
        F.collect_list(F.struct("n", "doc_id", "key", "at", "before", "after")).alias("members")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for members in batch.column("members"):
                flat = members.values
                before = [x[::-1] for x in flat.field("before").to_pylist()]
                after = flat.field("after").to_pylist()
                n, doc, key, at = (flat.field(c).to_pylist() for c in ("n", "doc_id", "key", "at"))
                for member, left, depth in set(interval_scan(before, after, length)):
                    if n[member] == 1:  # a class of several occurrences is a repeat as a whole
                        string = before[member][:left][::-1] + after[member][:depth]
                        rows.append((
                            xxhash.xxh64_intdigest(string) - (1 << 63), doc[member], key[member],
                            at[member] - left, at[member] + depth,
                        ))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], ["group_id", "doc_id", "key", "start", "stop"]
                )

    return groups.select("members").mapInArrow(run, _SPAN)


def _count_windows(contexts: DataFrame, length: int) -> DataFrame:
    """Spans for grams with very many contexts: windows that a second context of the gram has too.

    A context's windows are taken in pieces of up to ``PIECE`` neighbouring ones, which have a
    core of ``length - PIECE + 1`` bytes in common. Equal pieces are repeats as a whole. Only
    of pieces that share a core and differ, one of each is opened and counted window by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "after"):
            rows, cores, wholes, starts, windows = [], [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("anchor", "at", "before", "after"))
            for i, (anchor, at, b, a) in enumerate(zip(*columns)):
                hashes = RangeHash(byte_codes(np.frombuffer(b + a, np.uint8)))
                own, left = as_signed(hashes.grams(length)), len(b)
                piece = (left - np.arange(len(own))) // PIECE
                first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
                core = left - piece[first] * PIECE
                found = hashes(core, core + length - PIECE + 1) + piece[first].astype(np.uint64)
                wholes.append(hashes(first, np.r_[first[1:], len(own)] + (length - 1)))
                cores.append(mix(found ^ np.uint64(anchor % (1 << 64))))
                rows.append(np.full(len(first), i))
                starts.append(at - left + first)
                windows += np.split(own, first[1:])
            owner = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_signed(np.concatenate(cores))), pa.array(as_signed(np.concatenate(wholes))), *[batch.column(c).take(owner) for c in ("n", "doc_id", "key")],
                    pa.array(np.concatenate(starts).astype(np.int32)), pa.array(windows, pa.list_(pa.int64())),
                ],
                ["core", "whole", "n", "doc_id", "key", "start", "windows"],
            )

    pieces = stage(
        contexts.where("crowded").mapInArrow(
            run, "core long, whole long, n long, doc_id long, key long, start int, windows array<long>"
        ),
        "pieces",
    )
    kinds = stage(
        pieces.groupBy("core", "whole").agg(
            F.count("*").alias("places"), *[F.first(c).alias(c) for c in ("n", "doc_id", "key", "start", "windows")]
        ),
        "kinds",
    )
    equal = kinds.where("places > 1").select("core", "whole")
    as_a_whole = pieces.where("n = 1").join(equal, ["core", "whole"]).select(
        F.col("whole").alias("group_id"), "doc_id", "key", "start",
        (F.col("start") + F.size("windows") + (length - 1)).alias("stop"),
    )
    shared = stage(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"), "cores")
    opened = kinds.join(shared, "core").select(
        "places", "n", "doc_id", "key", "start", F.posexplode("windows").alias("at", "group_id")
    )
    many = opened.groupBy("group_id").agg(F.count("*").alias("kinds")).where("kinds > 1").select("group_id")
    start = F.col("start") + F.col("at")
    singly = opened.where("places = 1 and n = 1").join(many, "group_id").select(
        "group_id", "doc_id", "key", start.alias("start"), (start + length).alias("stop")
    )
    return as_a_whole.union(singly)


def repeat_groups(docs: DataFrame, length: int = 400) -> DataFrame:
    """``group_id, doc_id, key, start, stop``: every occurrence of every repeat found, in bytes of the text.

    Rows with equal ``group_id`` and size hold the same string. Together the rows of a
    document cover exactly the bytes that lie in a repeat of ``length`` bytes. ``docs`` is
    ``common.keyed``.
    """
    seen = stage(occurrences(docs, length), "anchors")
    rep = F.min(F.struct("doc_id", "key", "at", "first", "last"))
    classes = stage(
        seen.groupBy("anchor", "class").agg(F.sum(F.size("starts")).alias("n"), rep.alias("rep")), "classes"
    )
    whole = seen.join(classes.where("n > 1").select("anchor", "class"), ["anchor", "class"]).select(
        F.col("class").alias("group_id"), "doc_id", "key", (F.col("last") - F.col("first") + length).alias("size"),
        F.explode("starts").alias("start"),
    ).select("group_id", "doc_id", "key", "start", (F.col("start") + F.col("size")).alias("stop"))
    # a table of its own, so that adaptive execution can split the join at a hot gram
    shared = stage(
        classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where(
            "classes > 1 and least = 1"
        ),
        "grams",
    )
    reps = classes.join(shared, "anchor").select(
        "anchor", "class", "n", "rep.*", (F.col("classes") > MOST_CLASSES).alias("crowded")
    )
    contexts = stage(_contexts(reps, docs, length), "contexts")
    return whole.union(_scan_groups(contexts, length)).union(_count_windows(contexts, length))


def _word_windows(batch: pa.RecordBatch, count: int) -> tuple[RangeHash, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Range hashes over the words of a batch; their starts and ends in the text, their documents and the documents' first ones."""
    data, offsets = utf8(batch.column("text"))
    starts, ends, firsts = words(data, offsets)
    hashes = RangeHash(RangeHash(byte_codes(data))(starts, ends))
    doc = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
    return hashes, starts - offsets[doc], ends - offsets[doc], doc, firsts


def word_repeats(docs: DataFrame, count: int) -> DataFrame:
    """``doc_id, key, start, stop``: together the bytes of all passages of ``count`` words that start at a second place.

    Passages are equal if their words are, whatever stands between the words. Windows of
    ``count`` words meet by anchors and classes as windows of bytes do; where a gram has
    several classes, the windows of one context per class are counted by hash, at most
    ``count - WORD_GRAM + 1`` for a context. ``docs`` is ``common.keyed``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts, ends, doc, firsts = _word_windows(batch, count)
            at = np.flatnonzero(within_documents(firsts[:-1], len(starts), count))
            if not len(at):
                continue
            grams = hashes.grams(WORD_GRAM)
            anchor = window_min(grams, count - WORD_GRAM + 1)[at]
            turn = np.flatnonzero((anchor[1:] != anchor[:-1]) | (doc[at][1:] != doc[at][:-1]))
            lo, hi = np.r_[0, turn + 1], np.r_[turn, len(at) - 1]
            first, last = at[lo], at[hi]
            gram, kind = as_signed(grams[anchor[lo]]), as_signed(hashes(first, last + count))
            order, one, lists = _together(doc[first], gram, kind)
            rows = pa.array(doc[first[one]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram[one]), pa.array(kind[one]), batch.column("doc_id").take(rows), batch.column("key").take(rows),
                    *[pa.array((x - firsts[doc[first]])[one].astype(np.int32)) for x in (first, last)],
                    *[
                        pa.ListArray.from_arrays(lists, pa.array(x[order].astype(np.int32)))
                        for x in (starts[first], ends[last + count - 1])
                    ],
                ],
                ["anchor", "class", "doc_id", "key", "first", "last", "starts", "stops"],
            )

    def open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, starts, ends, _, firsts = _word_windows(batch, count)
            cuts = batch.column("cuts")
            flat = cuts.flatten()
            row = np.repeat(np.arange(batch.num_rows), cuts.value_lengths().to_numpy(zero_copy_only=False))
            first, last = (flat.field(c).to_numpy(zero_copy_only=False) + firsts[row] for c in ("first", "last"))
            n = last - first + 1
            cut = np.repeat(np.arange(len(n)), n)
            at = first[cut] + np.arange(len(cut)) - np.repeat(np.cumsum(n) - n, n)
            rows = pa.array(row[cut])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(as_signed(hashes(at, at + count))), flat.field("n").take(pa.array(cut)),
                    batch.column("doc_id").take(rows), batch.column("key").take(rows),
                    *[pa.array(x.astype(np.int32)) for x in (starts[at], ends[at + count - 1])],
                ],
                ["window", "n", "doc_id", "key", "start", "stop"],
            )

    place = "doc_id long, key long, start int, stop int"
    seen = stage(
        docs.mapInArrow(
            run, "anchor long, class long, doc_id long, key long, first int, last int, starts array<int>, stops array<int>"
        ),
        "word_anchors",
    )
    rep = F.min(F.struct("doc_id", "key", "first", "last"))
    classes = stage(
        seen.groupBy("anchor", "class").agg(F.sum(F.size("starts")).alias("n"), rep.alias("rep")), "word_classes"
    )
    # tables of their own, so that adaptive execution can split the joins at a hot gram, class or window
    several = stage(classes.where("n > 1").select("anchor", "class"), "word_several")
    whole = seen.join(several, ["anchor", "class"]).select(
        "doc_id", "key", F.explode(F.arrays_zip("starts", "stops")).alias("place")
    ).select("doc_id", "key", F.col("place.starts").alias("start"), F.col("place.stops").alias("stop"))
    shared = stage(
        classes.groupBy("anchor").agg(F.count("*").alias("classes"), F.min("n").alias("least")).where(
            "classes > 1 and least = 1"
        ).select("anchor"),
        "word_grams",
    )
    wanted = classes.join(shared, "anchor").select("n", "rep.*").groupBy("doc_id", "key").agg(
        F.collect_list(F.struct("n", "first", "last")).alias("cuts")
    )
    d, w = docs.alias("d"), wanted.alias("w")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & F.col("d.key").eqNullSafe(F.col("w.key"))
    windows = stage(
        d.join(w, same).select("d.doc_id", "d.key", "d.text", "w.cuts").mapInArrow(
            open_windows, "window long, n long, " + place
        ),
        "word_windows",
    )
    many = stage(windows.groupBy("window").agg(F.count("*").alias("places")).where("places > 1").select("window"), "word_many")
    return whole.union(windows.where("n = 1").join(many, "window").select("doc_id", "key", "start", "stop"))


def _with_spans(docs: DataFrame, length: int) -> DataFrame:
    spans = stage(repeat_groups(keyed(docs), length).select("doc_id", "key", "start", "stop").distinct(), "spans")
    per_document = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = keyed(docs).alias("d")
    p = per_document.alias("p")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.key").eqNullSafe(F.col("p.key"))
    return rows.join(p, same, "left").select("d.doc_id", "d.key", "d.text", "p.spans")


def removed_mask(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and the mask of bytes in one of the row's spans."""
    data, offsets = utf8(batch.column("text"))
    spans = batch.column("spans")
    flat = spans.flatten()
    sizes = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    base = np.repeat(offsets[:-1], sizes)
    start, stop = (flat.field(c).to_numpy(zero_copy_only=False) + base for c in ("start", "stop"))
    return data, offsets, covered(start, stop, len(data))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """``doc_id, key, n_bytes, n_removed, n_spans, kept``: the bytes of every text that lie in no repeat.

    Judged on the input, same document included; null text is empty. Rows that share a
    doc_id are documents of their own; equal rows are repeats of each other. An empty
    table gives an empty result; texts under ``length`` bytes are kept whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets, gone = removed_mask(batch)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = offsets[:-1][offsets[:-1] < offsets[1:]]
            begins[inner] = gone[inner]
            total, runs = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
            a, b = offsets[:-1], offsets[1:]
            raw = [data[x:y][~gone[x:y]].tobytes() for x, y in zip(a.tolist(), b.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array(b - a), pa.array(total[b] - total[a]),
                    pa.array(runs[b] - runs[a]), pa.array(raw, pa.binary()),
                ],
                ["doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return _with_spans(docs, length).mapInArrow(
        run, "doc_id long, key long, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def cut_repeats(docs: DataFrame, length: int = 400, passage: int | None = None) -> DataFrame:
    """``docs`` with the repeats cut out of ``text``, whole characters only; ``n_chars`` is counted anew.

    Repeats have ``length`` bytes or, if given, ``passage`` words. Other columns and the number
    of rows stay; null text stays null.
    """
    found = repeat_groups(keyed(docs), length).select("doc_id", "key", "start", "stop")
    if passage is not None:
        found = found.union(word_repeats(keyed(docs), passage))
    spans = stage(found.distinct(), "spans")
    per_document = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).alias("p")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest"), F.col("`text`").alias("text"),
        F.col("`doc_id`").alias("doc_id"), F.xxhash64(F.col("`text`")).alias("key"),
    ).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.key").eqNullSafe(F.col("p.key"))
    joined = rows.join(per_document, same, "left").select("d.rest", "d.text", "p.spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets, gone = removed_mask(batch)
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            if len(begins):
                sizes = np.diff(np.r_[begins, len(data)])
                gone = np.repeat(np.minimum.reduceat(gone, begins), sizes)
            stay = ~gone
            kept = np.r_[0, np.cumsum(stay)][offsets].astype(np.int32)
            text = pa.StringArray.from_buffers(
                len(kept) - 1, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[stay].tobytes())
            )
            text = pa.compute.if_else(batch.column("text").is_valid(), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), text], ["rest", "text"])

    schema = T.StructType([T.StructField("rest", rows.schema["rest"].dataType), T.StructField("text", T.StringType())])
    cut = joined.mapInArrow(run, schema)
    columns = [
        F.col("text") if c == "text" else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(f"rest.`{c}`")
        for c in docs.columns
    ]
    return cut.select(*columns)
