"""Hard negatives by Strassen products of anchor and candidate tiles.

Components are quantised to integers, so a score is exact. Anchors are taken in rounds of
bounded size: a round's anchors go to all tasks, every task multiplies them with its
candidates tile by tile and keeps heaps of bounded size, and the heaps of all tasks merge in
Spark. A round runs twice: the first pass, over candidates of the anchor's label, finds the
positives; the second fills one heap per anchor and positive with the best scores inside
that positive's window. Nothing is paired up in a shuffle; work is anchors times rows, which
an exact answer over all rows needs.

Tiles are multiplied by Strassen's recursion, padded with zeros to even sizes at each level.
All arithmetic is modulo 2**64, in which additions, subtractions and products are exact as long
as the final score fits 64 bits, whatever happens in between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rentweave.llm.common import only, shared_folder, stage

#: Components become ``floor(SCALE * x)``.
SCALE = 256
#: Anchors of one round, about; they and their positives are what the driver and each task hold.
ROUND = 8_192
#: Anchors and candidates of one tile.
TILE_ANCHORS, TILE_ROWS = 256, 4_096
#: A dimension up to which tiles are multiplied directly.
LEAF = 32
#: Doubles hold sums of products exactly up to here.
_EXACT = float(1 << 53)
_NONE = np.iinfo(np.int64).min
_FAR = np.iinfo(np.int64).max


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of int64 matrices: in doubles where these are provably exact, else in integers."""
    inner = a.shape[1]
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    most = [max(abs(int(m.min())), abs(int(m.max()))) for m in (a, b)]
    if most[0] * most[1] * inner < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def _even(m: np.ndarray) -> np.ndarray:
    rows, columns = m.shape[0] & 1, m.shape[1] & 1
    return np.pad(m, ((0, rows), (0, columns))) if rows or columns else m


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices with seven products per level instead of eight."""
    rows, inner, columns = a.shape[0], a.shape[1], b.shape[1]
    if min(rows, inner, columns) <= max(leaf, 1):
        return _direct(a, b)
    a, b = _even(a), _even(b)
    r, k, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:r, :k], a[:r, k:], a[r:, :k], a[r:, k:]
    b11, b12, b21, b22 = b[:k, :c], b[:k, c:], b[k:, :c], b[k:, c:]
    out = np.empty((2 * r, 2 * c), np.int64)
    c11, c12, c21, c22 = out[:r, :c], out[:r, c:], out[r:, :c], out[r:, c:]
    m = strassen(a11 + a22, b11 + b22, leaf)
    c11[:] = m
    c22[:] = m
    m = strassen(a21 + a22, b11, leaf)
    c21[:] = m
    c22 -= m
    m = strassen(a11, b12 - b22, leaf)
    c12[:] = m
    c22 += m
    m = strassen(a22, b21 - b11, leaf)
    c11 += m
    c21 += m
    m = strassen(a11 + a12, b22, leaf)
    c11 -= m
    c12 += m
    c22 += strassen(a21 - a11, b11 + b12, leaf)
    c11 += strassen(a12 - a22, b21 + b22, leaf)
    return out[:rows, :columns]


class Heaps:
    """The ``k`` best (score, id) of each of ``n`` rows: higher scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores = np.full((n, k), _NONE, np.int64)
        self.ids = np.full((n, k), _FAR, np.int64)
        self.filled = np.zeros((n, k), bool)

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge entries, any number per row; what cannot enter a full heap is passed over first."""
        if not len(rows):
            return
        worst, last = self.scores[rows, -1], self.ids[rows, -1]
        enters = ~self.filled[rows, -1] | (scores > worst) | ((scores == worst) & (ids < last))
        rows, scores, ids = rows[enters], scores[enters], ids[enters]
        if not len(rows):
            return
        touched = np.unique(rows)
        held = self.filled[touched]
        rows = np.r_[rows, np.repeat(touched, held.sum(1))]
        scores = np.r_[scores, self.scores[touched][held]]
        ids = np.r_[ids, self.ids[touched][held]]
        order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises, without overflow
        rows, scores, ids = rows[order], scores[order], ids[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < self.k
        rows, place = rows[best], place[best]
        self.scores[rows, place], self.ids[rows, place] = scores[best], ids[best]
        self.filled[rows, place] = True

    def least(self) -> np.ndarray:
        """A score below which nothing enters a row's heap."""
        return np.where(self.filled[:, -1], self.scores[:, -1], _NONE)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = np.nonzero(self.filled)[0]
        return rows, self.scores[self.filled], self.ids[self.filled]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Quantised components, a row per vector; shorter vectors end in zeros, longer ones are cut where anchors are zero."""
    offsets = column.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    flat = np.floor(SCALE * flat).astype(np.int64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims), np.int64)
    for i, (start, size) in enumerate(zip(offsets, np.minimum(sizes, dims))):
        out[i, :size] = flat[start : start + size]
    return out


def _tiles(batches: Iterator[pa.RecordBatch], dims: int, by_label: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``ids, labels, vectors`` of bounded tiles; with ``by_label`` each tile has one label."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            part = batch.slice(start, TILE_ROWS)
            ids, labels = (part.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            vectors = _matrix(part.column("embedding"), dims)
            if by_label:
                for label in np.unique(labels):
                    mine = labels == label
                    yield ids[mine], labels[mine], vectors[mine]
            else:
                yield ids, labels, vectors


def _quantised_square(vector: Column) -> Column:
    """Squared length of the quantised vector: the bound of all its scores."""

    def add(total: Column, x: Column) -> Column:
        q = F.floor(x.cast("double") * SCALE).cast("double")
        return total + q * q

    return F.aggregate(vector, F.lit(0.0), add)


def _find_positives(anchors: dict, dims: int, k: int):
    """Task of the first pass: the ``k`` best other rows of each anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        heaps = Heaps(len(a["ids"]), k)
        for ids, labels, vectors in _tiles(batches, dims, True):
            mine = np.flatnonzero(a["labels"] == labels[0])
            for start in range(0, len(mine), TILE_ANCHORS):
                rows = mine[start : start + TILE_ANCHORS]
                scores = strassen(a["vectors"][rows], np.ascontiguousarray(vectors.T))
                if scores.shape[1] > k + 1:  # only what may be among the best of this tile
                    near = np.partition(scores, -(k + 1), axis=1)[:, -(k + 1)]
                else:
                    near = np.full(len(rows), _NONE, np.int64)
                r, c = np.nonzero(scores >= np.maximum(near, heaps.least()[rows])[:, None])
                other = a["ids"][rows[r]] != ids[c]
                r, c = r[other], c[other]
                heaps.offer(rows[r], scores[r, c], ids[c])
        rows, scores, ids = heaps.entries()
        yield pa.RecordBatch.from_arrays(
            [pa.array(a["ids"][rows]), pa.array(ids), pa.array(scores)], ["anchor_id", "positive_id", "positive_score"]
        )

    return run


def _fill_windows(anchors: dict, dims: int, k: int):
    """Task of the second pass: per anchor and positive the ``k`` best other-label rows inside the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = anchors.value
        slots = a["low"].shape[1]
        heaps = Heaps(len(a["ids"]) * slots, k)
        for ids, labels, vectors in _tiles(batches, dims, False):
            flipped = np.ascontiguousarray(vectors.T)
            for start in range(0, len(a["ids"]), TILE_ANCHORS):
                rows = np.arange(start, min(start + TILE_ANCHORS, len(a["ids"])))
                scores = strassen(a["vectors"][rows], flipped)
                # from the lowest score that any window of the anchor still takes to the highest
                low = np.maximum(a["low"][rows], heaps.least().reshape(-1, slots)[rows])
                r, c = np.nonzero((scores >= low.min(1)[:, None]) & (scores <= a["high"][rows].max(1)[:, None]))
                differs = a["labels"][rows[r]] != labels[c]
                r, c = r[differs], c[differs]
                found = scores[r, c]
                for s in range(slots):
                    fits = (found >= low[r, s]) & (found <= a["high"][rows[r], s])
                    heaps.offer(rows[r[fits]] * slots + s, found[fits], ids[c[fits]])
        at, scores, ids = heaps.entries()
        rows, slot = at // slots, at % slots
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a["ids"][rows]), pa.array(a["positives"][rows, slot]), pa.array(ids),
                pa.array(a["positive_scores"][rows, slot]), pa.array(scores),
            ],
            ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    return run


def _best(rows: DataFrame, keys: list[str], score: str, ident: str, k: int) -> DataFrame:
    """Merge the tasks' heaps: the ``k`` best of each key, cut down before the shuffle as well."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), ident)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _windows(anchors: dict[str, np.ndarray], positives: pa.Table, slots: int, low: int, high: int) -> None:
    """Adds each anchor's positives and the scores ``low/100*p .. high/100*p`` to the anchors of a round."""
    n = len(anchors["ids"])
    order = np.argsort(anchors["ids"])
    mine = positives.column("anchor_id").to_numpy()
    rows = order[np.searchsorted(anchors["ids"], mine, sorter=order)] if n else np.zeros(0, np.int64)
    slot = positives.column("rank").to_numpy() - 1
    given = positives.column("positive_score").to_numpy()
    ids, scores = np.zeros((n, slots), np.int64), np.zeros((n, slots), np.int64)
    # an empty slot has an empty window
    least, most = np.full((n, slots), _FAR, np.int64), np.full((n, slots), _NONE, np.int64)
    ids[rows, slot], scores[rows, slot] = positives.column("positive_id").to_numpy(), given
    # ceil(low * p / 100) and floor(high * p / 100) without leaving 64 bits
    whole, part = given // 100, given % 100
    least[rows, slot] = whole * low - (-part * low) // 100
    most[rows, slot] = whole * high + part * high // 100
    anchors |= {"positives": ids, "positive_scores": scores, "low": least, "high": most}


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors(vec_id, embedding, label)``.

    An anchor's positives are its best other rows of the same label; the negatives of anchor
    and positive are the best rows of another label with ``low * positive <= 100 * negative <=
    high * positive``, ranked by score, ties by smaller vec_id. ``is_anchor`` may use all three columns.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor
    do vectors whose scores could leave 64 bits (quantised squared length of 2**63 or more). Of rows
    that share a vec_id the one of smallest label and vector counts. Vectors of different sizes
    are compared as if the shorter one ended in zeros; an empty vector scores 0. Equal vectors are
    separate candidates. An anchor without a positive or negative has no rows; an empty table
    gives none. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad
    kept = only(vectors, "vec_id", "label", "embedding").where(good)
    kept = kept.where(_quantised_square(F.col("embedding")) < float(1 << 63))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    kept = kept.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
    rows = stage(kept.select("vec_id", "row.label", "row.embedding"), "rows")
    sizes = rows.where(is_anchor).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not sizes.n:
        return spark.createDataFrame([], result)
    dims, rounds = sizes.dims, -(-sizes.n // ROUND)
    folder = shared_folder(spark, "negatives")
    for number in range(rounds):
        part = rows.where(is_anchor).where(F.pmod(F.xxhash64("vec_id"), F.lit(rounds)) == number).toArrow()
        anchors = {
            "ids": part.column("vec_id").to_numpy(), "labels": part.column("label").to_numpy(),
            "vectors": _matrix(part.column("embedding").combine_chunks(), dims),
        }
        sent = spark.sparkContext.broadcast(anchors)
        near = rows.mapInArrow(_find_positives(sent, dims, positives), "anchor_id long, positive_id long, positive_score long")
        _windows(anchors, _best(near, ["anchor_id"], "positive_score", "positive_id", positives).toArrow(), positives, low, high)
        sent.unpersist()
        sent = spark.sparkContext.broadcast(anchors)
        filled = rows.mapInArrow(
            _fill_windows(sent, dims, negatives),
            "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long",
        )
        best = _best(filled, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
        best.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.parquet(f"{folder}/round={number}")
        sent.unpersist()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return spark.read.schema(result + ", round int").parquet(folder).select(*names)
