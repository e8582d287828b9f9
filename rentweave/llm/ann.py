"""Nearest neighbours by a forest of random-projection trees.

Vectors are compared by inner product; a bucket of trees compares angles, so every vector
gets one more component that brings it to the length of the longest, which turns the
largest inner product into the smallest angle (queries get 0 there).

A tree's node splits at the median of the projections of a sample on the line between two of its
vectors. The sample is bounded (``SAMPLE``); every vector of the table is then put into
its leaf of every tree. A query walks all trees through one priority queue of branches
not taken, ordered by the distance to the split passed last or farther up, until the
leaves reached held enough different vectors of the sample. How many are enough is measured,
not set: vectors of the sample are searched for in the sample, and the walk is as long as
they need to find ``RECALL`` of their true neighbours. Clustered vectors need few leaves, vectors
without any clusters most of them. Leaves are met by an equi-join, candidates
are reranked by the exact inner product of the original vectors in double precision.

Equal vectors are one candidate with their ``k + 1`` smallest ids, which is all that a
top-k list with ties to the smaller id can hold of them, so a vector that is repeated
without end costs no more than one. Leaves are read in blocks of bounded size, and Arrow
batches hold one pair of blocks, so memory depends neither on the table nor on the walks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from rentweave.llm.common import bound_batches, stage

TREES = 8
#: Vectors the trees are fitted on, in order of a hash of the vector.
SAMPLE = 20_000
#: Leaves of a tree if they are coarse, and sample vectors of a leaf if they are fine.
COARSE_LEAVES, FINE_LEAF = 64, 16
#: Share of the true neighbours that the walk must find for the vectors it is measured with, and how many those are.
RECALL, MEASURED = 0.95, 64
#: A visit of a leaf costs about as much as this many scored vectors.
VISIT = 50
#: Samples up to this size are searched whole.
SMALL = 256
#: Candidates, and queries, of one leaf that are scored in one block.
BLOCK = 2_048
#: Queries whose walks are found at a time, and leaves of theirs that go on in one batch: each takes the query's vector with it.
QUERIES, REACHED = 64, 8_192


@dataclass
class Tree:
    """``normal[i]``, ``bias[i]`` of inner node ``i``; ``child[i]``: inner node, or ``-1 - leaf``; ``held``: sample rows per leaf."""

    normal: np.ndarray
    bias: np.ndarray
    child: list[list[int]]
    held: list[np.ndarray]


def fit_tree(sample: np.ndarray, seed: int, most: int) -> Tree:
    """Split at medians until at most ``most`` vectors are left; equal projections end a branch."""
    rng = np.random.default_rng(seed)
    normals, biases, children, held = [], [], [], []

    def leaf(rows: np.ndarray) -> int:
        held.append(rows)
        return -len(held)

    def grow(rows: np.ndarray) -> int:
        if len(rows) <= most:
            return leaf(rows)
        for _ in range(4):
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            size = np.linalg.norm(normal)
            if size > 0:
                normal = normal / size
                at = sample[rows] @ normal
                bias = np.median(at)
                left = at < bias
                if left.any() and not left.all():
                    me = len(normals)
                    normals.append(normal)
                    biases.append(bias)
                    children.append([0, 0])
                    children[me] = [grow(rows[left]), grow(rows[~left])]
                    return me
        return leaf(rows)

    root = grow(np.arange(len(sample)))
    if root < 0:  # a single leaf
        return Tree(np.zeros((1, sample.shape[1])), np.zeros(1), [[-1, -1]], held)
    return Tree(np.array(normals), np.array(biases), children, held)


def leaves_of(tree: Tree, points: np.ndarray) -> np.ndarray:
    """Leaf number of every point."""
    child = np.array(tree.child)
    node, going = np.zeros(len(points), np.int64), np.arange(len(points))
    while len(going):
        n = node[going]
        right = (points[going] * tree.normal[n]).sum(1) >= tree.bias[n]
        node[going] = child[n, right.astype(np.int64)]
        going = going[node[going] >= 0]
    return -1 - node


def walk(trees: list[Tree], sides: list[list[float]]) -> Iterator[tuple[int, int]]:
    """``(tree, leaf)`` in the order of one priority queue; ``sides[t][node]``: how far the query is beyond a split."""
    queue = [(0.0, t, 0) for t in range(len(trees))]
    heapq.heapify(queue)
    while queue:
        margin, t, node = heapq.heappop(queue)
        side, child = sides[t], trees[t].child
        while node >= 0:
            far = side[node]
            near = far >= 0
            heapq.heappush(queue, (max(margin, abs(far)), t, child[node][1 - near]))
            node = child[node][near]
        yield t, -1 - node


@dataclass
class Forest:
    """Trees over ``size`` sample vectors; a query goes on until its leaves held ``reach`` different ones of them."""

    trees: list[Tree]
    size: int
    reach: int

    def sides(self, queries: np.ndarray) -> list[list[list[float]]]:
        """Of each query (a unit vector), by tree and node."""
        per_tree = [(queries @ tree.normal[:, :-1].T - tree.bias).tolist() for tree in self.trees]
        return [list(rows) for rows in zip(*per_tree)]

    def leaves(self, sides: list[list[float]]) -> list[tuple[int, int]]:
        seen, left, out = np.zeros(self.size, bool), self.reach, []
        for t, leaf in walk(self.trees, sides):
            out.append((t, leaf))
            held = self.trees[t].held[leaf]
            left -= len(held) - int(np.count_nonzero(seen[held]))
            if left <= 0:
                break
            seen[held] = True
        return out


def _measure(forest: Forest, sample: np.ndarray, k: int, most: int = MEASURED) -> tuple[int, float, float]:
    """Different sample vectors that a walk must have held for ``RECALL``; then leaves, and share of rows scored, per query."""
    size = len(sample)
    asked = np.linspace(0, size - 1, min(most, size)).astype(np.int64)
    plain = sample[:, :-1]
    queries = plain[asked] / np.linalg.norm(plain[asked], axis=1, keepdims=True)
    scores = queries @ plain.T
    scores[np.arange(len(asked)), asked] = -np.inf
    wanted = np.argpartition(-scores, k, axis=1)[:, :k]
    # by the number of different vectors asked for: true neighbours held, leaves visited and vectors scored when the walk ends
    found, visits, scored = (np.zeros((len(asked), size + 1)) for _ in range(3))
    for i, sides in enumerate(forest.sides(queries)):
        seen, near = np.zeros(size, bool), np.zeros(size, bool)
        near[wanted[i]] = True
        distinct = hits = n = total = 0
        for t, leaf in walk(forest.trees, sides):
            held = forest.trees[t].held[leaf]
            new = held[~seen[held]]
            seen[new] = True
            hits, n, total = hits + int(near[new].sum()), n + 1, total + len(held)
            ends = slice(distinct + 1, distinct + len(new) + 1)
            found[i, ends], visits[i, ends], scored[i, ends] = hits, n, total
            distinct += len(new)
            if distinct == size:
                break
    enough = found.mean(0) >= RECALL * k
    reach = int(np.argmax(enough)) if enough.any() else size
    return reach, float(visits[:, reach].mean()), float(scored[:, reach].mean()) / size


def fit_forest(sample: np.ndarray, rows: int, k: int) -> Forest:
    """Trees with coarse or fine leaves, whichever let a query of ``rows`` vectors end sooner, and the reach they need."""
    size = len(sample)
    best: tuple[float, Forest] | None = None
    for most in sorted({max(FINE_LEAF, size // COARSE_LEAVES), FINE_LEAF}, reverse=True):
        forest = Forest([fit_tree(sample, seed, most) for seed in range(TREES)], size, size)
        if size <= max(SMALL, 4 * k):
            return forest
        # fine leaves take long to measure: a few queries tell whether they are worth it
        for asked in (MEASURED // 4, MEASURED):
            reach, visits, share = _measure(forest, sample, k, asked)
            cost = share * rows + VISIT * visits
            if best is not None and cost >= best[0]:
                break
        else:
            forest.reach = max(reach, min(size, k + 1))
            best = cost, forest
    return best[1]


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[
        column.offsets[0].as_py() : column.offsets[-1].as_py()
    ].reshape(len(column), dims).astype(np.float64)


def _lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.c_[vectors / longest, rest / longest]


def reached(forest: Forest, batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    """``leaf, query_id, query`` for every leaf that a query's walk comes to, in batches of bounded size.

    A walk may come to thousands of leaves, so neither the rows of a batch of queries nor the sides of its
    queries, a Python number for each node of the forest, are held at once.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            v = _vectors(part.column("embedding"), dims)
            # the component that lengthens the others is 0 here
            found = [forest.leaves(sides) for sides in forest.sides(v / np.linalg.norm(v, axis=1, keepdims=True))]
            rows = np.repeat(np.arange(len(v)), [len(f) for f in found])
            leaf = np.array([l * TREES + t for f in found for t, l in f], np.int64)
            for start in range(0, len(rows), REACHED):
                some = pa.array(rows[start : start + REACHED])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[start : start + REACHED]), part.column("vec_id").take(some), part.column("embedding").take(some)],
                    ["leaf", "query_id", "query"],
                )


def usable(vector: Column) -> Column:
    """Not null, some component, all of them finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors(vec_id, embedding)`` where ``is_query``.

    The query's own row is no candidate; equal scores go to the smaller vec_id. Null, empty
    and zero vectors, and those with null or non-finite components, take no part, nor do
    rows without an id or, of repeated ids, any but the smallest vector. All vectors must
    have the size that most have; others take no part. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bound_batches(spark)  # a row of two blocks has about a megabyte, and a batch of many such rows is held four times over
    given = vectors.select(F.col("`vec_id`"), F.col("`embedding`")).where(
        F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    ).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = given.groupBy(F.size("embedding").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = sizes.dims
    given = stage(given.where(F.size("embedding") == dims), "vectors")
    order = Window.partitionBy("embedding").orderBy("vec_id")
    # the k + 1 smallest ids of each different vector; cut down before the shuffle
    few = given.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    distinct = stage(few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "distinct")
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = float(distinct.agg(F.max(F.sqrt(square))).first()[0])
    drawn = distinct.select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(SAMPLE)
    sample = _lengthened(np.array([r[0] for r in drawn.collect()], np.float64), longest)
    sent = spark.sparkContext.broadcast(fit_forest(sample, distinct.count(), k))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value.trees
        for batch in batches:
            points = _lengthened(_vectors(batch.column("embedding"), dims), longest)
            for t, tree in enumerate(trees):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaves_of(tree, points) * TREES + t), batch.column("embedding"), batch.column("ids")],
                    ["leaf", "embedding", "ids"],
                )

    element = distinct.schema["embedding"].dataType.elementType.simpleString()
    placed = distinct.mapInArrow(place, f"leaf long, embedding array<{element}>, ids array<long>")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reached(sent.value, batches, dims)

    asked = given.where(is_query).mapInArrow(ask, f"leaf long, query_id long, query array<{element}>")
    asked = stage(asked, "asked")

    def in_blocks(rows: DataFrame, key: str, block: str, members: Column, name: str) -> DataFrame:
        """A leaf's rows in blocks, so that no task holds a whole leaf however full it is."""
        counts = rows.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        return rows.join(counts, "leaf").groupBy(
            "leaf", F.pmod(F.xxhash64(key), "blocks").alias(block)
        ).agg(F.collect_list(members).alias(name))

    candidates = in_blocks(stage(placed, "leaves"), "embedding", "cell", F.struct("embedding", "ids"), "members")
    questions = in_blocks(asked, "query_id", "part", F.struct("query_id", "query"), "queries")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members, queries in zip(batch.column("members"), batch.column("queries")):
                c = _vectors(members.values.field("embedding"), dims)
                ids = members.values.field("ids").to_pylist()
                q = _vectors(queries.values.field("query"), dims)
                who = queries.values.field("query_id").to_pylist()
                near, out = q @ c.T, []
                for i, me in enumerate(who):
                    row = near[i]
                    rows = np.arange(len(row)) if len(row) <= k + 1 else np.argpartition(row, -(k + 1))[-(k + 1) :]
                    rows = np.flatnonzero(row >= row[rows].min() - 1e-9)  # ties, however the product was rounded
                    score = (c[rows] * q[i]).sum(axis=1)  # the same sum for a vector in every block
                    out += heapq.nsmallest(k, ((-s, v, me) for s, j in zip(score.tolist(), rows) for v in ids[j] if v != me))
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[2] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                            pa.array([-r[0] for r in out], pa.float64()),
                        ],
                        ["query_id", "vec_id", "score"],
                    )

    scored = questions.join(candidates, "leaf").select("members", "queries").mapInArrow(
        score, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )

