"""Hard negatives (op11) against brute force."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentweave.llm import negatives


@pytest.mark.parametrize("shape", [(1, 1, 1), (2, 2, 2), (3, 5, 7), (37, 6, 101), (64, 64, 64), (0, 3, 4), (5, 0, 3)])
@pytest.mark.parametrize("leaf", [1, 2, 8])
def test_strassen_is_exact(shape, leaf):
    r = np.random.default_rng(sum(shape) + leaf)
    for most in (9, 1 << 25, 1 << 62):  # doubles, integers, integers that wrap
        a, b = r.integers(-most, most, shape[:2]), r.integers(-most, most, shape[1:])
        want = [[sum(int(x) * int(y) for x, y in zip(row, column)) for column in b.T] for row in a]
        wrapped = [[(x + (1 << 63)) % (1 << 64) - (1 << 63) for x in row] for row in want]
        assert negatives.strassen(a, b, leaf).tolist() == wrapped


def test_heaps_merge_in_any_order():
    r = np.random.default_rng(3)
    rows, scores, ids = r.integers(0, 5, 400), r.integers(-3, 4, 400), r.permutation(400)
    want = [sorted((-s, i) for q, s, i in zip(rows, scores, ids) if q == row)[:7] for row in range(5)]
    for pieces in (1, 13):
        heaps = negatives.Heaps(6, 7)
        for part in np.array_split(r.permutation(400), pieces):
            heaps.offer(rows[part], scores[part], ids[part])
        at, s, i = heaps.entries()
        assert [[(-s, i) for q, s, i in zip(at, s, i) if q == row] for row in range(6)] == [*want, []]


def plain(rows, every, positives=5, negatives_=10, low=30, high=90):
    kept: dict = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[i] = min(kept.get(i, (label, v)), (label, v))
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in kept.items()}
    whole = {i: r for i, r in whole.items() if sum(x * x for x in r[1]) < 1 << 63}
    out: Counter = Counter()
    for a, (label, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in whole.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(-s, i) for s, i, other in scored if other != label and low * -p <= 100 * -s <= high * -p]
            for place, (s, i) in enumerate(fits[:negatives_], 1):
                out[(a, positive, place, i, -p, s)] += 1
    return out


def mined(table, every=10):
    found = negatives.hard_negatives(table, F.col("vec_id") % every == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return Counter(map(tuple, found.collect()))


@pytest.mark.parametrize("tile", [None, (3, 16)])
def test_against_brute_force(spark, monkeypatch, tile):
    if tile:
        monkeypatch.setattr(negatives, "TILE_ANCHORS", tile[0])
        monkeypatch.setattr(negatives, "TILE_ROWS", tile[1])
        monkeypatch.setattr(negatives, "LEAF", 2)
        monkeypatch.setattr(negatives, "ROUND", 20)
    r = np.random.default_rng(7)
    centres = r.normal(size=(4, 12))
    rows = [(i, [float(x) for x in np.float32(centres[i % 4] + r.normal(size=12))], int(r.integers(0, 5))) for i in range(300)]
    rows += [(1000 + i, rows[10][1], 1) for i in range(60)]  # one vector many times, under one label and others
    rows += [(1100 + i, rows[10][1], i % 3) for i in range(60)]
    table = spark.createDataFrame([(*x, "clash", 4) for x in rows], "vec_id long, embedding array<float>, label int, row string, rank int")
    want = plain(rows, 10)
    assert len(want) > 500
    assert mined(table) == want


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0, 0.5], 1), (1, [1.0, 2.0, 0.25], 1), (2, [0.5, 1.0, 0.0], 2), (3, [0.5, 1.0, 0.0], 2), (3, [0.5, 1.0, 0.0], 2),
        (4, None, 1), (5, [1.0, None, 1.0], 1), (6, [nan, 1.0, 1.0], 2), (7, [inf, 1.0, 1.0], 2), (8, [1.0, 2.0, 0.5], None),
        (None, [1.0, 2.0, 0.5], 1), (9, [], 2), (10, [0.0, 0.0, 0.0], 1), (20, [], 1), (11, [0.9], 2), (12, [0.7, 0.9, 0.1, 5.0], 3),
        (30, [1.0, 1.0], 1), (30, [0.5, 0.5], 0), (40, [-1.0, -2.0, -0.5], 2), (50, [1e30, 0.0, 0.0], 1), (60, [1e7, 3e6, 0.0], 1),
        (13, [1e7, 1e6, 0.0], 1), (14, [6e6, 1e5, 0.0], 2), (-10, [1.0, 2.0, 0.5], -3), (-11, [0.9, 1.9, 0.5], -3),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(table) == plain(rows, 10)
    assert mined(table.where("vec_id = 0")) == Counter()
    assert mined(table.limit(0)) == Counter()
    assert mined(table.withColumn("embedding", F.lit(None).cast("array<double>"))) == Counter()
