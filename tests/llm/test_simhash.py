"""SimHash components (op8), near copies and graph components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from brute import groups, passage

from rentweave.llm import simhash
from rentweave.llm.components import components


def plain_fingerprint(text: str | None) -> int:
    return simhash.fingerprint_of((text or "").encode().translate(simhash._LOWER).split(), 3)


def test_golay_covers():
    points = np.random.default_rng(1).integers(0, 1 << 63, 4000, dtype=np.uint64)
    near = points ^ np.uint64(1 << 40) ^ np.uint64(1 << 3)
    flips = simhash.ball(1)
    a = simhash.anchor_of(points[:, None] ^ flips)
    b = simhash.anchor_of(near[:, None] ^ flips)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    assert np.mean([len(set(x)) for x in a.tolist()]) < 16


def test_components_awkward(awkward):
    docs, rows = awkward
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.fp & (2**64 - 1), r.doc_id is None, r.doc_id or 0) for r in got) == sorted(
        (plain_fingerprint(t), i is None, i or 0) for i, t in rows)
    fps = sorted({plain_fingerprint(t) for _, t in rows})
    root = groups(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    least: dict = {}
    for i, t in rows:
        if i is not None:
            r = root[plain_fingerprint(t)]
            least[r] = min(least.get(r, i), i)
    assert all(r.component_id == least.get(root[r.fp & (2**64 - 1)]) for r in got)


@pytest.mark.parametrize("most", [simhash.MOST_COMPARED, 2])
def test_links(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MOST_COMPARED", most)  # crowded anchors give the same links
    r = random.Random(2)
    fps = [r.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        fps.append(r.choice(fps) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (r.random() < 0.3) << r.randrange(64))
    fps = sorted(set(fps))
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2)
    found = {r.node: r.component for r in components(edges).collect()}
    want = groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert all(found.get(n, n) == want[n] for n in signed)
    assert len(set(want.values())) < len(signed)


def test_components_of_chains(spark):
    r = random.Random(3)
    ids = list(range(300))
    r.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:201])) + [(ids[200 + k], ids[250]) for k in range(50)] + [(7, 7)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    pairs = {frozenset(e) for e in edges}
    want = groups(sorted(ids[:251]), lambda a, b: frozenset((a, b)) in pairs)
    assert got == {n: want[n] for n in got} and len(got) == 251


def test_one_of_each_group_stays(spark, awkward):
    docs, rows = awkward
    base = passage(400, 20).split()
    near = list(base)
    for place in (10, 100, 200, 300):
        near[place] = "other"
    far = [w if k % 5 else f"other{k}" for k, w in enumerate(base)]
    more = [(100, " ".join(base)), (101, " ".join(near)), (102, " ".join(far)), (103, " ".join(base).upper())]
    extra = spark.createDataFrame([(i, t, "en", "s", 1, "k", 7, 1) for i, t in more], docs.schema)
    kept = simhash.keep_one_of_each(docs.union(extra))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 102 in ids and 101 not in ids and 103 not in ids
    assert ids.count(3) == 1 and ids.count(4) == 2  # equal rows leave one, other texts stay
    assert len({5, 6} & set(ids)) == 1  # null and empty texts are alike
    assert {8, 9, 13, 17, 19} <= set(ids)


def test_empty_tables(spark, no_documents):
    assert simhash.near_duplicates(no_documents).count() == 0
    assert simhash.keep_one_of_each(no_documents).count() == 0
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_groups(texts: list[str], shingle: int = 5) -> dict:
    """Brute force over whole shingle sets, connected at a similarity of 0.8."""
    sets = [{tuple(w[i : i + shingle]) for i in range(max(len(w) - shingle + 1, 1))} for w in (t.split() for t in texts)]

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    return groups(list(range(len(texts))), linked)


def star(n: int, size: int, changes: int, seed: int) -> list[str]:
    """A text and ``n`` copies with single words changed, last of them the text itself."""
    r = random.Random(seed)
    base = passage(size, seed).split()
    out = []
    for k in range(n):
        words = list(base)
        for place in r.sample(range(size), changes):
            words[place] = f"changed{k}x{place}"
        out.append(" ".join(words))
    return [*out, " ".join(base)]


@pytest.mark.parametrize("size, changes", [(300, 5), (300, 6), (150, 3)])
def test_copies_of_one_text_that_are_not_copies_of_each_other(spark, size, changes):
    texts = star(300, size, changes, 30 + changes) + star(4, size, 1, 99) + [passage(size, 77)]
    # crowds that share most of their text without being near copies
    texts += [passage(size // 2, 50) + " " + passage(size // 2, 1000 + k) for k in range(60)]
    want = similar_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one_of_each(docs).collect()}
    assert kept == set(want.values())


def test_crowds_without_a_common_text(spark):
    # without the text itself what is left is connected by chance pairs, or not at all
    texts = star(80, 300, 5, 31)[:-1] + star(40, 300, 3, 32)[:-1]
    want = similar_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_one_of_each(docs).collect()} == set(want.values())
