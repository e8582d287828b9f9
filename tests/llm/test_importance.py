"""Importance resampling (op13) against plain counting."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest

from rentweave.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_features(text):
    words = WORD.findall(lower(text))
    grams = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(crc32(g.encode()) % 10_000 for g in grams)


def plain(rows, targets, percent=5, least=20):
    corpus, target = Counter(), Counter()
    for _, t in rows:
        corpus.update(plain_features(t)[1])
    for t in targets:
        target.update(plain_features(t)[1])
    every, wanted = sum(corpus.values()), sum(target.values())
    out, able = [], []
    for i, t in rows:
        n, found = plain_features(t)
        weight = sum(
            c * math.floor(1000 * math.log((target[b] + 1) * (every + 10_000) / ((corpus[b] + 1) * (wanted + 10_000)))) for b, c in found.items()
        )
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= least:
                able.append((-score, i, found.total(), len(out)))
        out.append([i, found.total(), weight, score, None])
    for place, (*_, at) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[at][4] = place
    return Counter(map(tuple, out))


def drawn(table, targets, **how):
    found = importance.resample(table, targets, **how)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    return Counter(map(tuple, found.collect()))


TARGETS = ["Alpha beta, w1x1 w7920x1 gamma!", None, "", "one TWO 12 é中文字 É"]


def targets(spark, texts=TARGETS):
    return spark.createDataFrame([(n, t, n) for n, t in enumerate(texts)], "item_id long, text string, weight int")


@pytest.mark.parametrize("step", [None, 64])
def test_against_plain_counting(spark, awkward, monkeypatch, step):
    if step:
        monkeypatch.setattr(importance, "STEP_BYTES", step)  # words of a text come in many pieces
    table, rows = awkward
    wide = table.withColumnRenamed("node", "score")
    assert drawn(wide, targets(spark), percent=40, min_words=3) == plain(rows, TARGETS, 40, 3)
    assert drawn(wide, targets(spark)) == plain(rows, TARGETS)


def test_separators_and_cases(spark):
    every = "".join(map(chr, range(0x250))) + "  ퟿\U0001f600"
    rows = [(1, every), (2, "a-b_c'd\x7fe\tF\r\nG\x00h"), (3, "Ééa ÀB"), (4, "x" * 5000 + " y"), (5, "1 2 3 1 2 3 1 2 3"), (-6, "!?")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert drawn(table, targets(spark), percent=100, min_words=0) == plain(rows, TARGETS, 100, 0)


def test_ties_go_to_smaller_ids_and_nothing_is_lost(spark):
    # the same id twice has the same noise: rows of equal score
    rows = [(i % 40, "same words here " * 9) for i in range(80)] + [(None, "same words here " * 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = drawn(table, targets(spark), percent=33)
    assert got == plain(rows, TARGETS, 33) and sum(r[4] is not None for r in got.elements()) == 80 * 33 // 100


def test_empty_tables(spark, no_documents):
    assert drawn(no_documents, targets(spark)) == Counter()
    rows = [(1, "a b c " * 10), (2, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert drawn(table, targets(spark, []), percent=100) == plain(rows, [], 100)
