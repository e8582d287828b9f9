"""Word passages (op1) and byte strings (op9) against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from brute import without_copies, without_repeats

import corpus_pipeline
from rentweave.llm import rlz, suffix
from rentweave.llm.common import keyed


def copies_of(docs, window=13):
    found = rlz.remove_copies(docs, window).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in found)


def repeats_of(docs, length):
    found = suffix.remove_repeats(docs, length).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)


def patchwork(n: int, seed: int) -> list[tuple[int, str]]:
    """Documents put together from parts of each other at all offsets, with single words changed."""
    r = random.Random(seed)
    docs: list[list[str]] = []
    for _ in range(n):
        w = [f"{r.randrange(9000)}{r.choice('abc')}" for _ in range(r.randrange(5, 60))]
        for _ in range(r.randrange(4)):
            if docs:
                source = r.choice(docs)
                a = r.randrange(len(source))
                part = source[a : a + r.randrange(8, 50)]
                if r.random() < 0.3 and part:
                    part[r.randrange(len(part))] = "changed"
                at = r.randrange(len(w))
                w[at:at] = part
        docs.append(w)
    return [(r.randrange(10**9), " ".join(w)) for w in docs]


def test_copies_awkward(awkward):
    docs, rows = awkward
    assert copies_of(docs) == without_copies(rows, 13)


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_patchwork(spark, seed):
    rows = patchwork(60, seed)
    assert copies_of(spark.createDataFrame(rows, "doc_id long, text string")) == without_copies(rows, 13)


def test_factors_are_copies(spark):
    rows = patchwork(60, 3)
    words = {i: t.split() for i, t in rows}
    found = rlz.factors(keyed(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert any(r.n_words > 13 for r in found)
    for r in found:
        assert r.ref_doc_id < r.doc_id and r.n_words >= 13
        if r.ref_start is not None:
            assert words[r.doc_id][r.start : r.start + r.n_words] == words[r.ref_doc_id][r.ref_start : r.ref_start + r.n_words]


def test_repeats_awkward(awkward):
    docs, rows = awkward
    assert repeats_of(docs, 400) == without_repeats(rows, 400)


@pytest.mark.parametrize("most", [suffix.MOST_CLASSES, 2])
def test_repeats_patchwork(spark, monkeypatch, most):
    monkeypatch.setattr(suffix, "MOST_CLASSES", most)  # crowded grams give the same result
    rows = patchwork(50, 4)
    assert repeats_of(spark.createDataFrame(rows, "doc_id long, text string"), 100) == without_repeats(rows, 100)


def test_repeat_groups_hold_one_string(spark):
    rows = patchwork(50, 5)
    text = {i: t.encode() for i, t in rows}
    strings: dict = {}
    for r in suffix.repeat_groups(keyed(spark.createDataFrame(rows, "doc_id long, text string")), 100).collect():
        strings.setdefault(r.group_id, set()).add(text[r.doc_id][r.start : r.stop])
    assert strings and all(len(s) == 1 for s in strings.values())


def test_a_repeated_line_is_one_row_of_a_document(spark, monkeypatch):
    line = "the very common line of them all\n"
    rows = [(k, f"begin{k} " + line * 300 + f"end{k}") for k in range(6)] + [(9, line * 40), (9, line * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    seen = suffix.occurrences(keyed(docs), 400)
    assert sum(len(r.starts) for r in seen.collect()) > 1000  # places
    assert seen.count() < 50  # rows, which were as many as places
    assert repeats_of(docs, 400) == without_repeats(rows, 400)

    staged = {}
    monkeypatch.setattr(suffix, "stage", lambda df, name, write=suffix.stage: staged.setdefault(name, write(df, name)))
    got = Counter((x.doc_id, x.text or "") for x in suffix.cut_repeats(docs, 400, passage=51).collect())
    assert got == without_passages(rows, 51, 400)
    assert staged["word_anchors"].count() < 50


def test_interval_scan_is_exhaustive():
    r = random.Random(6)
    for _ in range(200):
        n, length = r.randrange(2, 9), 8
        before = [bytes(r.choices(b"ab", k=6)) for _ in range(n)]
        after = [bytes(r.choices(b"ab", k=8)) for _ in range(n)]
        want, got = set(), set()
        for i in range(n):
            for k in range(n):
                left, depth = suffix.common_prefix(before[i], before[k]), suffix.common_prefix(after[i], after[k])
                if i != k and left + depth >= length:
                    want |= {(i, s) for s in range(-left, depth - length + 1)}
        for i, left, depth in suffix.interval_scan(before, after, length):
            got |= {(i, s) for s in range(-left, depth - length + 1)}
        assert got == want


def test_cut_keeps_characters_and_columns(awkward):
    docs, rows = awkward
    cut = suffix.cut_repeats(docs, 400)
    assert cut.columns == docs.columns
    got = cut.collect()
    assert len(got) == len(rows)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert next(r for r in got if r.doc_id == 5).text is None
    accents = next(r for r in got if r.doc_id == 12).text
    assert "中文字" in accents and set(accents) <= set("é 中文字😀")


def test_empty_tables(no_documents):
    assert not copies_of(no_documents) and not repeats_of(no_documents, 400)
    assert suffix.cut_repeats(no_documents, 400).count() == 0


def without_passages(rows, count, length):
    """(doc_id, kept) with all windows of ``count`` words and of ``length`` bytes that occur twice cut out."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for _, b in texts]
    seen = Counter(tuple(x[2] for x in w[s : s + count]) for w in words for s in range(len(w) - count + 1))
    strings = Counter(b[s : s + length] for _, b in texts for s in range(len(b) - length + 1))
    out = Counter()
    for (i, b), w in zip(texts, words):
        gone = bytearray(len(b))
        for s in range(len(w) - count + 1):
            if seen[tuple(x[2] for x in w[s : s + count])] > 1:
                a, z = w[s][0], w[s + count - 1][1]
                gone[a:z] = b"\1" * (z - a)
        for s in range(len(b) - length + 1):
            if strings[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out[(i, bytes(x for x, g in zip(b, gone) if not g).decode())] += 1
    return out


def test_cut_passages_by_words(spark):
    r = random.Random(7)
    rows = patchwork(50, 8)
    short = [" ".join(r.choice("abcdefgh") for _ in range(n)) for n in (50, 51, 52, 75)]  # 51 words in 101 bytes
    for k, p in enumerate(short):
        rows += [(k, f"before{k} {p} after{k}"), (10 + k, f"{p}\nend{k}"), (20 + k, p.replace(" ", "  "))]
    rows += [(30, "aa bb " * 60), (31, ""), (32, None), (33, short[1]), (33, short[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for count in (20, 51):
        got = Counter((x.doc_id, x.text or "") for x in suffix.cut_repeats(docs, 400, passage=count).collect())
        assert got == without_passages(rows, count, 400)


def test_pipeline_cuts_passages_of_51_words(spark, no_documents):
    passage = " ".join(f"w{k}" for k in range(51))  # about 200 bytes
    rows = [(1, f"one {passage} two", "en", "s", 1, "k", 7, 1), (2, f"three {passage} four", "en", "s", 1, "k", 7, 1)]
    got = dict(corpus_pipeline.STAGES)["repeats"](spark, spark.createDataFrame(rows, no_documents.schema), "").collect()
    assert sorted(r.text.split() for r in got) == [["one", "two"], ["three", "four"]]
