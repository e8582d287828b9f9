"""Phrase fingerprints (op12) against a plain parse."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rentweave.llm import lzprint
from rentweave.llm.common import mix


def plain_phrases(data: bytes) -> set[bytes]:
    known, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            known.add(data[start:end])
            start = end
    return known


def plain_signature(data: bytes) -> list[int]:
    hashes = set()
    for phrase in plain_phrases(data):
        h = 0xCBF29CE484222325
        for b in phrase:
            h = (h ^ b) * 0x100000001B3 % (1 << 64)
        hashes.add(int(mix(np.array([h], np.uint64))[0]) >> 32)
    return sorted(hashes)[: lzprint.SIGNATURE]


def plain_likeness(a: list[int], b: list[int]) -> float:
    if not a or not b:
        return float(a == b)
    least = sorted({*a, *b})[: lzprint.SIGNATURE]
    return len(set(least) & set(a) & set(b)) / len(least)


def plain(rows: list[tuple[int | None, str | None]], key) -> Counter:
    """Results by the order (doc_id descending, null last, hash of the text); equal rows are one document."""
    docs = sorted({(i is None, 0 if i is None else -i, key(t or ""), i, t or "") for i, t in rows})
    counts = Counter((i, t or "") for i, t in rows)
    out: Counter = Counter()
    for at, (*_, i, t) in enumerate(docs):
        after = docs[(at + 1) % len(docs)][4]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        mine, changed, its = (plain_signature(x.encode()) for x in (t, edited, after))
        prints = ["".join(f"{h:08x}" for h in s) for s in (mine, changed)]
        out[
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *prints, plain_likeness(mine, changed), plain_likeness(mine, its))
        ] += counts[(i, t)]
    return out


def printed(table) -> Counter:
    found = lzprint.fingerprints(table)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return Counter(map(tuple, found.collect()))


@pytest.fixture(scope="module")
def text_key(spark):
    """Spark's hash of a text."""
    known: dict[str, int] = {}

    def key(text: str) -> int:
        if text not in known:
            known[text] = spark.createDataFrame([(text,)], "t string").selectExpr("xxhash64(t) AS k").first().k
        return known[text]

    return key


def test_parse_can_go_back():
    r = random.Random(1)
    for _ in range(30):
        a, b, c = (bytes(r.choices(b"ab\xc3", k=r.randrange(400))) for _ in range(3))
        phrases = lzprint.Phrases()
        phrases.feed(a)
        mark = phrases.mark()
        phrases.feed(b)
        assert phrases.signature().tolist() == plain_signature(a + b)
        phrases.rewind(mark)
        phrases.feed(c)
        assert phrases.signature().tolist() == plain_signature(a + c)
        assert len(phrases.codes) - 1 == len(plain_phrases(a + c)) == len(phrases.table)


@pytest.mark.parametrize("block", [None, 9000])
def test_against_plain_parse(spark, awkward, text_key, monkeypatch, block):
    table, rows = awkward
    if block:
        monkeypatch.setattr(lzprint, "BLOCK_BYTES", block)
        monkeypatch.setattr(lzprint, "PARTITION_BYTES", 2 * block)
        monkeypatch.setattr(lzprint, "RESULTS", 2)
    rows = rows + [(i, t) for i, t in rows if i in (3, 8, None)] * 5
    many = table.unionByName(table)
    for _ in range(4):
        many = many.unionByName(table.where("doc_id in (3, 8) or doc_id is null"))
    want = plain(rows, text_key)
    assert printed(table.limit(0)) == Counter()
    got = printed(many)
    counts = Counter()
    for i, t in [tuple(r) for r in many.select("doc_id", "text").collect()]:
        counts[(i, t)] += 1
    assert got == plain(list(counts.elements()), text_key)
    assert set(got) == set(want)


def test_few_documents(spark, text_key):
    for rows in ([(7, "abcabcabc")], [(7, None)], [(None, "x")], [(1, "abcdef"), (2, "abcxyz")], [(-(1 << 63), "abc"), ((1 << 63) - 1, "é" * 9), (0, "")]):
        assert printed(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows, text_key)


def test_likeness_follows_the_change():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randrange(2, 9))) for _ in range(3000)]
    text = [r.choice(words) for _ in range(900)]
    mine = np.array(plain_signature(" ".join(text).encode()), np.uint32)
    likes = []
    for share in (0, 10, 30, 60, 100):
        changed = [*text[: 900 - 9 * share], *[r.choice(words) for _ in range(9 * share)]]
        likes.append(lzprint.likeness(mine, np.array(plain_signature(" ".join(changed).encode()), np.uint32)))
    assert likes[0] == 1 and likes == sorted(likes, reverse=True) and likes[1] > 0.75 > 0.4 > likes[4]
