"""Plain single-process versions of the corpus operators, and awkward rows to try them on."""

from __future__ import annotations

import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, `hash` long, node int"


def passage(n: int, seed: int = 0) -> str:
    """``n`` words that no other seed shares runs of."""
    return " ".join(f"w{(i * 7919 + seed * 104729) % 99991}x{seed}" for i in range(n))


def awkward_documents() -> list[tuple]:
    """Null and empty texts, ties, repeated rows, shared ids, a null id, long and many-byte texts, clashing columns."""
    shared = passage(90, 1)
    texts: list[tuple[int | None, str | None]] = [
        (1, passage(30, 2) + " " + shared + " " + passage(20, 3)),
        (2, passage(25, 4) + "\n" + shared + "\t" + passage(5, 5)),
        (3, shared), (3, shared),  # a repeated row
        (4, passage(40, 6)), (4, passage(40, 7) + " " + shared),  # one id, two texts
        (5, None), (6, ""), (7, " \n\t "), (8, "one"), (9, "one two"), (10, "One TWO three"),
        (None, shared + " " + passage(10, 8)),
        (11, passage(6000, 9) + " " + passage(40, 6)),  # very long, ends with document 4's words
        (12, "é" * 700 + " 中文字 😀 " + "é" * 700), (13, "a" * 1500), (14, "ab " * 700),
        (15, passage(100, 10)), (16, passage(100, 10).replace("x10 ", "x10  ", 3)), (17, "12 34 !!"),
        (-5, passage(50, 11)), (18, passage(50, 11) + " " + passage(12, 12)), (19, passage(12, 12)),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "k", 7, 1) for i, t in texts]


def without_copies(rows: list[tuple[int | None, str | None]], window: int) -> Counter:
    """(doc_id, words, removed, kept) of every row, by the smallest id that has each window."""
    first: dict[tuple, int] = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out: Counter = Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if i is not None and first[k] < i:
                gone[s : s + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g).encode())] += 1
    return out


def without_repeats(rows: list[tuple[int | None, str | None]], length: int) -> Counter:
    """(doc_id, bytes, removed, runs, kept) of every row."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[s : s + length] for _, b in data for s in range(len(b) - length + 1))
    out: Counter = Counter()
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[(i, len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))] += 1
    return out


def plain_bits(samples: dict[str, list[bytes]], text: bytes, order: int = 3, least_seen: int = 2) -> list[float]:
    """Bits of a text under every language, byte by byte from the definition of the escapes."""
    known = sorted({b for texts in samples.values() for t in texts for b in t})
    novel = 256 - len(known)
    flat = {**{b: 1 / 256 for b in known}, None: max(novel, 1) / 256}  # None: any byte of no sample
    out = []
    for language in sorted(samples):
        seen: dict[bytes, Counter] = {}
        for t in samples[language]:
            for depth in range(order + 1):
                for i in range(depth, len(t)):
                    seen.setdefault(t[i - depth : i], Counter())[t[i]] += 1

        def shares(context: bytes) -> dict:
            n = seen.get(context)
            if n is None or len(context) == order and n.total() < least_seen:
                return shares(context[1:]) if context else flat
            lower = shares(context[1:]) if context else flat
            left = {s: p for s, p in lower.items() if s not in n}
            rest = sum(left.values())
            escape = len(n) / (n.total() + len(n)) if rest > 0 else 0.0
            return {s: n[s] / n.total() * (1 - escape) if s in n else p / rest * escape for s, p in lower.items()}

        bits = 0.0
        for i, b in enumerate(text):
            p = shares(text[max(0, i - order) : i])
            bits -= math.log2(p[b] if b in p else p[None] / novel)
        out.append(bits)
    return out


def groups(nodes: list, linked) -> dict:
    """Smallest member of every node's group under a symmetric relation."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}
