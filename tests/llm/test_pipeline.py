"""The whole pipeline against a plain version of every stage."""

from __future__ import annotations

import hashlib
import random
import re

import public_tokenizers
import pyarrow as pa
import pytest
from brute import WORD, groups, plain_bits
from test_repeats import without_passages

import corpus_pipeline

DDL = "doc_id long, text string, lang string, source string, n_chars long"
ITEM = "Which of the twelve quiet rivers north of the old granite mill freezes first when the winter winds turn east?"


def fixture(r: random.Random) -> list[tuple]:
    """Texts of two languages with copies, near copies, shared passages, an item, foreign and empty texts."""
    letters = {"en": "abcdefghiklmno", "de": "nopqrstuvwxyzäöü"}
    vocabulary = {k: ["".join(r.choices(v, k=r.randrange(3, 8))) for _ in range(250)] for k, v in letters.items()}

    def prose(lang: str, n: int) -> list[str]:
        return [r.choice(vocabulary[lang]) for _ in range(n)]

    docs: list[tuple[str | None, str | None]] = [(" ".join(prose(lang, r.randrange(60, 160))), lang) for lang in ("en", "de") * 12]
    docs += [(docs[3][0], "de"), (docs[4][0].upper(), "en")]  # a copy, and one in capitals
    for share in (0.01, 0.02, 0.10):  # near copies; the last one is too far off
        changed = docs[7][0].split()
        for i in r.sample(range(len(changed)), max(1, int(share * len(changed)))):
            changed[i] = r.choice(vocabulary["de"])
        docs.append((" ".join(changed), "de"))
    passage, longer = " ".join(prose("en", 55)), " ".join(prose("en", 140))
    for shared in (passage, passage, longer, longer):
        docs.append((" ".join(prose("en", 70)) + "\n" + shared + " " + " ".join(prose("en", 70)), "en"))
    docs.append((" ".join(prose("en", 50)) + " " + ITEM + " " + " ".join(prose("en", 50)), "en"))
    docs += [(None, "en"), ("", "de"), ("12 34 -- 56", "en"), ("Сегодня хорошая погода, мы идём гулять в парк. " * 4, None)]
    return [(3 * i + 1, t, lang, "s", len(t or "")) for i, (t, lang) in enumerate(docs)]


def recognised(rows: list[tuple]) -> list[tuple]:
    samples: dict[str, set[bytes]] = {}
    for _, t, lang, *_ in rows:
        if t and lang:
            assert len(t) <= 2000
            samples.setdefault(lang, set()).add(t.encode())
    kept = []
    for row in rows:
        t = row[1]
        if t is None or not re.search(r"[^\W\d_]", t):
            continue
        bits, n = plain_bits({k: sorted(v) for k, v in samples.items()}, t.encode()), len(t.encode())
        share = 1 / sum(2.0 ** -min((b - min(bits)) * min(n, 64) / n, 1000) for b in bits)
        if share >= 0.5 and min(bits) < 6 * n + 64:
            kept.append(row)
    return kept


def one_of_each(rows: list[tuple]) -> list[tuple]:
    def shingles(t: str) -> set:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = {r[0]: shingles(r[1]) for r in rows}
    group = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    return [r for r in rows if group[r[0]] == r[0]]


@pytest.mark.parametrize("name, step", corpus_pipeline.STAGES)
def test_steps_see_small_batches(spark, tmp_path, name, step):
    rows = fixture(random.Random(2))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    step(spark, spark.createDataFrame(rows, DDL), str(tmp_path))
    texts = spark.range(0, 800, 1, 1).selectExpr("repeat(concat('word ', id), 1000) AS text")  # some 6 MB
    sizes = texts.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()
    assert sum(r.n for r in sizes) > 6_000_000 and max(r.n for r in sizes) < 400_000


@pytest.mark.parametrize("seed", [1])
def test_pipeline_equals_its_plain_version(spark, tmp_path, seed):
    import base64

    import tiktoken

    rows = fixture(random.Random(seed))
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = recognised(rows)
    assert {r[0] for r in rows} - {r[0] for r in kept} == {3 * i + 1 for i in range(len(rows) - 4, len(rows))}
    unlike = one_of_each(kept)
    assert len(kept) - len(unlike) == 4
    cut = without_passages([r[:2] for r in unlike], 51, 400)
    clean = [(i, t) for i, t in cut.elements() if ITEM not in t]
    assert sum(cut.values()) - len(clean) == 1 and sum(len(t) for _, t in clean) < sum(len(r[1]) for r in unlike) - 1000
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in clean:
        ids = encoding.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
