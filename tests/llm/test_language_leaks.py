"""Language ID (op5), benchmark leaks (op10) and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from brute import passage, plain_bits
from pyspark.sql import functions as F

import corpus_pipeline
from rentweave.llm import decontam, langid
from rentweave.llm.common import keyed

SF_DIR = "/root/testdata/sf0.001"
ENGLISH = "the cat sat on the mat and then it went out to look for the other cats in the garden of the house "
GERMAN = "die Katze saß auf der Matte und dann ging sie hinaus um die anderen Katzen im Garten des Hauses zu suchen "


def model():
    return langid.fit({"de": [GERMAN.encode() * 5], "en": [ENGLISH.encode() * 5]})


def test_every_context_is_a_distribution():
    m = model()
    novel = 256 - (m.bits.shape[1] - 1)
    p = np.exp2(-m.bits.astype(float))
    assert np.allclose(p[:, :-1].sum(1) + novel * p[:, -1], 1, atol=1e-4)
    assert np.isfinite(m.bits).all()


def test_code_length_is_additive_and_order_free():
    m = model()
    texts = [b"the cat", b"", "Straße ÿ".encode(), b"x", GERMAN.encode() * 50]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    together = langid.code_lengths(m, data, offsets)
    for t, bits in zip(texts, together):
        alone = langid.code_lengths(m, np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], bits)
    assert (together[1] == 0).all()


def test_code_lengths_equal_a_plain_model():
    samples = {"de": [GERMAN.encode(), b"Haus", b"ab"], "en": [ENGLISH.encode(), b"xyxyx"], "es": ["¿qué tal?".encode()]}
    m = langid.fit(samples)
    texts = [GERMAN[:90].encode(), b"the hat", b"", "Привет ÿ".encode(), b"\x00\xff xyxyxyx Haus", b"zz" * 20]
    data = np.frombuffer(b"".join(texts), np.uint8)
    got = langid.code_lengths(m, data, np.r_[0, np.cumsum([len(t) for t in texts])])
    for t, bits in zip(texts, got):
        assert np.allclose(bits, plain_bits(samples, t), rtol=1e-5, atol=1e-3)


def test_texts_in_no_learned_language_are_rejected(spark):
    foreign = ["Сегодня хорошая погода, и мы идём гулять в парк с собакой. " * 3, "今天天气很好，我们去公园散步。" * 5, "Σήμερα ο καιρός είναι καλός. " * 4]
    rows = [(i, t) for i, t in enumerate([*foreign, GERMAN, ENGLISH, "the cat", "Cat!"])]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in langid.accepted(some, model()).collect()) == [3, 4, 5, 6]


def test_sample_is_of_different_texts_and_all_over_them(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 20)
    long = "".join(f"<{i:05}>" for i in range(3000))
    rows = [(i, "a copy", "en") for i in range(900)] + [(1000 + i, f"text {i}", "en") for i in range(60)]
    rows += [(2000 + i, None, "en") for i in range(50)] + [(3000, long, "de"), (3001, "", "de"), (3002, "kurz", "de"), (3003, "x", ""), (3004, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.training_sample(docs, F.lit(True))
    assert sample.keys() == {"en", "de"} and len(sample["en"]) == len(set(sample["en"])) == 20
    pieces = [p.decode() for p in sample["de"] if p != b"kurz"]
    assert len(pieces) == langid.SAMPLE_PIECES and sum(map(len, pieces)) == langid.SAMPLE_CHARS
    at = [long.index(p) for p in pieces]
    assert min(at) == 0 and max(at) + len(pieces[0]) == len(long) and sorted(at)[1] > len(long) // 4
    assert langid.training_sample(docs.where("lang is null"), F.lit(True)) == {}


def test_awkward_documents(spark, awkward, no_documents):
    docs, rows = awkward
    got = langid.predict(docs, model()).collect()
    assert len(got) == len(rows)
    told = {r.doc_id: r for r in got}
    assert all(told[i].lang_pred == "und" and told[i].score == 0 for i in (5, 6, 7, 17))
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(no_documents, model()).count() == 0
    assert langid.identify(no_documents, F.lit(True)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unlabelled, F.lit(True)).collect()} == {"und"}
    some = spark.createDataFrame([(1, GERMAN), (2, ENGLISH), (3, "123")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(some, model()).collect()} == {1: "de", 2: "en", 3: "und"}
    assert [r.doc_id for r in langid.accepted(some.withColumn("score", F.lit("x")), model()).orderBy("doc_id").collect()] == [1, 2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = F.col("doc_id") % 4 == 2
    got = langid.identify(docs, ~held).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 40 and np.mean([r.lang == r.lang_pred for r in got]) > 0.95


ITEM = (
    "If Maria buys 12 apples at 30 cents each and Peter gives her 5 km of rope, how many cents does Maria spend on "
    "the 12 apples before she walks home along the river to meet her friends?"
)
OTHER = (
    "if Sofia buys 17 apples at 45 cents each and Thomas gives her 9 km of rope, how many cents does Sofia spend on "
    "the 17 apples before she walks home along the river to meet her friends"
)
WRONG = OTHER.replace("the 17 apples", "the 18 apples").replace("does Sofia", "does Clara")


def leaks(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, at int, slots string")
    bench = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r.reparameterised for r in decontam.leaks(keyed(docs), bench).collect()}


def test_leaks(spark):
    texts = [
        passage(50, 1) + " " + ITEM + " " + passage(20, 2), passage(9, 3) + ". " + OTHER, ITEM.upper(), passage(80, 4), None, "",
        "how many cents does Maria spend", ITEM[:40], "Was 2+2 equal to four?", passage(5000, 5) + " " + ITEM, ITEM, ITEM,
    ]
    items = ((1, ITEM), (2, passage(30, 9)), (3, None), (4, ""), (5, "Was 3+3 equal to four?"), (None, passage(80, 4)))
    assert leaks(spark, texts, items) == {
        (0, 1): False, (1, 1): True, (2, 1): False, (8, 5): True, (9, 1): False, (10, 1): False, (11, 1): False
    }


def test_slots_must_be_consistent(spark):
    bare = "Anna told 3 to 4 and later 3 to 7 because people like 3 more than 9 or 4 today"
    twisted = "Anna told 5 to 6 and later 8 to 7 because people like 9 more than 1 or 2 today"
    straight = "Anna told 5 to 6 and later 5 to 8 because people like 5 more than 1 or 6 today"
    assert leaks(spark, [straight, twisted], ((1, bare),)) == {(0, 1): True}


APPLES = "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"
NAMES = "Tom Reed met Ann Lee and Bob Hill near Oak Park while Sue Gray saw Max Ford with Eve Stone"


def test_names_that_open_sentences(spark):
    changed = APPLES.replace("Tom", "Ann").replace("5", "7").replace("3", "4")
    mixed = changed.replace("Ann buys", "Eve buys")
    texts = [changed, passage(20, 1) + "\n" + changed, APPLES, mixed.replace("does Ann", "does Max")]
    assert leaks(spark, texts, ((1, APPLES),)) == {(0, 1): True, (1, 1): True, (2, 1): False}


def test_copies_in_another_case(spark):
    other = APPLES.replace("5", "7").replace("3", "4")
    texts = [NAMES.lower(), NAMES.upper(), NAMES, APPLES.lower(), APPLES.upper(), other.upper(), APPLES.title()]
    assert leaks(spark, texts, ((1, NAMES), (2, APPLES))) == {
        (0, 1): False, (1, 1): False, (2, 1): False, (3, 2): False, (4, 2): False, (5, 2): True, (6, 2): False
    }


def test_short_items_after_any_word(spark):
    items = ((1, "What is the tallest mountain in Africa?"), (2, "Seconds matter when boats leave"), (3, "Rivers in Peru flow north"))
    texts = [
        "Pub quiz\nWhat is the tallest mountain in Africa?\nWrite it down", 'he said "hm ." What is the tallest mountain in Africa',
        "in round 5 seconds matter when boats leave", "of all the Rivers in Peru flow north", "10\nSeconds matter when boats leave",
        "The rivers in Peru flow north", "seconds matter when boats",
    ]
    assert set(leaks(spark, texts, items)) == {(0, 1), (1, 1), (2, 2), (3, 3), (4, 2), (5, 3)}


def test_many_templates_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_SENT", 1)
    assert leaks(spark, [ITEM, OTHER, passage(70, 6)]) == {(0, 1): False, (1, 1): True}


def test_no_rows(spark):
    assert leaks(spark, []) == {} and leaks(spark, [ITEM], ()) == {}


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, docs
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, seen, SF_DIR)
        rows = out.count()
        assert 0 < rows <= seen.count()
        if name != names[-1]:
            assert out.columns == columns
            seen = spark.createDataFrame(out.collect(), docs.schema)
    assert corpus_pipeline.run(spark, SF_DIR).count() == rows


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_of_awkward_rows(spark, awkward, no_documents, stage):
    docs, rows = awkward
    step = corpus_pipeline.STAGES[stage][1]
    got = step(spark, docs, SF_DIR)
    assert 0 < got.count() <= len(rows)
    assert step(spark, no_documents, SF_DIR).count() == 0
    if stage < 4:
        assert got.columns == docs.columns
