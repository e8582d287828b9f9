"""Benchmark decontamination by template canonicalisation.

Words lose their outer punctuation and case; then numbers, units after a number, and names
(capitalised words other than function words, wherever they stand) are slots that become
typed placeholders. Windows of ``WINDOW`` words are hashed in up to three forms: all slots as
placeholders and names kept, where that leaves enough literal words to be telling, and
everything kept. A hash follows from a window's words alone, whatever stands before it, so
one written in another case meets in a form that keeps its names. Document windows are
joined to benchmark windows by hash; slot values travel along, and a window counts only if the same benchmark value
always became the same document value (on the whole alignment, or else if its slots are
unchanged). That catches a question with new numbers and names, not two texts of the same shape.

A document holds an item if half of the item's windows are found in it, or a run of
aligned windows spans ``RUN`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rentweave.llm.common import (
    RangeHash, as_signed, byte_codes, mix, owners, slices, stage, utf8, within_documents, words,
)

WINDOW = 8
RUN = 13
LITERALS = 5
COVERAGE = 0.5
#: Distinct benchmark windows up to which they are sent to all tasks as a filter; beyond, all windows are shuffled.
MOST_SENT = 2_000_000
UNITS = (
    "% percent dollar dollars euro euros cent cents usd eur mm cm m km inch inches foot feet ft yard yards mile miles "
    "mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs ton tons ml l liter liters litre litres "
    "gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules meter meters metre metres"
).split()
#: Capitalised where they open a sentence or stand in a title, but no names.
FUNCTION_WORDS = (
    "a an the this that these those some any each every all both most many much few several no none one another other "
    "i you he she it we they me him us them my your his her its our their who whom whose what which when where why how "
    "is are was were be been am do does did has have had can could will would shall should may might must "
    "and or but nor so yet if then than because since while although though unless until after before once whether "
    "in on at by for from with without of to into onto over under between among during through about against as per "
    "there here now today not only also just even still again however therefore thus hence given let suppose assume "
    "consider find name give list write solve show prove explain describe choose select state identify compute "
    "calculate evaluate determine simplify complete answer question"
).split()
_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (1, 2, 3))
_WINDOWS = "hash long, doc_id long, key long, at int, slots array<string>, n_windows int"

_BYTES = np.arange(256)
_IS_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_IS_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_IS_LETTER = _IS_UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_INNER = _IS_DIGIT | _IS_LETTER
_INNER[[36, 37]] = True  # $ and %
_LOWER = np.where(_IS_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)


class Tokens:
    """The canonical words of a batch: places, three codes per word and which words are slots."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, firsts = words(data, offsets)
        inner = _INNER[data]
        after = np.r_[0, np.cumsum(inner)]
        places = np.flatnonzero(inner)
        some = after[ends] > after[starts]  # words of punctuation alone are dropped
        kept = np.r_[0, np.cumsum(some)]
        self.firsts = kept[firsts]
        self.starts = places[after[starts[some]]]
        self.ends = places[after[ends[some]] - 1] + 1
        s, e = self.starts, self.ends
        plain = RangeHash(byte_codes(_LOWER[data]))(s, e)
        digits = np.r_[0, np.cumsum(_IS_DIGIT[data])]
        letters = np.r_[0, np.cumsum(_IS_LETTER[data])]
        head = data[s] if len(s) else np.zeros(0, np.uint8)
        second = data[np.minimum(s + 1, max(len(data) - 1, 0))] if len(s) else head
        number = (digits[e] > digits[s]) & (letters[e] == letters[s])
        unit = np.zeros(len(s), bool)
        unit[1:] = number[:-1] & np.isin(plain[1:], codes_of(UNITS))
        accented = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        name = _IS_UPPER[head] & (e - s > 1) & ~_IS_UPPER[second] | accented
        name &= ~number & ~np.isin(plain, codes_of(FUNCTION_WORDS))
        none = np.zeros(len(s), bool)
        counted = np.where(number, _NUMBER, plain)
        measured = np.where(unit, _UNIT, counted)
        self.forms = [RangeHash(codes) for codes in (np.where(name & ~unit, _NAME, measured), measured, plain)]
        #: Words that are slots in each form.
        self.slot = (number | unit | name, number | unit, none)
        #: The same for the first word of a window, which is no unit whatever stands before it.
        self.head = (np.where(name, _NAME, counted), counted, plain)
        self.head_slot = (number | name, number, none)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts inside one document, hashes and forms of the windows of ``size`` words; equal forms of a window once."""
        n = len(self.starts)
        at = np.flatnonzero(within_documents(self.firsts[:-1], n, size))
        need = LITERALS if size == WINDOW else max(2, size - 2)  # an item shorter than a window
        hashes, fits = [], []
        for form, slot, head, head_slot in zip(self.forms, self.slot, self.head, self.head_slot):
            slots = np.r_[0, np.cumsum(slot)]
            own = mix(form.grams(size - 1)[at + 1] + mix(head[at]))
            fit = (size - head_slot[at] - (slots[at + size] - slots[at + 1]) >= need) | (len(fits) == 2)
            for earlier, there in zip(hashes, fits):
                fit &= ~(there & (earlier == own))
            hashes.append(own)
            fits.append(fit)
        form = np.repeat(np.arange(3, dtype=np.int8), [f.sum() for f in fits])
        return np.concatenate([at[f] for f in fits]), np.concatenate([h[f] for h, f in zip(hashes, fits)]), form


_CODES: dict[str, np.ndarray] = {}


def codes_of(listed: list[str]) -> np.ndarray:
    text = "".join(listed)
    if text not in _CODES:
        ends = np.cumsum([len(u) for u in listed])
        _CODES[text] = RangeHash(byte_codes(np.frombuffer(text.encode(), np.uint8)))(np.r_[0, ends[:-1]], ends)
    return _CODES[text]


class _Known:
    """Hash set for whole arrays: a bit table first, then a search in the sorted values."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.mask = np.uint64((1 << max(20, int(len(self.values)).bit_length() + 6)) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[self.values & self.mask] = True

    def found(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[hashes & self.mask])
        place = np.searchsorted(self.values, hashes[maybe])
        hit = place < len(self.values)
        hit[hit] = self.values[place[hit]] == hashes[maybe][hit]
        return maybe[hit]


def template_windows(texts: DataFrame, sizes: list[int], known: np.ndarray | None = None, short: bool = False) -> DataFrame:
    """Windows of ``texts(doc_id, key, text)`` with their slot values; only ``known`` hashes if given.

    ``short``: a text of fewer than ``WINDOW`` words is one window of its own size.
    """
    sent = texts.sparkSession.sparkContext.broadcast(None if known is None else known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if sent.value is None else _Known(sent.value)
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            tokens = Tokens(data, offsets)
            sizes_of = np.diff(tokens.firsts)
            raw = data.tobytes()
            for size in sizes:
                at, hashes, form = tokens.windows(size)
                doc = owners(tokens.firsts[:-1], at)
                pick = np.arange(len(at)) if wanted is None else wanted.found(hashes)
                if short and size < WINDOW:
                    pick = pick[sizes_of[doc[pick]] == size]
                if not len(pick):
                    continue
                at, hashes, form, doc = at[pick], hashes[pick], form[pick], doc[pick]
                slots = [
                    [raw[tokens.starts[w] : tokens.ends[w]].decode("utf-8", "replace").lower()
                     for w in range(a, a + size) if (tokens.slot if w > a else tokens.head_slot)[v][w]]
                    for a, v in zip(at.tolist(), form.tolist())
                ]
                rows = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(as_signed(hashes)), batch.column("doc_id").take(rows), batch.column("key").take(rows),
                        pa.array((at - tokens.firsts[doc]).astype(np.int32)), pa.array(slots, pa.list_(pa.string())),
                        pa.array((sizes_of[doc] - size + 1).astype(np.int32)),
                    ],
                    ["hash", "doc_id", "key", "at", "slots", "n_windows"],
                )

    return texts.mapInArrow(run, _WINDOWS)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, key, item_id, n_found, n_windows, run_words, reparameterised``: the documents that hold an item.

    ``docs`` is ``common.keyed``; ``benchmark(item_id, text)``. Null or empty texts, and items
    of one word, match nothing; a null doc_id is reported like any other; equal rows are
    reported once. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    items = benchmark.select(
        F.col("`item_id`").alias("doc_id"), F.lit(0).cast("long").alias("key"), F.col("`text`")
    ).where("doc_id is not null")
    sizes = list(range(2, WINDOW + 1))
    asked = stage(template_windows(items, sizes, short=True), "templates")
    distinct = asked.select("hash").distinct()
    in_use = sizes
    if asked.where(F.col("n_windows") == 1).limit(1).count() == 0:
        in_use = [WINDOW]
    known = None
    if distinct.limit(MOST_SENT + 1).count() <= MOST_SENT:
        known = np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64)
        if not len(known):
            return spark.createDataFrame(
                [], "doc_id long, key long, item_id long, n_found int, n_windows int, run_words int, reparameterised boolean"
            )
    found = template_windows(docs, in_use, known)
    pairs = found.drop("n_windows").alias("d").join(asked.alias("b"), F.col("d.hash") == F.col("b.hash")).select(
        "d.doc_id", "d.key", F.col("b.doc_id").alias("item_id"), F.col("b.at").alias("at"), "b.n_windows",
        (F.col("d.at") - F.col("b.at")).alias("shift"),
        F.arrays_zip(F.col("b.slots").alias("item"), F.col("d.slots").alias("own")).alias("slots"),
    ).distinct()
    same = F.forall("slots", lambda s: s["item"] == s["own"])
    aligned = pairs.groupBy("doc_id", "key", "item_id", "n_windows", "shift").agg(
        F.collect_set("at").alias("all"), F.collect_set(F.when(same, F.col("at"))).alias("unchanged"),
        F.array_distinct(F.flatten(F.collect_list("slots"))).alias("map"),
    )
    is_function = F.size(F.array_distinct(F.transform("map", lambda s: s["item"]))) == F.size("map")
    aligned = aligned.withColumn("counted", F.array_sort(F.when(is_function, F.col("all")).otherwise(F.col("unchanged"))))
    zero = F.struct(F.lit(-9).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def longer(acc, at):
        run = F.when(at == acc["last"] + 1, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(at.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    runs = aligned.where(F.size("counted") > 0).select(
        "doc_id", "key", "item_id", "n_windows", "counted", F.aggregate("counted", zero, longer)["best"].alias("run"),
        F.exists("map", lambda s: s["item"] != s["own"]).alias("changed"),
    )
    summed = runs.groupBy("doc_id", "key", "item_id", "n_windows").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("counted")))).alias("n_found"),
        F.max("run").alias("run"), F.max("changed").alias("reparameterised"),
    )
    held = (F.col("n_found") >= COVERAGE * F.col("n_windows")) | (F.col("run") + WINDOW - 1 >= RUN)
    return summed.where(held).select(
        "doc_id", "key", "item_id", "n_found", "n_windows", (F.col("run") + WINDOW - 1).alias("run_words"), "reparameterised"
    )
