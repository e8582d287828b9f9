"""Language identification by prediction by partial matching (PPM).

Each language has its own byte context tree up to ``ORDER`` bytes deep. A byte's
probability in a context: seen bytes share ``N / (N + U)`` by count (N bytes seen there, U
different ones), the escape ``U / (N + U)`` is shared out over the bytes not seen there
by the next shorter context; below the empty context all 256 bytes are equal. So every
context's distribution sums to one and a text's code length is exact. Statistics are
frozen after training; the language with the shortest code wins.

Training reads a sample bounded by ``SAMPLE_TEXTS`` different texts per language and ``SAMPLE_CHARS`` of each, in pieces
from all over it, chosen by a hash of the text, so the choice is the same at every run and copies count once. Scoring reads every byte of every text: all
languages' trees are laid out as one table with a row per context that any language
knows, so that a text is scored by two array look-ups per byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from rentweave.llm.common import only, slices, utf8

ORDER = 3
#: Bounds on the labelled texts that one language's tree is fitted on.
SAMPLE_TEXTS = 300
SAMPLE_CHARS = 2_000
#: Pieces that the characters of a longer text come from, evenly spread over it.
SAMPLE_PIECES = 4
#: Bits a byte under the best language from which on a text is in none that was learned: bytes never seen cost about 8,
#: text of a learned language 2 to 3, of a related one up to 5. A few strange bytes in a short text are spared.
MOST_BITS, SPARED_BITS = 6.0, 64
#: Contexts of full depth seen less often than this in a language are left to the shorter one.
LEAST_SEEN = 2
UNKNOWN = "und"
_LETTER = r"\p{L}"


@dataclass
class Model:
    """``bits[row, symbol, language]``: code length of a byte; ``row_of[context code]``: deepest known context."""

    languages: list[str]
    symbol_of: np.ndarray
    row_of: np.ndarray
    bits: np.ndarray


def fit(samples: dict[str, list[bytes]]) -> Model:
    """Context trees of all languages from sample texts, laid out for scoring.

    Bytes in no sample share one symbol (coded as any single one of them); a context that holds
    it is known only up to it.
    """
    languages = sorted(samples)
    present = np.zeros(256, bool)
    for texts in samples.values():
        for t in texts:
            present[np.frombuffer(t, np.uint8)] = True
    known = np.flatnonzero(present)
    a = len(known) + 1
    novel = 256 - len(known)
    symbol_of = np.full(256, a - 1, np.int32)
    symbol_of[known] = np.arange(len(known))
    weight = np.ones(a) / 256
    weight[-1] = max(novel, 1) / 256
    counts: list[dict[int, np.ndarray]] = []  # per language: (depth, context) to counts of the next symbol
    for language in languages:
        seen: dict[int, np.ndarray] = {}
        for depth in range(ORDER + 1):
            keys = []
            for t in samples[language]:
                s = symbol_of[np.frombuffer(t, np.uint8)].astype(np.int64)
                if len(s) > depth:
                    code = np.zeros(len(s) - depth, np.int64)
                    for back in range(depth, 0, -1):
                        code = code * a + s[depth - back : len(s) - back]
                    keys.append(code * a + s[depth:])
            if keys:
                values, n = np.unique(np.concatenate(keys), return_counts=True)
                contexts, starts = np.unique(values // a, return_index=True)
                for c, lo, hi in zip(contexts.tolist(), starts, [*starts[1:], len(values)]):
                    if depth == ORDER and n[lo:hi].sum() < LEAST_SEEN:
                        continue
                    row = np.zeros(a, np.float32)
                    row[values[lo:hi] % a] = n[lo:hi]
                    seen[(depth << 40) | c] = row
        counts.append(seen)
    nodes = sorted(set().union(*counts))
    place = {node: i for i, node in enumerate(nodes)}
    bits = np.zeros((max(len(nodes), 1), a, max(len(languages), 1)), np.float32)
    for k, seen in enumerate(counts):
        for node in nodes:
            depth, code = node >> 40, node & ((1 << 40) - 1)
            lower = weight if depth == 0 else bits[place[((depth - 1) << 40) | (code % a ** (depth - 1))], :, k]
            n = seen.get(node)
            if n is None:
                p = lower if depth else weight
            else:
                total, distinct = n.sum(), np.count_nonzero(n)
                left = np.where(n == 0, lower, 0)
                rest = left.sum()
                escape = distinct / (total + distinct) if rest > 0 else 0.0
                p = n / n.sum() * (1 - escape) + (left / rest * escape if rest > 0 else 0)
            bits[place[node], :, k] = p
    row_of = np.zeros(a**ORDER, np.int32)
    for depth in range(ORDER + 1):  # deeper contexts overwrite the ones they end in
        for node in nodes:
            if node >> 40 == depth:
                row_of[(node & ((1 << 40) - 1)) :: a**depth] = place[node]
    if novel:
        bits[:, -1, :] /= novel  # one byte out of those not seen
    with np.errstate(divide="ignore"):
        bits = -np.log2(bits)
    return Model(languages, symbol_of, row_of, bits)


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits of every document (rows) under every language (columns)."""
    a = model.bits.shape[1]
    s = model.symbol_of[data].astype(np.int32)
    context = np.zeros(len(s), np.int32)
    for back in range(ORDER, 0, -1):
        context *= a
        context[back:] += s[:-back]
    rows = model.row_of[context]
    starts = offsets[:-1]
    for depth in range(ORDER):  # a document's first bytes have shorter contexts
        at = starts + depth
        at = at[at < offsets[1:]]
        rows[at] = _shorter(model, s, at, depth)
    flat = model.bits.reshape(-1, model.bits.shape[2])
    out = np.zeros((len(starts), flat.shape[1]))
    step = 1 << 20
    for lo in range(0, len(s), step):  # bounded memory for a very long text
        hi = min(lo + step, len(s))
        cost = flat[rows[lo:hi] * np.int64(a) + s[lo:hi]]
        sums = np.zeros((hi - lo + 1, flat.shape[1]))
        np.cumsum(cost, axis=0, out=sums[1:], dtype=np.float64)
        out += sums[np.clip(offsets[1:], lo, hi) - lo] - sums[np.clip(starts, lo, hi) - lo]
    return out


def _shorter(model: Model, s: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Row of the context of ``depth`` bytes before ``at``: as after bytes that nothing was seen with."""
    a = model.bits.shape[1]
    context = np.full(len(at), 0, np.int64)
    for back in range(ORDER, 0, -1):
        context = context * a + (s[at - back] if back <= depth else a - 1)
    return model.row_of[context]


def _pieces(text: Column) -> Column:
    """Array of at most ``SAMPLE_CHARS`` characters of a text: the whole of a short one, else pieces from all over it."""
    size = SAMPLE_CHARS // SAMPLE_PIECES
    step = (F.length(text) - size) / (SAMPLE_PIECES - 1)
    spread = F.array(*[F.substring(text, F.floor(step * n).cast("int") + 1, F.lit(size)) for n in range(SAMPLE_PIECES)])
    return F.when(F.length(text) <= SAMPLE_CHARS, F.array(text)).otherwise(spread)


def training_sample(docs: DataFrame, learn: Column) -> dict[str, list[bytes]]:
    """Pieces of up to ``SAMPLE_TEXTS`` different texts per language, in order of a hash of the text.

    Null and empty texts, and rows whose lang is null or empty, teach nothing. Different texts per language are counted
    first, so that a filter on the hash leaves a few times the wanted number before anything moves; the
    driver gets a bounded sample.
    """
    labelled = only(docs, "doc_id", "text", "lang").where(learn & (F.col("lang") != "") & (F.col("text") != ""))
    labelled = labelled.select("lang", "text", F.xxhash64("text").alias("draw"))
    counts = {r.lang: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * SAMPLE_TEXTS / max(n, 1)))])
    order = Window.partitionBy("lang").orderBy("draw")
    picked = (
        labelled.where(F.pmod("draw", F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30))
        .select("lang", "draw", _pieces(F.col("text")).alias("pieces"))
        .dropDuplicates(["lang", "draw"])
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= SAMPLE_TEXTS)
    )
    out: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for row in sorted(picked.collect(), key=lambda r: (r.lang, r.place)):
        out[row.lang] += [piece.encode() for piece in row.pieces]
    return out


def _judge(model: Model, texts: pa.Array, letter) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text of a batch, and its bits under that language beyond ``MOST_BITS`` a byte."""
    told = np.array([t is not None and letter.search(t) is not None for t in texts.to_pylist()], bool)
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    data, offsets = utf8(texts)
    bits = code_lengths(model, data, offsets)
    n = np.maximum(np.diff(offsets), 1)
    scaled = (bits - bits.min(1, keepdims=True)) * (np.minimum(n, 64) / n)[:, None]
    score = 1 / np.exp2(-np.minimum(scaled, 1000)).sum(1)
    names = [model.languages[b] if ok else UNKNOWN for b, ok in zip(bits.argmin(1), told)]
    return names, np.where(told, score, 0.0), bits.min(1) - MOST_BITS * n


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    Null text or text without a letter: ``und`` and score 0. Score: share of the best
    language in ``2 ** -(bits per byte * min(bytes, 64))``, so that long texts do not all
    end at 1. Equal code lengths go to the first language in order. A model without
    languages answers ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letter = regex.compile(_LETTER)
        for batch in slices(batches):
            names, score, _ = _judge(shared.value, batch.column("text"), letter)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose language is recognised with at least ``least_score``.

    A text far beyond ``MOST_BITS`` a byte under the best language is in none that was learned.
    Only texts go to Python and only verdicts come back; the rows stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def recognised(texts: pa.Array) -> pa.Array:
        letter, verdicts = regex.compile(_LETTER), []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
            names, score, beyond = _judge(shared.value, part.column("text"), letter)
            verdicts += [n != UNKNOWN and bool(s >= least_score and x < SPARED_BITS) for n, s, x in zip(names, score, beyond)]
        return pa.array(verdicts, pa.bool_())

    return docs.where(recognised(F.col("`text`")))


def identify(docs: DataFrame, learn: Column) -> DataFrame:
    """Fit on the rows where ``learn`` holds, predict every row; an empty table gives an empty result."""
    return predict(docs, fit(training_sample(docs, learn)))
