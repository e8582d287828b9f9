"""Token ids as Arrow files of equal-length sequences.

Documents in ascending id order are encoded, closed by an end id and laid end to end. Each
range of ids is one shard: an Arrow IPC file whose record batches hold ``BATCH`` sequences
of ``LENGTH`` ids as fixed-size lists, with a mask of the same shape that is false on the
padding of the last sequence. A batch's values are one plain buffer, so any sequence, or
any run of ids, is a slice of the mapped file. A sidecar table says for each document its
shard and where in the shard it begins.

Files are written below a shared folder through ``pyarrow.fs`` under a name of their own per
task attempt; only files named in the sidecar count, so a repeated task leaves no trace in
the result.
"""

from __future__ import annotations

import json
import os
import string
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from rentweave.llm.common import shared_folder, shuffle_partitions, slices, stage, utf8

LENGTH = 2048
BATCH = 128
#: Encoded words that a Python worker keeps.
KEEP_WORDS = 1_200_000
#: Cores that are encoded as one text.
TOGETHER = 500
#: ASCII punctuation: behind letters, with no letter or digit after it, it is a piece of its own.
_CLOSING = string.punctuation
_LAST_LATIN = "\u024f"
# The steps of a tokenizer whose words can be encoded one by one.
_NORMALISERS = [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"},
]
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def parts_words(tokenizer: str) -> bool:
    """The tokenizer (as JSON) lower-cases, parts at white space and parts letters from all else."""
    spec = json.loads(tokenizer)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pieces = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
    return bool(
        (spec.get("normalizer") or {}).get("normalizers") == _NORMALISERS
        and pieces and first.get("pattern") == {"Regex": _PIECES}
        and spec.get("model", {}).get("end_of_word_suffix")
    )


class WordEncoder:
    """Ids of whole texts by the tokenizers library, which sees each different word core once.

    The tokenizer splits on white space, parts letters from closing punctuation and
    lower-cases, so a word's ids are those of its lower-cased letters and of its closing
    punctuation, one after the other. Words of any other form are encoded as they are.
    Cores of letters are encoded many at a time; each ends with the only one of its ids that ends a word.
    A tokenizer that works in another way (``parts_words``) is given whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype, self.code = (np.dtype("<u4"), "I") if wide else (np.dtype("<u2"), "H")
        self.by_word = parts_words(self.tokenizer.to_str())
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if self.by_word:
            suffix = json.loads(self.tokenizer.to_str())["model"]["end_of_word_suffix"]
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # the generation before: words met again move on
        self.cores: dict[str, bytes] = {}

    def _parts(self, word: str) -> tuple[str, str, bool]:
        """Core, closing punctuation, and whether the core is letters; letters from outside the Latin blocks are left alone."""
        core = word.rstrip(_CLOSING)
        if core.isalpha() and (core.isascii() or max(core) <= _LAST_LATIN):
            lower = core.lower()
            if lower.isalpha():
                return lower, word[len(core) :], True
        return word, "", False

    def _learn(self, words: list[bytes]) -> None:
        split = [(w, *self._parts(w.decode())) for w in words]
        cores, code = self.cores, self.code
        if len(cores) > KEEP_WORDS // 2:
            cores.clear()
        plain = {core for _, core, _, letters in split if letters}.difference(cores)
        other = {core for _, core, _, letters in split if not letters}.union(c for _, _, c, _ in split).difference(cores)
        other.update(self._learn_plain(list(plain)))
        if other:
            for part, e in zip(other, self.tokenizer.encode_batch_fast(list(other), add_special_tokens=False)):
                cores[part] = array(code, e.ids).tobytes()
        self.known.update((w, cores[core] + cores[closing]) for w, core, closing, _ in split)

    def _learn_plain(self, new: list[str]) -> list[str]:
        """Ids of cores of letters; those whose ids cannot be told apart are returned."""
        left: list[str] = []
        lots = [new[lo : lo + TOGETHER] for lo in range(0, len(new), TOGETHER)]
        size = self.dtype.itemsize
        for lot, e in zip(lots, self.tokenizer.encode_batch_fast(list(map(" ".join, lots)), add_special_tokens=False)):
            ids = np.array(e.ids, np.int64)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(lot) or stops[-1] != len(ids):
                left += lot
                continue
            raw, start = ids.astype(self.dtype).tobytes(), 0
            for core, stop in zip(lot, (stops * size).tolist()):
                self.cores[core] = raw[start:stop]
                start = stop
        return left

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text in the smallest fitting type, little-endian as the machine's."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            return [array(self.code, e.ids).tobytes() for e in whole]
        # bytes.split() parts at ASCII white space, on which every step of the tokenizer parts anyway
        split = [t.split() for t in texts]
        if len(self.known) > KEEP_WORDS // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        new = set().union(*split).difference(known)
        again = before.keys() & new  # looks up the few new ones; set.intersection would go through the whole table
        for w in again:
            known[w] = before[w]
        self._learn(list(new - again))
        return [b"".join(map(known.__getitem__, ws)) for ws in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class SequenceWriter:
    """Appends ids to a shard, a batch of sequences at a time."""

    def __init__(self, sink, dtype: np.dtype, length: int = LENGTH, batch: int = BATCH):
        ids = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.length, self.dtype, self.per_batch = length, dtype, length * batch
        self.schema = pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = bytearray()
        self.total = 0

    def append(self, ids: bytes) -> None:
        self.waiting += ids
        self.total += len(ids) // self.dtype.itemsize
        size = self.per_batch * self.dtype.itemsize
        whole = len(self.waiting) // size * size
        for lo in range(0, whole, size):
            self._write(np.frombuffer(bytes(self.waiting[lo : lo + size]), self.dtype))
        if whole:
            del self.waiting[:whole]

    def _write(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        mask = np.arange(len(padded)) < len(ids)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.waiting:
            self._write(np.frombuffer(bytes(self.waiting), self.dtype))
        self.writer.close()


class SequenceReader:
    """Random access to ids and sequences of one shard; a local file is mapped, not read."""

    def __init__(self, uri: str):
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(uri)
        self.source = pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.held: tuple[int, pa.RecordBatch] | None = None
        self.batch_rows = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 1

    def _batch(self, n: int) -> pa.RecordBatch:
        if self.held is None or self.held[0] != n:
            self.held = (n, self.reader.get_batch(n))
        return self.held[1]

    def sequence(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence ``n``."""
        batch, row = self._batch(n // self.batch_rows), n % self.batch_rows
        part = slice(row * self.length, (row + 1) * self.length)
        return (
            batch.column("ids").values.to_numpy()[part],
            batch.column("mask").values.to_numpy(zero_copy_only=False)[part],
        )

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from place ``start`` of the shard on."""
        size, parts = self.length * self.batch_rows, []
        while n > 0:
            values = self._batch(start // size).column("ids").values.to_numpy()
            part = values[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint16), *parts])

    def close(self) -> None:
        self.held = self.reader = None
        self.source.close()


def write_sequences(docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH) -> DataFrame:
    """Write the shards; returns the sidecar ``doc_id, shard, file, place, start_in_shard, n_tokens``.

    Ascending doc_id, null first; rows with the same doc_id in order of a hash of their text.
    Null text is the end id alone. An empty table writes nothing.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "sequences")
    ordered = (
        docs.select(F.col("`doc_id`"), F.col("`text`"))
        .repartitionByRange(shuffle_partitions(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        coder, writer, sink, place = encoder(tokenizer), None, None, 0
        shard = TaskContext.get().partitionId()
        uri = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        end = np.array([end_id], coder.dtype).tobytes()
        for batch in slices(batches):
            if writer is None:
                files, path = fs.FileSystem.from_uri(uri)
                files.create_dir(path.rpartition("/")[0], recursive=True)
                sink = files.open_output_stream(path)
                writer = SequenceWriter(sink, coder.dtype, length)
            starts, sizes = [], []
            data, ends = utf8(batch.column("text"))
            raw, ends = data.tobytes(), ends.tolist()
            for ids in coder.encode([raw[a:b] for a, b in zip(ends, ends[1:])]):
                starts.append(writer.total)
                writer.append(ids + end)
                sizes.append(writer.total - starts[-1])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([shard] * n, pa.int32()), pa.array([uri] * n),
                    pa.array(range(place, place + n), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "shard", "file", "place", "start_in_shard", "n_tokens"],
            )
            place += n
        if writer is not None:
            writer.close()
            sink.close()

    return stage(
        ordered.mapInArrow(run, "doc_id long, shard int, file string, place long, start_in_shard long, n_tokens long"),
        "sidecar",
    )


def read_documents(sidecar: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` read back from the files; ``start`` counts all ids before the document.

    A shard is bounded by the range partitioning, so one task reads one file front to back.
    """
    # one row per file, so a bounded broadcast
    totals = sidecar.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    files = sidecar.repartition(shuffle_partitions(sidecar.sparkSession), "shard").sortWithinPartitions("shard", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            sums = []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start_in_shard", "n_tokens"))):
                if file != name:
                    if reader is not None:
                        reader.close()
                    name, reader = file, SequenceReader(file)
                sums.append(zlib.crc32(reader.ids(start, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "shard", "start_in_shard", "n_tokens")], pa.array(sums, pa.int64())],
                ["doc_id", "shard", "start_in_shard", "n_tokens", "ids_crc32"],
            )
        if reader is not None:
            reader.close()

    read = files.mapInArrow(run, "doc_id long, shard int, start_in_shard long, n_tokens long, ids_crc32 long")
    return read.join(F.broadcast(bases), "shard").select(
        "doc_id", (F.col("base") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )
