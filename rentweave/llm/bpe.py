"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece exactly one token can come last in its encoding. A token is
that last one if it joins the last token of what stands before it without a merge across
the seam, which is decided on the two tokens alone. So a piece's table (last token per
prefix) is filled left to right in time linear in its length; the encoding is read off
backwards, appended bytes only add entries, and an edit recomputes entries from its first
byte on (those before it stay).

``encode_documents`` applies it to documents; null text encodes as empty. Each match of
the splitting pattern is a piece of its own. Chunks (a word with its leading space, or a
run of white space) contain whole pieces, so their encodings are kept in a bounded table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rentweave.llm.common import only, slices

_LATE = 1 << 60
#: White space as the splitting pattern's ``\s`` has it.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: Encoded chunks that a Python worker keeps, in two generations: those met again move on.
KEEP_CHUNKS = 1_000_000
#: Pairs of tokens whose seam a Python worker remembers.
KEEP_SEAMS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixBpe:
    """Encoder and decoder over one set of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.whole: dict[int, bool] = {}
        self.seams: dict[int, bool] = {}

    def _merge(self, token: bytes, until: int) -> list[bytes]:
        """Merge by rank, leftmost first, down to ``until`` parts; only for single tokens."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], _LATE), i) for i in range(len(parts) - 1))
            if rank == _LATE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that merge into this one; None for a single byte."""
        if token not in self.parts:
            data = self.bytes_of[token]
            parts = self._merge(data, 2)
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def _reachable(self, token: int) -> bool:
        if token not in self.whole:
            data = self.bytes_of[token]
            self.whole[token] = len(data) == 1 or len(self._merge(data, 1)) == 1
        return self.whole[token]

    def joins(self, left: int, right: int) -> bool:
        """``_joins``, remembered for up to ``KEEP_SEAMS`` pairs."""
        key = left << 32 | right
        known = self.seams.get(key)
        if known is None:
            if len(self.seams) >= KEEP_SEAMS:
                self.seams.clear()
            known = self.seams[key] = self._joins(left, right)
        return known

    def _joins(self, left: int, right: int) -> bool:
        """Encoding both tokens' bytes together gives just the two tokens.

        Goes back in time: the younger of the two edge parts is split until both are
        bytes. A merge across the seam would have come first if it ranks before the
        merge that used up the left part, or not after the one that used up the right
        part (the leftmost of equal merges comes first).
        """
        left_end = right_end = _LATE
        while True:
            across = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if across is not None and across < left_end and across <= right_end:
                return False
            if left > right:
                inner = self._split(left)
                if inner is None:
                    return True
                left_end, left = left, inner[1]
            else:
                inner = self._split(right)
                if inner is None:
                    return True
                right_end, right = right, inner[0]

    def extend(self, piece: bytes, last: list[int]) -> list[int]:
        """Fill ``last`` (last token of each prefix of ``piece``, from length 1) up to the whole piece."""
        ranks, longest, seams, joins = self.ranks, self.longest, self.seams, self.joins
        for end in range(len(last) + 1, len(piece) + 1):
            for start in range(max(0, end - longest), end):
                part = piece[start:end]
                if part not in ranks:
                    continue
                token = ranks[part]
                if start == 0:
                    fits = self._reachable(token)
                else:
                    before = last[start - 1]
                    fits = seams.get(before << 32 | token)
                    if fits is None:
                        fits = joins(before, token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError("the ranks lack a single byte")
        return last

    def replace(self, piece: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Piece and table with ``piece[start:stop]`` exchanged for ``new``; entries before it are kept."""
        piece = piece[:start] + new + piece[stop:]
        return piece, self.extend(piece, last[:start])

    def read_off(self, last: list[int]) -> list[int]:
        tokens, end = [], len(last)
        while end:
            tokens.append(last[end - 1])
            end -= len(self.bytes_of[last[end - 1]])
        return tokens[::-1]

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and self._reachable(whole):
            return [whole]
        return self.read_off(self.extend(piece, []))

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


class DocumentCodec:
    """Encodes whole texts chunk by chunk, keeping a bounded table of up to ``keep`` encoded chunks."""

    def __init__(self, ranks_path: str, pattern: str, keep: int = KEEP_CHUNKS):
        self.keep = keep
        self.bpe = PrefixBpe(read_ranks(ranks_path))
        self.pieces = regex.compile(pattern)
        self.known: dict[str, tuple[int, str, bytes]] = {}
        self.before: dict[str, tuple[int, str, bytes]] = {}

    def forget(self) -> None:
        """Drop what was learned from texts; the ranks stay."""
        self.known, self.before = {}, {}
        self.bpe.seams = {}

    def tokens(self, text: str) -> list[int]:
        return [t for piece in self.pieces.findall(text) for t in self.bpe.encode(piece.encode())]

    def _chunk(self, chunk: str) -> tuple[int, str, bytes]:
        out = self.before.get(chunk)
        if out is None:
            tokens = self.tokens(chunk)
            out = (len(tokens), " ".join(map(str, tokens)), self.bpe.decode(tokens))
        if len(chunk) < 64:
            self.known[chunk] = out
        return out

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, sha-256 of the ids in decimal and of the bytes decoded from them."""
        if len(self.known) >= self.keep // 2:
            self.known, self.before = {}, self.known
        known, chunk_of = self.known.get, self._chunk
        ids, decoded = hashlib.sha256(), hashlib.sha256()
        some = [known(c) or chunk_of(c) for c in _CHUNK.findall(text)]
        n = sum(x[0] for x in some)
        ids.update(" ".join([x[1] for x in some]).encode())
        decoded.update(b"".join([x[2] for x in some]))
        return n, ids.hexdigest(), decoded.hexdigest()


_CODECS: dict[tuple[str, str], DocumentCodec] = {}


def codec(ranks_path: str, pattern: str, keep: int = KEEP_CHUNKS) -> DocumentCodec:
    """One codec per Python worker: its tables serve all tasks of that worker."""
    key = (ranks_path, pattern)
    if key not in _CODECS:
        _CODECS[key] = DocumentCodec(ranks_path, pattern, keep)
    _CODECS[key].keep = keep
    return _CODECS[key]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token ids of every whole text: ``doc_id, ids array<int>``; null text gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in slices(batches):
            ids = [coder.tokens(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def token_digests(
    docs: DataFrame, ranks_path: str, pattern: str, keep: int = KEEP_CHUNKS, lasting: bool = True
) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode every whole text, decode the ids.

    One row per input row, repeated ids included; a null doc_id stays null. No shuffle. ``keep``: encoded
    chunks that a worker holds, about 250 bytes each; it costs memory for time and changes no result.
    Unless ``lasting``, they go when a task ends, which leaves their memory to the steps after this one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern, keep)
        try:
            for batch in slices(batches):
                rows = [coder.digest(t or "") for t in batch.column("text").to_pylist()]
                n, ids, decoded = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
        finally:
            if not lasting:
                coder.forget()

    return only(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
