"""Byte-level BPE (op6) and Arrow sequences (op7) against the public libraries."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from rentweave.llm import arrowtokens, bpe

RANKS = P.path("byte_bpe_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "the", " The", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "\u3000", "\x1c", "\x85", "é", "e\u0301", "ñ", "中", "😀", "0", "12", "!!", "<|endoftext|>", "Σ", "ΑΣ ", ".", ",", ";", "!?", ":", "The", "É", "ß", "İ", "ŉ"]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(ALPHABET, k=r.randrange(40))) for _ in range(n)]


def test_encoder_equals_library(tiktoken_encoding):
    coder = bpe.DocumentCodec(RANKS, P.PATTERN)
    for t in texts(3000, 1):
        want = tiktoken_encoding.encode_ordinary(t)
        n, ids, decoded = coder.digest(t)
        assert (n, ids) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest())
        assert decoded == hashlib.sha256(t.encode()).hexdigest()


def test_pieces_of_any_bytes(tiktoken_encoding):
    coder, r = bpe.PrefixBpe(bpe.read_ranks(RANKS)), random.Random(2)
    for _ in range(2000):
        piece = bytes(r.choices(b"aeinst ro\xc3\xa9\x00", k=r.randrange(1, 80)))
        assert coder.encode(piece) == tiktoken_encoding._encode_single_piece(piece)
    assert coder.encode(b"a" * 30_000) == tiktoken_encoding._encode_single_piece(b"a" * 30_000)


def test_appends_and_edits():
    coder, r = bpe.PrefixBpe(bpe.read_ranks(RANKS)), random.Random(3)
    for _ in range(200):
        piece, more = (bytes(r.choices(b"aeinstro ", k=r.randrange(1, 40))) for _ in range(2))
        last = coder.extend(piece, [])
        assert coder.read_off(coder.extend(piece + more, list(last))) == coder.encode(piece + more)
        a = r.randrange(len(piece))
        b = r.randrange(a, len(piece) + 1)
        edited, table = coder.replace(piece, last, a, b, more)
        assert edited == piece[:a] + more + piece[b:] and coder.read_off(table) == coder.encode(edited)


def test_document_digests(awkward, tiktoken_encoding, no_documents):
    docs, rows = awkward
    got = bpe.token_digests(docs, RANKS, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = tiktoken_encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    ids = {r.doc_id: r.ids for r in bpe.encode_documents(docs, RANKS, P.PATTERN).collect()}
    assert ids[12] == tiktoken_encoding.encode_ordinary(dict(rows)[12])
    assert bpe.token_digests(no_documents, RANKS, P.PATTERN).count() == 0


def test_tables_go_when_a_task_ends(monkeypatch):
    runs = []

    class Docs:
        def mapInArrow(self, run, schema):
            runs.append(run)

    monkeypatch.setattr(bpe, "only", lambda docs, *columns: Docs())
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["thexqzvw river", None]})
    got = []
    for lasting in (True, False):
        bpe.token_digests(None, RANKS, P.PATTERN, lasting=lasting)
        got.append(list(runs[-1](iter([batch]))))
        coder = bpe.codec(RANKS, P.PATTERN)
        assert bool(coder.known) == bool(coder.bpe.seams) == lasting
    assert got[0] == got[1] and got[0][0].num_rows == 2


def test_words_encode_by_themselves():
    from tokenizers import Tokenizer

    tokenizer, coder = Tokenizer.from_file(WORDS), arrowtokens.WordEncoder(WORDS)
    marks = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    r = random.Random(8)
    some = [" ".join(r.choice(["It", "naïve", "ŒUF", "x1", "don't", ""]) + "".join(r.choices(marks, k=r.randrange(5))) for _ in range(20)) for _ in range(500)]
    some += [f"one {' '.join(chr(c) * n for n in (1, 2, 3))} two" for c in range(0xA0, 0x250)]
    some += texts(4000, 4) + ["The end. THE END!? the'S, it's. <|ENDOFTEXT|>. <|endoftext|>, Ñandú; İI. ǅ: e\u0301. naïve... O'Neil's", "ΟΔΟΣ. οδος!"]
    for t, e, ids in zip(some, tokenizer.encode_batch(some, add_special_tokens=False), coder.encode([t.encode() for t in some])):
        assert np.frombuffer(ids, coder.dtype).tolist() == e.ids, t


def test_other_tokenizers_see_whole_texts():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    tokenizer, coder = Tokenizer.from_file(path), arrowtokens.WordEncoder(path)
    assert not coder.by_word and arrowtokens.WordEncoder(WORDS).by_word
    some = texts(300, 6) + ["Two  words. ", "", "\n"]
    for e, ids in zip(tokenizer.encode_batch(some, add_special_tokens=False), coder.encode([t.encode() for t in some])):
        assert np.frombuffer(ids, coder.dtype).tolist() == e.ids


def test_sequences_round_trip(spark, awkward, no_documents):
    from tokenizers import Tokenizer

    docs, rows = awkward
    sidecar = arrowtokens.write_sequences(docs, WORDS, 1, length=64)
    got = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in arrowtokens.read_documents(sidecar).collect()}
    tokenizer, start, want = Tokenizer.from_file(WORDS), 0, []
    assert len(got) == len(rows)
    sizes = sorted((i is not None, i or 0, s) for (i, s) in got)
    for _, i, s in sizes:  # ascending ids, null first, end to end
        i = i if (i, s) in got else None
        assert s == start
        start += got[(i, s)][0]
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(want) == sorted((str(i), n, c) for (i, _), (n, c) in got.items())
    shard = max(sidecar.collect(), key=lambda r: r.n_tokens)
    reader = arrowtokens.SequenceReader(shard.file)
    first, rest = divmod(shard.start_in_shard, 64)
    ids, mask = reader.sequence(first + 1)
    assert mask.all() and ids.tolist() == reader.ids(shard.start_in_shard - rest + 64, 64).tolist()
    total = sum(r.n_tokens for r in sidecar.collect() if r.file == shard.file)
    _, mask = reader.sequence((total - 1) // 64)
    assert mask.sum() == (total - 1) % 64 + 1
    assert arrowtokens.read_documents(arrowtokens.write_sequences(no_documents, WORDS, 1)).count() == 0
