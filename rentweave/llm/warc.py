"""WARC archives: whole-file gzip streams, their normalisation to one member per record, and reading by offset.

``write_archives`` writes records as many crawlers' dumps come: one gzip stream per file.
``normalise`` inflates each such file once, front to back, in bounded memory but for the
record at hand, writes every record again as a gzip member of its own and keeps a sidecar
index of offsets and lengths (a table, and lines of JSON beside each archive).
``read_records`` fetches single records by the index.

Files go below a shared folder through ``pyarrow.fs``, under a name of their own per task
attempt. Only files that a finished stage has named are read, so lost executors and
repeated tasks leave nothing in the result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rentweave.llm.common import shared_folder, slices, stage

#: Bytes of records after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
_READ = 1 << 20
_DATE = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile("[\x00-\x20\x7f]")
_INDEX = "file string, offset long, length long, record_id string"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC/1.1 record; line breaks and blanks in field values are percent-encoded."""
    clean = {k: _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", v) if k == "WARC-Target-URI" else v for k, v in fields.items()}
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {_DATE}"]
    lines += [f"{k}: {v}" for k, v in clean.items()] + [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, copy: bool) -> bytes:
    """A response with the payload, or a revisit that names the response."""
    payload = (html or "").encode()
    fields = {"WARC-Payload-Digest": f"sha1:{payload_digest(payload)}", "X-Payload-Bytes": str(len(payload))}
    if url is not None:
        fields["WARC-Target-URI"] = url
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields["Content-Type"] = "application/http; msgtype=response"
    name = f"urn:page:{'' if page_id is None else page_id}"
    if copy:
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        return record("revisit", name, fields, head)
    return record("response", name, fields, head + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (names in lower case) and block of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def inflate(source) -> Iterator[bytes]:
    """Inflated chunks of a gzip stream of one or many members."""
    engine, begun = zlib.decompressobj(wbits=31), False
    while chunk := source.read(_READ):
        while chunk:
            begun = True
            yield engine.decompress(chunk, 4 * _READ)
            while engine.unconsumed_tail:
                yield engine.decompress(engine.unconsumed_tail, 4 * _READ)
            chunk = engine.unused_data
            if engine.eof:
                engine, begun = zlib.decompressobj(wbits=31), False
    if begun:
        yield engine.flush()
        if not engine.eof:
            raise ValueError("the archive ends inside a member")


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of inflated chunks; holds one record and a chunk at a time."""
    held, need = bytearray(), 0
    for chunk in chunks:
        held += chunk
        while len(held) >= max(need, 1):
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                size = re.search(rb"(?im)^content-length:\s*(\d+)", bytes(held[: end + 4]))
                if not held.startswith(b"WARC/") or not size:
                    raise ValueError("not a WARC record")
                need = end + 4 + int(size[1]) + 4
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends inside a record")


def mark_copies(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, copy``: of equal payloads of at least ``least_bytes`` the smallest page_id is kept.

    Null html is an empty payload; rows without an id refer to the smallest id if there is
    one; rows that repeat the kept id are kept as well.
    """
    html = F.coalesce(F.col("`html`"), F.lit(""))
    rows = pages.select(
        F.col("`page_id`").cast("long").alias("page_id"), F.col("`url`").alias("url"), F.col("`html`").alias("html"),
        F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"),
    )
    several = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(
        F.min("page_id").alias("refers_to"), F.count("*").alias("n")
    ).where("n > 1").drop("n")
    copy = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return rows.join(several, ["sha", "size"], "left").select(
        "page_id", "url", "html", F.when(copy, F.col("refers_to")).alias("refers_to"), copy.alias("copy")
    )


def write_archives(marked: DataFrame) -> DataFrame:
    """Write all records to whole-file gzip archives; returns ``file, records``."""
    folder = shared_folder(marked.sparkSession, "crawl")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        sink = engine = uri = None
        written = records = 0
        for batch in slices(batches, "html"):
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "copy")]
            for row in zip(*columns):
                if sink is None:
                    uri = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    files, path = fs.FileSystem.from_uri(uri)
                    files.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = files.open_output_stream(path, compression=None)
                    engine, written, records = zlib.compressobj(4, wbits=31), 0, 1
                    sink.write(engine.compress(record("warcinfo", f"urn:uuid:{uuid.uuid4()}", {}, b"format: WARC\r\n")))
                data = page_record(*row)
                sink.write(engine.compress(data))
                written, records = written + len(data), records + 1
                if written >= ARCHIVE_BYTES:
                    sink.write(engine.flush())
                    sink.close()
                    sink = None
                    yield pa.RecordBatch.from_pydict({"file": [uri], "records": pa.array([records], pa.int64())})
        if sink is not None:
            sink.write(engine.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": pa.array([records], pa.int64())})

    return stage(marked.mapInArrow(run, "file string, records long"), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite every archive of ``archives(file)`` with a member per record; returns the index.

    ``file, offset, length, record_id``, where ``file`` is the new archive beside the old one.
    """
    spread = archives.select("file").repartition(max(1, min(archives.count(), 100_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for uri in batch.column("file").to_pylist():
                files, path = fs.FileSystem.from_uri(uri)
                stem = f"{uri.removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}"
                new = f"{stem}.member.warc.gz"
                rows: dict[str, list] = {"file": [], "offset": [], "length": [], "record_id": []}
                offset = 0
                with (
                    files.open_input_stream(path, compression=None) as source,
                    files.open_output_stream(fs.FileSystem.from_uri(new)[1], compression=None) as sink,
                    files.open_output_stream(fs.FileSystem.from_uri(f"{stem}.index.jsonl")[1], compression=None) as side,
                ):
                    for data in split_records(inflate(source)):
                        fields, _ = parse_record(data)
                        engine = zlib.compressobj(4, wbits=31)
                        member = engine.compress(data) + engine.flush()
                        sink.write(member)
                        row = (new, offset, len(member), fields["warc-record-id"].strip("<>"))
                        side.write(json.dumps(dict(zip(rows, row))).encode() + b"\n")
                        for column, value in zip(rows.values(), row):
                            column.append(value)
                        offset += len(member)
                types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows.values(), types)], list(rows))

    return stage(spread.mapInArrow(run, _INDEX), "offsets")


def read_records(index: DataFrame) -> DataFrame:
    """Every page record of the index, fetched by its offset: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    A response's size and digest are taken from its payload and must agree with its fields.
    """

    def number(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        name = source = None
        for batch in batches:
            rows = []
            for uri, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                if uri != name:
                    if source is not None:
                        source.close()
                    files, path = fs.FileSystem.from_uri(uri)
                    name, source = uri, files.open_input_file(path)
                fields, block = parse_record(zlib.decompress(source.read_at(length, offset), wbits=31))
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                size, digest = int(fields["x-payload-bytes"]), fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if (len(payload), payload_digest(payload)) != (size, digest):
                        raise ValueError(f"payload of {fields['warc-record-id']} does not match its fields")
                rows.append((number(fields["warc-record-id"]), size, digest, kind, number(fields.get("warc-refers-to"))))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if source is not None:
            source.close()

    return index.select("file", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )
