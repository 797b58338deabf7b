"""WARC archives: writing, a normaliser for whole-file gzip, and reading by offset.

An archive compressed as one gzip stream can only be read from its start. The normaliser inflates such a stream once,
writes every record as a gzip member of its own and a sidecar index with each record's offset and length. Files are
reached through ``pyarrow.fs`` by URI, so any store that it knows will do. A task that is tried again writes new files;
only files named in the manifest of a finished job are ever read, so lost executors leave no half archives behind.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from .storage import Table, delete, scratch, shuffle_width

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long"
INDEXED = "path string, index_path string, records long"
READ = "page_id long, url string, record_id string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def record_name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    number = name.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def header_value(text: str) -> str:
    """One header line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def record(kind: str, page_id, url: str | None, payload: bytes, digest: bytes, refers_to=None) -> bytes:
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_name(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(digest).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_name(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, from chunks of any size."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                head = held.find(b"\r\n\r\n")
                if head < 0:
                    break
                if not held.startswith(b"WARC/"):
                    raise ValueError("not a WARC record")
                fields = parse_head(bytes(held[: head + 4]))
                need = head + 4 + int(fields["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the stream ends inside a record")


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    at = raw.index(b"\r\n\r\n") + 4
    fields = parse_head(raw[:at])
    block = raw[at : at + int(fields["content-length"])]
    return fields, block[block.index(b"\r\n\r\n") + 4 :]


def inflate(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """A gzip file's content; members that follow each other count as one stream."""
    engine = zlib.decompressobj(31)
    while chunk := stream.read(size):
        while chunk:
            if engine.eof:
                engine = zlib.decompressobj(31)
            out = engine.decompress(chunk, size)
            if out:
                yield out
            chunk = engine.unconsumed_tail or engine.unused_data
    if tail := engine.flush():
        yield tail


def deflate(raw: bytes, level: int = 6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, 31)
    return engine.compress(raw) + engine.flush()


def _opened(uri: str):
    return pafs.FileSystem.from_uri(uri)


def normalise_archive(uri: str, target: str) -> tuple[str, int]:
    """Rewrite one archive with a gzip member for each record; returns the index path and the number of records."""
    fs, path = _opened(uri)
    out_fs, out_path = _opened(target)
    index, at = target + ".idx", 0
    index_path, n = _opened(index)[1], 0
    with fs.open_input_stream(path, compression=None) as stream, out_fs.open_output_stream(out_path, compression=None) as out, out_fs.open_output_stream(index_path, compression=None) as idx:
        for raw in split_records(inflate(stream)):
            member = deflate(raw)
            out.write(member)
            fields = parse_head(raw[: raw.index(b"\r\n\r\n") + 4])
            idx.write(json.dumps({"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "uri": fields.get("warc-target-uri")}).encode() + b"\n")
            at, n = at + len(member), n + 1
    return index, n


def read_indexed(uri: str, index: str) -> Iterator[dict]:
    """Records of a normalised archive, each fetched by its offset and inflated by itself."""
    fs, path = _opened(uri)
    with _opened(index)[0].open_input_stream(_opened(index)[1], compression=None) as idx, fs.open_input_file(path) as archive:
        held = b""
        while chunk := idx.read(1 << 20):
            *lines, held = (held + chunk).split(b"\n")
            for line in lines:
                entry = json.loads(line)
                raw = zlib.decompress(archive.read_at(entry["length"], entry["offset"]), 31)
                fields, payload = parse(raw)
                if fields["warc-record-id"] != entry["id"]:
                    raise ValueError("the index points at another record")
                stated = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
                response = fields["warc-type"] == "response"
                if response and hashlib.sha1(payload).digest() != stated:
                    raise ValueError("payload digest differs")
                yield {
                    "page_id": page_of(fields["warc-record-id"]),
                    "url": fields.get("warc-target-uri"),
                    "record_id": fields["warc-record-id"],
                    "payload_bytes": len(payload) if response else int(fields["x-payload-length"]),
                    "payload_digest": stated.hex(),
                    "record_type": fields["warc-type"],
                    "refers_to": None if response else page_of(fields["warc-refers-to"]),
                    "html": payload.decode("utf-8") if response else None,
                }


def _writer(folder: str, archive_bytes: int):
    def write(batches):
        """Monolithic archives: one gzip stream each."""
        out = engine = path = None
        size = n = 0
        done = []
        for batch in batches:
            for page_id, url, html, keeper in zip(*(batch.column(i) for i in range(4)), strict=True):
                page_id, keeper, payload = page_id.as_py(), keeper.as_py(), (html.as_py() or "").encode()
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    fs, at = _opened(path)
                    out, engine, size, n = fs.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                again = keeper is not None and keeper != page_id
                raw = record("revisit" if again else "response", page_id, url.as_py(), payload, hashlib.sha1(payload).digest(), keeper)
                out.write(engine.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.write(engine.flush())
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.write(engine.flush())
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return write


def _ensure(folder: str) -> None:
    fs, path = _opened(folder)
    fs.create_dir(path, recursive=True)


def write_archives(pages: DataFrame, folder: str, id_col="page_id", url_col="url", payload_col="html", min_revisit_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> Table:
    """Write every row as a record into whole-file gzip archives below ``folder``; the manifest names them."""
    _ensure(folder)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    size = F.octet_length("html")
    long = F.when(size >= min_revisit_bytes, F.struct(F.sha2("html", 256).alias("sha"), size.alias("size")))
    keepers = rows.select("page_id", long.alias("key")).where("key is not null").groupBy("key").agg(F.max("page_id").alias("keeper"))
    # One hot payload makes the page side uneven; the keeper side has one row per payload, so the join can be split.
    chosen = rows.withColumn("key", long).join(keepers, "key", "left").select("page_id", "url", "html", "keeper")
    return Table(pages.sparkSession, chosen.mapInArrow(_writer(folder, archive_bytes), MANIFEST), "warc-manifest")


def normalise_archives(manifest: DataFrame, folder: str) -> Table:
    _ensure(folder)

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                index, n = normalise_archive(path, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([index]), pa.array([n], pa.int64())], names=["path", "index_path", "records"])

    spark = manifest.sparkSession
    spread = manifest.select("path").repartition(shuffle_width(spark), "path")
    return Table(spark, spread.mapInArrow(run, INDEXED), "warc-index")


def read_archives(indexed: DataFrame) -> DataFrame:
    """All records of normalised archives; ``html`` is null for revisits."""

    def run(batches):
        for batch in batches:
            for path, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size = [], 0
                for row in read_indexed(path, index):
                    rows.append(row)
                    size += row["payload_bytes"]
                    if size > 4 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return indexed.select("path", "index_path").repartition(shuffle_width(indexed.sparkSession), "path").mapInArrow(run, READ)


_READ_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in READ.split(", "))])


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_READ_SCHEMA)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Write pages, normalise the archives and read them back: one row per input row.

    Of equal payloads of at least 1000 bytes the row with the largest id is the response (all rows with that id, should it
    repeat) and the rest revisit it; a null id ranks below all others, and shorter payloads are always responses. A
    null payload counts as empty, a null url leaves out its header, other columns are not read, and an empty table gives
    an empty result.
    """
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    manifest = write_archives(pages, folder + "/whole")
    indexed = normalise_archives(manifest.df, folder + "/members")
    delete(spark, folder + "/whole")
    manifest.drop()
    return read_archives(indexed.df)
