"""WARC archives as chunked record tables.

Writing: payloads are cut into (record, chunk number) rows by Spark, and each task streams its rows into one archive of
gzip members, a chunk at a time. Reading: each task streams an archive and gives one row per chunk with the digest of the
payload so far, so that neither side ever holds a whole record. Archives lie in the shared folder and are named by
the rows that the write returns; what a lost or repeated attempt left behind is never read.

Duplicates: of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest page_id is a
response, the others are revisits that name it and hold no payload; smaller payloads are all responses.

Edge cases: null html counts as empty; null urls as empty; rows that repeat a page_id each give a record; a null
page_id refers to others like any other but is referred to only if all copies are null (then each is a response).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.shared import materialize, scratch_path

CHUNK_BYTES = 1 << 20
DATE = "2024-01-01T00:00:00Z"
URN = "urn:siftworks:page:"
_CRLF = b"\r\n"

CHUNKS = (
    "page_id long, url string, record_type string, refers_to long, chunk_no long, chunk binary, payload_bytes long, "
    "payload_digest string, last boolean, valid boolean"
)


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, payload_bytes, sha1 hex, record_type, refers_to) per row of ``pages``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    tops = rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("top"))
    copy = (F.col("payload_bytes") >= min_bytes) & F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.join(tops, ["sha1", "payload_bytes"]).select(
        "page_id", "url", "payload", "payload_bytes", "sha1",
        F.when(copy, "revisit").otherwise("response").alias("record_type"), F.when(copy, F.col("top")).alias("refers_to"),
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of each record, in order within the record: chunk_no, chunk, last. Revisits have one empty chunk."""
    kept = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.lit(0))
    top = F.greatest(F.floor((kept - 1) / chunk_bytes), F.lit(0)).cast("int")
    rows = records.select("*", top.alias("top"), F.explode(F.sequence(F.lit(0), top)).alias("chunk_no"))
    chunk = F.when(F.col("record_type") == "response", F.substr("payload", F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes))).otherwise(F.lit("").cast("binary"))
    return rows.select("page_id", "url", "payload_bytes", "sha1", "record_type", "refers_to", "chunk_no", chunk.alias("chunk"), (F.col("chunk_no") == F.col("top")).alias("last"))


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(page_id: int | None) -> str:
    return f"<{URN}{'' if page_id is None else page_id}>"


def _head(row: dict, digest: str) -> tuple[bytes, bytes]:
    """The record's header, and the HTTP header that opens its block (none in a revisit)."""
    block = b""
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_urn(row['page_id'])}", f"WARC-Date: {DATE}"]
    lines += [f"WARC-Target-URI: {' '.join(row['url'].split())}", f"WARC-Payload-Digest: sha1:{digest}"]
    if row["record_type"] == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {_urn(row['refers_to'])}",
            f"X-Payload-Length: {row['payload_bytes']}",
            "Content-Length: 0",
        ]
    else:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
        lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block) + row['payload_bytes']}"]
    return "\r\n".join(lines).encode() + 2 * _CRLF, block


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Stream chunk rows into archives below ``folder``; (path string, records long) of each archive, written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        path, out, member, records = f"{base}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(path, compression=None)
                if row["chunk_no"] == 0:
                    head, block = _head(row, base32_sha1(bytes.fromhex(row["sha1"])))
                    member = gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0)
                    member.write(head + block)
                    records += 1
                member.write(row["chunk"])
                if row["last"]:
                    member.write(2 * _CRLF)
                    member.close()
        if out is not None:
            out.close()
            name = f"{folder}/{path.rsplit('/', 1)[1]}"
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["path", "records"])

    return materialize(chunks.mapInArrow(run, "path string, records long"), "warc-manifest")


class _Reader:
    """Records of one archive; ``stream`` is decompressed and read a little at a time."""

    def __init__(self, stream, chunk_bytes: int):
        self.stream, self.chunk_bytes = stream, chunk_bytes

    def _headers(self, first: bytes) -> tuple[dict[str, str], int]:
        """Header fields in lower case after a first line, and how many bytes they took."""
        fields, size = {}, len(first)
        while (line := self.stream.readline()) not in (_CRLF, b"\n", b""):
            size += len(line)
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        return fields, size + len(line)

    def records(self) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
        """(header fields, chunks of the payload); the chunks must be used up before the next record."""
        while line := self.stream.readline():
            if not line.startswith(b"WARC/"):
                if line.strip():
                    raise ValueError(f"not a WARC record: {line[:40]!r}")
                continue
            fields, _ = self._headers(line)
            left = int(fields["content-length"])
            if fields.get("content-type", "").startswith("application/http") and left:
                _, size = self._headers(self.stream.readline())
                left -= size
            yield fields, self._chunks(left)

    def _chunks(self, left: int) -> Iterator[bytes]:
        while left > 0:
            chunk = self.stream.read(min(left, self.chunk_bytes))
            if not chunk:
                raise ValueError("the archive ends within a record")
            left -= len(chunk)
            yield chunk


def _page_of(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(URN)
    return int(number) if number else None


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """CHUNKS rows of the archives in ``manifest`` (path); without ``payloads`` the chunk column is null.

    payload_bytes and payload_digest (bare upper-case base32) count the payload up to and with the chunk; a revisit has one row
    with what its header says. ``valid`` says on a record's last row whether digest and length agree with the header.
    """
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    types = dict(zip(names, (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()), strict=True))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], types[n]) for i, n in enumerate(names)})

    def read(path: str) -> Iterator[tuple]:
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
            for h, chunks in _Reader(stream, chunk_bytes).records():
                ids = _page_of(h["warc-record-id"]), h.get("warc-target-uri", ""), h["warc-type"], _page_of(h.get("warc-refers-to"))
                declared = h["warc-payload-digest"].removeprefix("sha1:")
                if h["warc-type"] == "revisit":
                    for _ in chunks:
                        pass
                    yield *ids, 0, b"" if payloads else None, int(h["x-payload-length"]), declared, True, True
                    continue
                digest, size, k, held = hashlib.sha1(), 0, 0, next(chunks, b"")
                while held is not None:
                    following = next(chunks, None)
                    digest.update(held)
                    size += len(held)
                    so_far, last = base32_sha1(digest.digest()), following is None
                    yield *ids, k, held if payloads else None, size, so_far, last, (so_far == declared if last else None)
                    held, k = following, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for path in b.column("path").to_pylist():
                for row in read(path):
                    rows.append(row)
                    size += len(row[5] or b"")
                    if len(rows) >= 4096 or size >= 4 * chunk_bytes:
                        yield batch(rows)
                        rows, size = [], 0
        if rows:
            yield batch(rows)

    # an archive is a task's work: one row each, dealt out evenly
    many = max(1, manifest.count())
    return manifest.select("path").repartitionByRange(many, "path").mapInArrow(run, CHUNKS)


def archive_pages(pages: DataFrame, min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read them back without payloads: one row per record."""
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_archives(chunk_rows(page_records(pages, min_bytes), chunk_bytes), folder)
    read = read_archives(manifest, chunk_bytes, payloads=False)
    return read.filter("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", (F.col("chunk_no") + 1).alias("n_chunks"), "valid")
