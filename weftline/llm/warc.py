"""WARC archives with revisit records, read back as a table of payload chunks.

Records are written one gzip member each, streamed into files in the shared folder; equal payloads are kept once and
revisited. Reading streams too: a payload comes as rows of record and chunk number with the SHA-256 of all up to
there, so no record is ever held whole.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import _shared

LEAST_REVISITED = 100
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = "page_id bigint, chunk_no bigint, chunk_bytes bigint, bytes_so_far bigint, digest_so_far string, last boolean, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"


def open_file(path: str, mode: str):
    """A binary stream on a local path or any URI that pyarrow's file systems reach."""
    from pyarrow import fs

    if re.match(r"[a-zA-Z][a-zA-Z0-9+.-]+:", path):
        system, path = fs.FileSystem.from_uri(path)
    else:
        system = fs.LocalFileSystem()
    if mode == "r":
        return system.open_input_stream(path, compression=None)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def headers(page_id: int | None, url: str | None, size: int, digest: str, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """The record's header and the start of its block, the HTTP header. Control characters of urls are percent-encoded."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    lines.append(f"Content-Length: {len(http) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def write_record(out, page_id, url, payload: memoryview, digest: str, refers_to, date: str, level: int, chunk: int = CHUNK) -> None:
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    head, http = headers(page_id, url, len(payload), digest, refers_to, date)
    out.write(gz.compress(head + http))
    if refers_to is None:
        for at in range(0, len(payload), chunk):
            out.write(gz.compress(payload[at : at + chunk]))
    out.write(gz.compress(b"\r\n\r\n") + gz.flush())


class Inflated:
    """A stream of concatenated gzip members, inflated at most ``chunk`` bytes at a time."""

    def __init__(self, stream, chunk: int = CHUNK):
        self.stream, self.chunk = stream, chunk
        self.inflate, self.raw, self.ready = zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.chunk)
                if not self.raw:
                    return False
            got = self.inflate.decompress(self.raw, self.chunk)
            self.raw = self.inflate.unconsumed_tail
            if got:
                self.ready += got
                return True

    def line(self) -> bytes | None:
        """Up to and with the next line end; None at the end of the stream."""
        while (at := self.ready.find(b"\n")) < 0:
            if not self.more():
                if self.ready:
                    raise ValueError("archive ends within a line")
                return None
        got, self.ready = self.ready[: at + 1], self.ready[at + 1 :]
        return got

    def pieces(self, size: int):
        """The next ``size`` bytes in pieces of ``chunk``, the last of which may be shorter."""
        while size:
            want = min(size, self.chunk)
            while len(self.ready) < want:
                if not self.more():
                    raise ValueError("archive ends within a record")
            got, self.ready = self.ready[:want], self.ready[want:]
            size -= len(got)
            yield got


def fields(source: Inflated) -> dict[str, str]:
    found = {}
    while (line := source.line()) not in (b"\r\n", b"\n"):
        if line is None:
            raise ValueError("archive ends within a header")
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def chunks(source: Inflated):
    """Rows of ``CHUNK_SCHEMA`` with the chunk's bytes, record by record; a payload without bytes has one row."""
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        head, left = fields(source), 0
        kind, left = head["warc-type"], int(head["content-length"])
        http, start = {}, source.line()
        left -= len(start)
        while (line := source.line()) != b"\r\n":
            left -= len(line)
            name, _, value = line.decode().partition(":")
            http[name.strip().lower()] = value.strip()
        left -= 2
        page = int(head["x-page"]) if "x-page" in head else None
        refers = int(head["x-refers-to-page"]) if kind == "revisit" else None
        size, digest = int(http["content-length"]), head["warc-payload-digest"].partition(":")[2]
        rest = (kind, refers, size, digest)
        so_far, done, k = hashlib.sha256(), 0, 0
        for piece in source.pieces(left):
            so_far.update(piece)
            done += len(piece)
            left -= len(piece)
            yield (page, k, len(piece), done, so_far.hexdigest(), left == 0, *rest), piece
            k += 1
        if not k:
            yield (page, 0, 0, 0, so_far.hexdigest(), True, *rest), b""
        if kind == "response" and (done != size or so_far.hexdigest() != digest):
            raise ValueError(f"record of page {page} does not hold the payload it declares")


def plan_records(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_digest, refers_to``: what is written for each page.

    Of pages with equal payloads of at least 100 bytes that with the smallest page_id is kept, others refer to it.
    Rows that repeat this page_id are kept too; rows with a null page_id only refer to others. Null html is empty.
    """
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long = rows.where(F.octet_length("html") >= LEAST_REVISITED).select("page_id", "payload_digest")
    shared = long.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("first").isNotNull())
    again = long.join(shared.select("payload_digest", "first"), "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    again = again.groupBy("page_id", "payload_digest").agg(F.min("first").alias("refers_to"))
    return rows.alias("r").join(again.alias("a"), F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.payload_digest") == F.col("a.payload_digest")), "left").select("r.page_id", "r.url", "r.html", "r.payload_digest", "a.refers_to")


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Writes a record per page into ``folder`` and returns ``path, records`` of the files.

    A file per partition; each attempt at a task writes a file of its own, and only those of attempts that ended well
    are returned, so lost executors leave unused files but no doubled or missing record. An empty table writes none.
    """
    folder = folder or _shared.new_folder(pages.sparkSession, "warc")

    def run(batches):
        path, out, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            for page_id, url, html, digest, refers in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), b.column(4).to_pylist(), strict=True):
                out = out or open_file(path, "w")
                write_record(out, page_id, url.as_py(), memoryview(html.as_buffer()), digest.as_py(), refers, date, level)
                n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "records"])

    return _shared.written(plan_records(pages).mapInArrow(run, "path string, records bigint"), "warc-files")[0]


def chunk_table(files: DataFrame, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """The records of archives (column ``path``) as rows of ``CHUNK_SCHEMA``, with ``payload`` where asked for.

    Rows leave in batches of about a megabyte, so memory does not depend on a record's size.
    """
    names = [x.split()[0] for x in CHUNK_SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    types = [kinds[x.split()[1]] for x in CHUNK_SCHEMA.split(", ")]

    def run(batches):
        def batch(rows, payloads):
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(payloads, pa.binary())] * with_payload, names + ["payload"] * with_payload)

        for b in batches:
            for path in b.column(0).to_pylist():
                rows, payloads, held = [], [], 0
                with open_file(path, "r") as stream:
                    for row, piece in chunks(Inflated(stream, chunk)):
                        rows.append(row)
                        held += 200
                        if with_payload:
                            payloads.append(piece)
                            held += len(piece)
                        if held > 1 << 20:
                            yield batch(rows, payloads)
                            rows, payloads, held = [], [], 0
                if rows:
                    yield batch(rows, payloads)

    n = max(1, files.count())
    return files.select("path").repartition(n).mapInArrow(run, CHUNK_SCHEMA + ", payload binary" * with_payload)


def records(table: DataFrame) -> DataFrame:
    """One row per record of a chunk table, from its last chunk: revisits stand for the payload they refer to."""
    return table.where("last").select("page_id", "payload_bytes", F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(chunk_table(write_archives(_shared.table(spark, sf_dir, "pages")), with_payload=False))
