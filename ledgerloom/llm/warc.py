"""WARC archives: one gzip member per record, written in tasks and read back sequentially."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import settled
from ledgerloom.session import work_dir

ARCHIVE_BYTES = 64 * 2**20  # a new archive is begun beyond this size
BLOCK = 2**20  # bytes read at once
NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "warc-record")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, str(page))}>"


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the full length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}"]
    head += [f"WARC-Date: {DATE}", *([f"WARC-Target-URI: {target}"] if target else [])]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}"]
    if page is not None:
        head.append(f"Page-ID: {page}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + END + END + block + END + END
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _filled(held: bytearray, more: Iterator[bytes], size: int) -> None:
    while len(held) < size:
        held += next(more)


def members(stream: BinaryIO, block: int = BLOCK) -> Iterator[Iterator[bytes]]:
    """The gzip members of a file, each as an iterator of its decompressed pieces.

    At most ``block`` bytes are read or decompressed at a time; a member must be used up before
    the next one is asked for.
    """
    raw = stream.read(block)

    def one() -> Iterator[bytes]:
        nonlocal raw
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if not raw and not (raw := stream.read(block)):
                raise ValueError("the archive ends inside a record")
            piece = unpack.decompress(raw, block)
            raw = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
            yield piece

    while raw or (raw := stream.read(block)):
        yield one()


def parsed(member: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, framed by its content length; digests are checked."""
    held = bytearray()
    while (cut := held.find(END + END)) < 0:
        held += next(member)
    lines = bytes(held[:cut]).decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0]!r}")
    headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    length = int(headers["content-length"])
    del held[: cut + 4]
    _filled(held, member, length + 4)
    block = bytes(held[:length])
    if bytes(held[length:]) != END + END or any(member):
        raise ValueError("content length and record end differ")
    if headers["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest differs in {headers['warc-record-id']}")
    return headers, block


def opened(headers: dict[str, str], block: bytes) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    http, _, payload = block.partition(END + END)
    fields = dict(line.lower().split(": ", 1) for line in http.decode().split("\r\n")[1:])
    kind, length = headers["warc-type"], int(fields["content-length"])
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (length != len(payload) or said != digest(payload)):
        raise ValueError(f"payload differs in {headers['warc-record-id']}")
    number = lambda name: int(headers[name]) if name in headers else None
    return number("page-id"), length, said, kind, number("refers-to-page-id")


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_archives(
    pages: DataFrame, path: str, id: str = "page_id", url: str = "url", html: str = "html",
    min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Writes a record per row under ``path`` and returns the manifest (path, records).

    Of equal payloads of at least ``min_bytes`` bytes, the record with the smallest id is the
    response and the others revisit it. Only ids and digests are grouped; a payload is shuffled
    once, by id and digest, so that no group of copies meets in a task. Files are named after
    task and attempt, and the manifest, which Spark commits, has those of the attempts that
    succeeded: an executor that is lost leaves files that nobody reads.

    A null html is an empty payload; a null url gives no target. Rows that repeat the id of the
    response are responses too; rows without id revisit, or, where a payload has no id at all,
    are responses. Other columns are ignored; an empty table gives an empty manifest.
    """
    payload = F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8")
    rows = pages.select(pages[id].alias("id"), pages[url].alias("url"), payload.alias("payload")).withColumn(
        "sha", F.unhex(F.sha2("payload", 256))
    )
    narrow = rows.filter(F.octet_length("payload") >= min_bytes).select("id", "sha")
    firsts = narrow.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    revisits = (
        narrow.join(firsts, "sha").filter("first IS NOT NULL AND NOT id <=> first").select("id", "sha", "first").distinct()
    ).alias("v")
    same = (F.col("r.sha") == F.col("v.sha")) & F.col("r.id").eqNullSafe(F.col("v.id"))
    ready = rows.alias("r").join(revisits, same, "left").select(
        "r.id", "r.url", "r.payload", "v.first", F.col("v.sha").isNotNull().alias("revisit")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, folder = place(path)
        store.create_dir(folder, recursive=True)
        out, files, n = None, [], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("id", "url", "payload", "first", "revisit")), strict=True):
                page, target, data, first, revisit = (v.as_py() for v in row)
                if out is None:
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(files):04d}.warc.gz"
                    out, n = store.open_output_stream(f"{folder}/{name}", compression=None), 0
                    files.append([f"{path}/{name}", 0])
                n += out.write(record(page, target, data, first, revisit))
                files[-1][1] += 1
                if n >= archive_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if files:
            yield pa.RecordBatch.from_pydict({"path": [f for f, _ in files], "records": [k for _, k in files]})

    return settled(ready.mapInArrow(write, "path string, records long"), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, batch_rows: int = 1000) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record of the archives.

    An archive is read by one task from front to back, a block at a time, so memory holds a
    block and a record. Framing and digests are checked; a fault, or a count that differs from the
    manifest's, fails the job.
    """
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, list(names))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, file = place(path)
                rows, n = [], 0
                with store.open_input_stream(file, compression=None, buffer_size=0) as stream:
                    for member in members(stream):
                        rows.append(opened(*parsed(member)))
                        n += 1
                        if len(rows) == batch_rows:
                            yield batch_of(rows)
                            rows = []
                if n != wanted:
                    raise ValueError(f"{path} holds {n} records, not {wanted}")
                if rows:
                    yield batch_of(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = manifest.count()
    return manifest.repartition(max(1, files)).mapInArrow(read, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes all pages as archives in the shared folder (or ``path``) and returns what reading them gives."""
    spark = pages.sparkSession
    return read_archives(spark, write_archives(pages, path or work_dir(spark, "warc"), min_bytes=min_bytes))
