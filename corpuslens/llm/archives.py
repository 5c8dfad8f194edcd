"""Operator 8: WARC records in ZIP-packaged archives, read by range without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` holds WARC records, each a gzip member of its own,
and ``indexes/index.cdx`` has a line of JSON for each record (offset and length in the data member). The reader opens
no member as a whole: it reads the end of the file, the central directory (ZIP64 where fields overflow), the local
header of the members it needs, the index, and then the byte ranges of records. Members without an index are walked
from gzip member to gzip member.

Files are reached through pyarrow's file systems, so that a folder may be local, shared, or in an object store. A
writing task names its files by its attempt and lists them in the rows it returns; only rows of committed tasks are
read, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, arrow_stream, join_keyed, scratch, stage

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: An archive is closed when its records fill so many bytes.
ARCHIVE_BYTES = 16 << 20
#: Neighbouring records are read in one request up to this size.
RANGE_BYTES = 4 << 20
#: Tasks that read at most; each has as many ranges as it takes.
TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# --- ZIP directory -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int  #: stored bytes
    header: int  #: offset of the local header


def read_at(file, offset: int, size: int) -> bytes:
    file.seek(offset)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"archive ends before byte {offset + size}")
    return data


def directory(file, length: int) -> list[Member]:
    """Members by the central directory, in its order; ``file`` is seekable and ``length`` bytes long."""
    tail = read_at(file, max(0, length - 22 - 65535), min(length, 22 + 65535))
    at = tail.rfind(b"PK\x05\x06")
    # the signature may stand in a comment: the true one's comment ends with the file
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("not a ZIP archive: no end of central directory")
    count, size, start = struct.unpack_from("<HII", tail, at + 10)
    end = length - len(tail) + at
    if 0xFFFF == count or 0xFFFFFFFF in (size, start):
        if end < 20:
            raise ValueError("ZIP64 locator is missing")
        signature, _, where, _ = struct.unpack("<IIQI", read_at(file, end - 20, 20))
        if signature != 0x07064B50:
            raise ValueError("ZIP64 locator is missing")
        record = read_at(file, where, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("ZIP64 end of central directory is missing")
        count, size, start = struct.unpack_from("<QQQ", record, 32)
    data, at, members = read_at(file, start, size), 0, []
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("central directory is damaged")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        stored, full, name, extra, comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        raw = data[at + 46 : at + 46 + name]
        fields = data[at + 46 + name : at + 46 + name + extra]
        while len(fields) >= 4:
            kind, n = struct.unpack_from("<HH", fields)
            if kind == 1:  # ZIP64: only the fields that overflow, in this order
                values = iter(struct.unpack_from(f"<{min(n // 8, 3)}Q", fields, 4))
                full = next(values) if full == 0xFFFFFFFF else full
                stored = next(values) if stored == 0xFFFFFFFF else stored
                header = next(values) if header == 0xFFFFFFFF else header
            fields = fields[4 + n :]
        members.append(Member(raw.decode("utf-8" if flags & 0x800 else "cp437"), method, stored, header))
        at += 46 + name + extra + comment
    return members


def data_start(file, member: Member) -> int:
    """Where a member's bytes begin: behind its local header, whose name and extra fields may have other lengths."""
    if member.method != 0:
        raise ValueError(f"member {member.name} is compressed; only stored members can be read by range")
    head = read_at(file, member.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"local header of {member.name} is damaged")
    name, extra = struct.unpack_from("<HH", head, 26)
    return member.header + 30 + name + extra


def locate(file, length: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the archive of every record of its stored .warc.gz members."""
    members = {m.name: m for m in directory(file, length)}
    indexed: dict[str, list[tuple[int, int]]] = {}
    for name, member in members.items():
        if name.startswith("indexes/") and member.method == 0:
            for line in read_at(file, data_start(file, member), member.size).decode().splitlines():
                entry = json.loads(line[line.index("{") :])
                indexed.setdefault("archive/" + entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
    for name, member in members.items():
        if name.endswith(".warc.gz"):
            start = data_start(file, member)
            for offset, size in indexed[name] if name in indexed else walk(file, start, member.size):
                yield start + offset, size


def walk(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) of each gzip member of a stored member, read in bounded pieces."""
    at = 0
    while at < size:
        inflate, done = zlib.decompressobj(31), at
        while not inflate.eof:
            if done >= size:
                raise ValueError("the last record is cut off")
            piece = read_at(file, start + done, min(1 << 16, size - done))
            done += len(piece)
            while piece and not inflate.eof:
                inflate.decompress(piece, 1 << 20)
                piece = inflate.unconsumed_tail
        done -= len(inflate.unused_data)
        yield at, done - at
        at = done


# --- WARC records --------------------------------------------------------------------------------------------------


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` is given."""
    body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if key is None else key}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The record's type, id, what it refers to, its payload's length and digest, and the payload if it holds one. A payload that doesn't fit its digest is an error."""
    end = raw.index(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    body = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    cut = body.index(b"\r\n\r\n")
    http = dict(line.split(": ", 1) for line in body[:cut].decode().split("\r\n")[1:])
    number = lambda text: int(text[len("<urn:page:") : -1]) if text and len(text) > len("<urn:page:>") else None
    said, payload = head["WARC-Payload-Digest"].removeprefix("sha1:"), None
    if head["WARC-Type"] == "response":
        payload = body[cut + 4 :]
        if digest(payload) != said or len(payload) != int(http["Content-Length"]):
            raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't fit its digest")
    return {"page_id": number(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "payload_bytes": int(http["Content-Length"]), "payload_digest": said, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")), "payload": payload}


class ArchiveWriter:
    """Gathers records and writes archives of bounded size into ``folder``."""

    def __init__(self, folder: str, name: str):
        self.files, self.folder = FileSystem.from_uri(folder)
        self.files.create_dir(self.folder, recursive=True)
        self.name, self.number, self.data, self.index = name, 0, io.BytesIO(), []

    def add(self, key: int | None, raw: bytes) -> None:
        squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.index.append(f"page {json.dumps({'id': key, 'filename': DATA.partition('/')[2], 'offset': self.data.tell(), 'length': len(packed)})}\n")
        self.data.write(packed)

    def close(self) -> tuple[str, int, int]:
        """Writes what was gathered; the file's path, its number of records and its bytes of data."""
        size = self.data.tell()
        path, count = f"{self.folder}/{self.name}-{self.number:05d}.zip", len(self.index)
        with self.files.open_output_stream(path) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as packed:
            for member, data in ((DATA, self.data.getbuffer()), (INDEX, "".join(self.index).encode())):
                packed.writestr(zipfile.ZipInfo(member), data)
        self.number, self.data, self.index = self.number + 1, io.BytesIO(), []
        return path, count, size


# --- tables --------------------------------------------------------------------------------------------------------


def first_copies(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(sha, size, first, n): payloads that several rows have, with the smallest id. Rows without an id don't count."""
    html = F.coalesce(pages[html_col], F.lit(""))
    prints = pages.where(pages[id_col].isNotNull()).select(pages[id_col].cast("long").alias("page"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    return prints.groupBy("sha", "size").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("n")).where("first <> last").drop("last")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes one record for each row into archives in ``folder``; (path, records, bytes) of each archive, already written.

    Of equal payloads, that with the smallest id is stored and the others refer to it. A null html is an empty payload, a
    null URL no target, a null id an empty record id and a response of its own. Rows of one id are judged by their own
    payload: equal ones are a response each where theirs is the smallest id. An empty table writes no archive.
    """
    spark = pages.sparkSession
    firsts = stage(spark, first_copies(pages, id_col, html_col), "first-copies", narrow=True)
    html = F.coalesce(pages[html_col], F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page"), pages[url_col].alias("url"), pages[html_col].alias("html"), F.sha1(html.cast("binary")).alias("sha"), F.octet_length(html).alias("size"))
    rows = join_keyed(rows, firsts, ["sha", "size"], "n", "left").select("page", "url", "html", F.when(F.col("page") != F.col("first"), F.col("first")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        writer, done = None, []
        for batch in batches:
            for key, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                writer = writer or ArchiveWriter(folder, f"part-{context.partitionId():06d}-{context.taskAttemptId()}")
                writer.add(key, record(key, url, (html or "").encode(), first))
                if writer.data.tell() >= ARCHIVE_BYTES:
                    done.append(writer.close())
        if writer and writer.index:
            done.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["path", "records", "bytes"])

    return stage(spark, arrow_stream(rows, run, "path string, records long, bytes long"), "manifest")


def read_archives(archives: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, and url, payload) of every record of the archives in column ``path``.

    The directories and indexes are read first, then as many tasks as the records fill ranges read these.
    """
    spark = archives.sparkSession

    def ranges(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files, _ = FileSystem.from_uri(folder)
        for path in batch.column(0).to_pylist():
            with files.open_input_file(path) as file:
                found = list(locate(file, file.size()))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["path", "offset", "length"])

    places = stage(spark, arrow_map(archives.select("path"), ranges, "path string, offset long, length long"), "places", narrow=True)
    size = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-size // RANGE_BYTES))
    block = F.floor(F.col("offset") / RANGE_BYTES)
    # by a given number of partitions: the rows are a few bytes each, what is read for them is not
    dealt = places.withColumn("block", block).repartition(min(tasks, TASKS), "path", "block").sortWithinPartitions("path", "offset")
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"url": pa.string(), "payload": pa.binary()} if with_payload else {})

    def load(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        files, _ = FileSystem.from_uri(folder)
        rows: list[tuple[str, int, int]] = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
        at = 0
        while at < len(rows):
            path, start, _ = rows[at]
            to = at
            while to < len(rows) and rows[to][0] == path and (to == at or rows[to][1] + rows[to][2] - start <= RANGE_BYTES):
                to += 1
            with files.open_input_file(path) as file:
                data = read_at(file, start, rows[to - 1][1] + rows[to - 1][2] - start)
            found = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for _, o, n in rows[at:to]]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in kinds.items()], list(kinds))
            at = to

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return arrow_map(dealt, load, schema)


def round_trip(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """What the archives of ``pages`` hold when read back."""
    folder = folder or scratch(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder, **columns), folder)
