"""WARC records in ZIP packages, written by tasks and read by byte range.

A package is a ZIP archive of stored (not compressed) members, so the bytes of a
member are bytes of the archive: ``archive/data.warc.gz`` holds gzip-compressed
WARC records one after the other, ``indexes/index.jsonl`` the place of each.  A
reader parses the end record and the central directory (ZIP64 too), reads the
index, and then fetches runs of records by byte range; nothing is extracted.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import partial
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import Workspace, salted_lookup, ship, utf8

#: equal payloads of fewer bytes are stored each time
MIN_REVISIT_BYTES = 100
#: a package is closed once its records take this many bytes
PACKAGE_BYTES = 128 << 20
#: bytes of records that one range request asks for, about
SPAN_BYTES = 4 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
DATE = datetime(2000, 1, 1, tzinfo=timezone.utc)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:turnweave:page:"


# -- records ---------------------------------------------------------------------------------------


def _page(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def _page_id(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(_ID)
    return int(tail) if tail else None


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload but not the payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_page(page_id)}",
        f"WARC-Date: {DATE:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # a header is one line; anything else in a url is percent-encoded
        safe = "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
        lines.insert(3, f"WARC-Target-URI: {safe}")
    if revisit:
        lines += [f"WARC-Refers-To: {_page(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and body of one record."""

    def fields(head: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, fields(http), body


# -- packages --------------------------------------------------------------------------------------


class Package:
    """Writes one package: records first, then their index."""

    def __init__(self, target: str):
        system, path = fs.FileSystem.from_uri(target)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.target = target
        self.file = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.file, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.index: list[tuple[int, int]] = []
        self.size = 0

    def add(self, raw: bytes, level: int) -> None:
        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
        packed = squeeze.compress(raw) + squeeze.flush()
        self.data.write(packed)
        self.index.append((self.size, len(packed)))
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        lines = io.BytesIO(b"".join(json.dumps({"offset": a, "length": n}).encode() + b"\n" for a, n in self.index))
        with self.zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as member:
            member.write(lines.getbuffer())
        self.zip.close()
        self.file.close()
        return self.target, len(self.index), self.size


def _write(folder: str, package_bytes: int, level: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packages of one task. Names are new for each attempt; only what a finished task lists counts."""
    done: list[tuple[str, int, int]] = []
    package = None
    for batch in batches:
        for row in zip(*(batch.column(i) for i in range(5)), strict=True):
            page_id, url, payload, digest, refers_to = (value.as_py() for value in row)
            package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
            package.add(record(page_id, url, payload, digest, refers_to), level)
            if package.size >= package_bytes:
                done.append(package.close())
                package = None
    if package:
        done.append(package.close())
    columns = list(zip(*done, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
        names=["path", "records", "bytes"],
    )


class Member(NamedTuple):
    name: str
    method: int
    size: int
    header: int  # place of the local header


def _directory_place(file, size: int) -> tuple[int, int, int]:
    """Place, length and entries of the central directory, from the end record or its ZIP64 form."""
    tail_size = min(size, 22 + 65_535 + 20)
    file.seek(size - tail_size)
    tail = file.read(tail_size)
    at = len(tail) - 22
    while at >= 0:
        at = tail.rfind(b"PK\x05\x06", 0, at + 4)
        if at < 0 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
            break
        at -= 1
    if at < 0:
        raise ValueError("no end record: not a ZIP archive")
    entries, length, place = struct.unpack_from("<10xHII", tail, at)
    if 0xFFFF in (entries,) or 0xFFFFFFFF in (length, place):
        if at < 20 or tail[at - 20 : at - 16] != b"PK\x06\x07":
            raise ValueError("the ZIP64 locator is missing")
        file.seek(struct.unpack_from("<8xQ", tail, at - 20)[0])
        end = file.read(56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record is missing")
        entries, length, place = struct.unpack_from("<32xQQQ", end)
    return place, length, entries


def read_directory(file, size: int) -> list[Member]:
    """Members by the central directory of an open archive of ``size`` bytes."""
    place, length, entries = _directory_place(file, size)
    file.seek(place)
    raw = file.read(length)
    members, at = [], 0
    for _ in range(entries):
        if raw[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        method, packed, whole, n_name, n_extra, n_note, header = struct.unpack_from("<10xH8xIIHHH8xI", raw, at)
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        # 64-bit fields stand in the extra field for those that are all ones, in this order
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<HH", extra)
            if kind == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            extra = extra[4 + n :]
        members.append(Member(name, method, packed, header))
        at += 46 + n_name + n_extra + n_note
    return members


def member_place(file, member: Member) -> int:
    """Where the bytes of a stored member begin."""
    if member.method != 0:
        raise ValueError(f"{member.name} is compressed: it cannot be read by range")
    file.seek(member.header)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("the local header is missing")
    n_name, n_extra = struct.unpack_from("<26xHH", head)
    return member.header + 30 + n_name + n_extra


def _spans(span_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, place, lengths): runs of neighbouring records of each package, by its index."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as file:
                members = {m.name: m for m in read_directory(file, file.size())}
                base = member_place(file, members[DATA])
                file.seek(member_place(file, members[INDEX]))
                lines = file.read(members[INDEX].size).splitlines()
            places, runs, held = [], [], 0
            for line in lines:
                entry = json.loads(line)
                if not runs or held + entry["length"] > span_bytes:
                    places.append(base + entry["offset"])
                    runs.append([])
                    held = 0
                runs[-1].append(entry["length"])
                held += entry["length"]
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * len(runs), pa.string()), pa.array(places, pa.int64()), pa.array(runs, pa.list_(pa.int64()))],
                names=["path", "place", "lengths"],
            )


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
     ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each span, one range request per span."""
    for batch in batches:
        for path, place, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            system, name = fs.FileSystem.from_uri(path)
            with system.open_input_file(name) as file:
                file.seek(place)
                held = file.read(sum(lengths))
            rows, at = [], 0
            for n in lengths:
                warc, http, body = parse_record(zlib.decompress(held[at : at + n], 31))
                at += n
                rows.append(
                    {
                        "page_id": _page_id(warc["warc-record-id"]),
                        "url": warc.get("warc-target-uri"),
                        "record_type": warc["warc-type"],
                        "payload_digest": warc["warc-payload-digest"].removeprefix("sha256:"),
                        "payload_bytes": int(http["content-length"]),
                        "refers_to": _page_id(warc.get("warc-refers-to")),
                        "payload": body if warc["warc-type"] == "response" else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, _RECORD)


# -- on tables -------------------------------------------------------------------------------------


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to.

    Of pages with an equal payload of at least ``min_bytes`` those with the
    smallest page_id are stored (several only if rows repeat that id) and the
    others refer to it; pages without page_id come last.
    """
    raw = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", utf8("html").alias("payload"))
    raw = raw.withColumn("digest", F.sha2("payload", 256))
    large = F.octet_length("payload") >= min_bytes
    groups = raw.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    found = salted_lookup(raw, groups.select("digest", "first"), ["digest"], F.coalesce("page_id", F.xxhash64("url")))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return found.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_packages(planned: DataFrame, package_bytes: int = PACKAGE_BYTES, level: int = 4) -> DataFrame:
    """path, records, bytes of the packages written below the shared folder.

    The list is itself a written table: a task that ran twice leaves a package
    that nobody lists.
    """
    ship(planned.sparkSession)
    space = Workspace(planned.sparkSession)
    written = planned.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(
        partial(_write, f"{space.folder}/packages", package_bytes, level), "path string, records bigint, bytes bigint"
    )
    return space.save("list", written)


def read_packages(listed: DataFrame, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload of all records.

    ``listed`` has one ``path`` per package.  Packages are indexed in parallel,
    then spans of records are dealt over all tasks.  Size and digest are those of
    the full payload, also for revisits, whose payload is null.
    """
    spark = listed.sparkSession
    ship(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spans = listed.select("path").repartition(width, "path").mapInArrow(
        partial(_spans, span_bytes), "path string, place bigint, lengths array<bigint>"
    )
    schema = "page_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary"
    return spans.repartition(width, "path", "place").mapInArrow(_fetch, schema)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """What is read back after ``pages`` (page_id, url, html) have been written.

    Null html is an empty payload; a null url is left out; a null page_id is an
    empty record id.  Repeated rows give repeated records.  An empty table writes
    no package and reads no record.  Other columns are not stored.
    """
    return read_packages(write_packages(plan_revisits(pages), **options))
