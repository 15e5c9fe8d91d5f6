"""WARC archives packed in ZIP files.

The writer packs each task's records into ZIP files of stored members: one
``archive/data.warc.gz`` (a gzip member a record) and ``indexes/index.cdxj``.
The reader parses the ZIP's end record, its ZIP64 form and the central directory,
takes the stored archive and index members, and reads records by byte range
from inside the ZIP; nothing is extracted.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the
largest id is a ``response``; the others are ``revisit`` records that refer to
it and hold the HTTP head alone.

Defined results: a null payload is empty; null ids never lead a group with other
ids, and are written as null; rows that repeat the leading id are all responses;
a null URL is an empty URI; an empty table gives no archives and an empty
result; other columns are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.llm.common import durable, file_system, qualified, run_folder

DATE = "2024-01-01T00:00:00Z"
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Bytes of an archive after which a task starts another ZIP file.
ZIP_BYTES = 1 << 30
#: Bytes of records that a reading task asks for at a time.
RANGE_BYTES = 4 << 20
#: Leaders of repeated payloads that are broadcast (some 64 bytes each); more are joined by shuffle.
BROADCAST_LEADERS = 500_000
LEVEL = 4

MANIFEST = "path string, records long"
RECORD = ("warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
          "payload_bytes long, payload binary")

_END = struct.Struct("<4s4H2LH")
_END64_AT = struct.Struct("<4sLQL")
_END64 = struct.Struct("<4sQ2H2L4Q")
_ENTRY = struct.Struct("<4s6H3L5H2L")
_LOCAL = struct.Struct("<4s5H3L2H")


# ---- WARC records -------------------------------------------------------------------------------

def warc_record(kind: str, record: str, uri: str, digest: str, payload: bytes, refers: str | None = None) -> bytes:
    """One record as bytes: WARC head, HTTP head and, for a response, the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{record}>", f"WARC-Target-URI: {uri}",
            f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of ``RECORD``; checks lengths and, for a response, the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (
            len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    name = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
    return {"warc_type": fields["WARC-Type"], "record_id": name(fields["WARC-Record-ID"]),
            "target_uri": fields["WARC-Target-URI"], "refers_to": name(fields.get("WARC-Refers-To")),
            "payload_digest": digest, "payload_bytes": length,
            "payload": payload if fields["WARC-Type"] == "response" else None}


def gzipped(data: bytes) -> bytes:
    tool = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return tool.compress(data) + tool.flush()


# ---- ZIP files -----------------------------------------------------------------------------------

class ZipArchiveWriter:
    """Streams records into one ZIP file; the index is held until the end."""

    def __init__(self, stream):
        self.stream = stream
        self.zip = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.index = 0, []

    def add(self, record: bytes, uri: str, about: dict) -> None:
        data = gzipped(record)
        self.member.write(data)
        self.index.append(f"{uri.replace(' ', '%20')} {DATE} "
                          + json.dumps(about | {"offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "\n".join(self.index))
        self.zip.close()
        self.stream.close()


def zip_members(file) -> dict[str, tuple[int, int, int]]:
    """Name -> (method, size, position of its bytes) from the central directory of a ZIP or ZIP64 file."""
    end = file.size()
    tail_at = max(0, end - 65557)
    file.seek(tail_at)
    tail = file.read(end - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("not a ZIP file")
    *_, count, size, offset, _ = _END.unpack_from(tail, at)
    if at >= 20 and tail[at - 20:at - 16] == b"PK\x06\x07":
        _, _, where, _ = _END64_AT.unpack_from(tail, at - 20)
        file.seek(where)
        *_, count, size, offset = _END64.unpack(file.read(_END64.size))
    file.seek(offset)
    directory, found, at = file.read(size), {}, 0
    for _ in range(count):
        (magic, _, _, _, method, _, _, _, packed, plain, name, extra, comment, _, _, _, local) = _ENTRY.unpack_from(
            directory, at)
        if magic != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        label = directory[at + _ENTRY.size:at + _ENTRY.size + name].decode()
        more = directory[at + _ENTRY.size + name:at + _ENTRY.size + name + extra]
        while len(more) >= 4:
            kind, length = struct.unpack_from("<2H", more)
            if kind == 1:  # ZIP64: the values that did not fit, in this order
                wide = list(struct.unpack_from(f"<{length // 8}Q", more, 4))
                plain = wide.pop(0) if plain == 0xFFFFFFFF else plain
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                local = wide.pop(0) if local == 0xFFFFFFFF else local
            more = more[4 + length:]
        found[label] = (method, packed, local)
        at += _ENTRY.size + name + extra + comment
    out = {}
    for label, (method, size, local) in found.items():
        file.seek(local)
        *_, name, extra = _LOCAL.unpack(file.read(_LOCAL.size))
        out[label] = (method, size, local + _LOCAL.size + name + extra)
    return out


def archive_ranges(file, range_bytes: int = RANGE_BYTES) -> Iterator[tuple[int, list[int]]]:
    """``(position, lengths)`` of runs of neighbouring records, from the indexes of a ZIP file.

    Members must be stored: a compressed member can't be read by range.
    """
    members = zip_members(file)
    for label, (method, _, at) in sorted(members.items()):
        if not label.startswith("archive/") or not label.endswith(".warc.gz"):
            continue
        index = members.get(INDEX if label == ARCHIVE else label.replace("archive/", "indexes/") + ".cdxj")
        if method or index is None or index[0]:
            raise ValueError(f"{label}: archive or index is missing or not stored")
        file.seek(index[2])
        text = file.read(index[1]).decode()
        spots = [(x["offset"], x["length"]) for x in (json.loads(y.split(" ", 2)[2]) for y in text.split("\n") if y)]
        start, lengths = 0, []
        for offset, length in sorted(spots):
            if lengths and (offset != start + sum(lengths) or sum(lengths) + length > range_bytes):
                yield at + start, lengths
                lengths = []
            if not lengths:
                start = offset
            lengths.append(length)
        if lengths:
            yield at + start, lengths


# ---- Spark jobs ----------------------------------------------------------------------------------

def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
                   least_bytes: int = 0, zip_bytes: int = ZIP_BYTES) -> DataFrame:
    """Write a record a row; the manifest of ZIP files.

    Payloads stay where they were read: only digests are grouped, and the
    leaders of payloads that occur twice are broadcast where their counted
    number allows, else joined (AQE splits a payload that many rows share).
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    leaders = durable(rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha").agg(
        F.max("page").alias("leader"), F.count("*").alias("n")).where("n > 1").select("sha", "leader"), "leaders")
    few = leaders.count() <= BROADCAST_LEADERS
    led = rows.join(F.broadcast(leaders) if few else leaders, "sha", "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, done = None, "", []

        def close() -> None:
            writer.close()
            done.append((f"{folder}/{name}", len(writer.index)))

        for batch in batches:
            columns = (batch.column(c) for c in ("page", "url", "payload", "sha", "leader"))
            for page, uri, body, sha, leader in zip(*columns):
                page, leader, uri, body = page.as_py(), leader.as_py(), uri.as_py(), body.as_py()
                if writer is None:
                    files, top = file_system(folder)
                    files.create_dir(top, recursive=True)
                    name = f"{uuid.uuid4().hex}.wacz"
                    writer = ZipArchiveWriter(files.open_output_stream(f"{top}/{name}"))
                digest = base64.b32encode(sha.as_py()).decode()
                kind = "revisit" if leader is not None and leader != page else "response"
                uri = uri.replace("\r", "%0D").replace("\n", "%0A")
                record = warc_record(kind, "null" if page is None else str(page), uri, digest, body, leader)
                writer.add(record, uri, {"id": page, "type": kind, "digest": f"sha1:{digest}"})
                if writer.at >= zip_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        if done:
            path, n = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(n, pa.int64())], names=["path", "records"])

    return durable(led.mapInArrow(write, MANIFEST), "archives")


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of the manifest's ZIP files, read by byte range (columns of ``RECORD``)."""
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                files, path = file_system(uri)
                with files.open_input_file(path) as f:
                    for at, lengths in archive_ranges(f, range_bytes):
                        yield pa.RecordBatch.from_pydict(
                            {"path": [uri], "at": [at], "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                files, path = file_system(row["path"])
                with files.open_input_file(path) as f:
                    f.seek(row["at"])
                    data, at, found = f.read(sum(row["lengths"])), 0, []
                for length in row["lengths"]:
                    found.append(parse_record(zlib.decompress(data[at:at + length], 31)))
                    at += length
                yield pa.RecordBatch.from_pylist(found, _RECORD_SCHEMA)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = manifest.select("path").repartition(parts, "path").mapInArrow(
        locate, "path string, at long, lengths array<long>")
    return ranges.repartition(parts, "path", "at").mapInArrow(read, RECORD)


_RECORD_SCHEMA = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("refers_to", pa.string()), ("payload_digest", pa.string()),
                            ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    records = read_archives(write_archives(pages, run_folder(spark, "warc")))
    return records.select(F.expr("try_cast(record_id AS BIGINT)").alias("page_id"), "payload_bytes",
                          "payload_digest", F.col("warc_type").alias("record_type"),
                          F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))
