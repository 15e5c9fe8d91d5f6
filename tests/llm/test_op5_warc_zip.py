import base64
import hashlib
import io
import zipfile
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerscope.llm import warc_zip
from ledgerscope.llm.common import run_folder
from ledgerscope.llm.warc_zip import (ZipArchiveWriter, archive_ranges, parse_record, read_archives, warc_record,
                                      write_archives, zip_members)

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def pages(spark):
    long = "<p>é</p>" * 20_000
    rows = [(1, "http://a/", "<b>x</b>"), (2, "http://b/ c", "<b>x</b>"), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", long),
            (6, "u", "\r\n\r\nWARC/1.1\r\n"), (7, "u", "same"), (7, "u", "same"), (8, "u", "other"), (None, "u", "<b>x</b>"),
            (None, "u", "alone"), (9, "u", long)]
    return spark.createDataFrame(rows, SCHEMA)


def test_round_trip(spark):
    df = pages(spark)
    got = read_archives(write_archives(df, run_folder(spark, "t")), range_bytes=500).collect()
    want = []
    leaders = {}
    for r in df.collect():
        text = r["html"] or ""
        if r["page_id"] is not None:
            leaders[text] = max(leaders.get(text, 0), r["page_id"])
    for r in df.collect():
        text, lead = r["html"] or "", leaders.get(r["html"] or "")
        revisit = lead is not None and lead != r["page_id"]
        name = "null" if r["page_id"] is None else str(r["page_id"])
        want.append((name, digest(text), len(text.encode()), "revisit" if revisit else "response",
                     str(lead) if revisit else None, None if revisit else text.encode()))
    seen = [(r["record_id"], r["payload_digest"], r["payload_bytes"], r["warc_type"], r["refers_to"],
             None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str)


def test_small_payloads_are_all_responses(spark):
    got = read_archives(write_archives(pages(spark), run_folder(spark, "t"), least_bytes=10)).collect()
    kinds = {r["record_id"]: r["warc_type"] for r in got}
    assert kinds["1"] == kinds["2"] == kinds["3"] == "response" and kinds["5"] == "revisit"


def test_leaders_joined_by_shuffle_give_the_same(spark, monkeypatch):
    rows = lambda: sorted(map(str, read_archives(write_archives(pages(spark), run_folder(spark, "t"))).select(
        "record_id", "warc_type", "refers_to", "payload_digest").collect()))
    first = rows()
    monkeypatch.setattr(warc_zip, "BROADCAST_LEADERS", -1)
    assert rows() == first


def test_several_archives_and_empty_table(spark):
    manifest = write_archives(pages(spark).coalesce(1), run_folder(spark, "t"), zip_bytes=300)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == 12
    assert read_archives(manifest).count() == 12
    none = write_archives(spark.createDataFrame([], SCHEMA), run_folder(spark, "t"))
    assert none.count() == 0 and read_archives(none).count() == 0


def packed(n=5, **how):
    out = io.BytesIO()
    stream = pa.PythonFile(out, "w")
    writer = ZipArchiveWriter(stream)
    records = [warc_record("response", str(i), f"http://x/{i}", digest("p" * i), b"p" * i) for i in range(n)]
    for i, r in enumerate(records):
        writer.add(r, f"http://x/{i}", {"id": i})
    writer.member.close()
    writer.zip.writestr(warc_zip.INDEX, "\n".join(writer.index))
    for name, data, kind in how.get("more", ()):
        writer.zip.writestr(name, data, kind)
    writer.zip.close()
    return out, records


def test_members_lie_where_the_directory_says():
    out, records = packed()
    data = out.getvalue()
    file = pa.BufferReader(data)
    members = zip_members(file)
    with zipfile.ZipFile(out) as z:
        assert sorted(members) == sorted(z.namelist())
        for name, (method, size, at) in members.items():
            assert method == zipfile.ZIP_STORED and data[at:at + size] == z.read(name)
    found = []
    for at, lengths in archive_ranges(file, 100):
        for n in lengths:
            found.append(zlib.decompress(data[at:at + n], 31))
            at += n
    assert found == records


def test_zip64_directory():
    """The end record's and an entry's numbers moved to their ZIP64 forms."""
    import struct
    out, records = packed(3)
    data = out.getvalue()
    end = data.rfind(b"PK\x05\x06")
    *_, count, size, offset, _ = warc_zip._END.unpack_from(data, end)
    entries, at, body = b"", offset, data[:offset]
    for _ in range(count):
        head = list(warc_zip._ENTRY.unpack_from(data, at))
        name, extra, comment = head[10:13]
        label = data[at + 46:at + 46 + name]
        with zipfile.ZipFile(out) as z:
            info = z.getinfo(label.decode())
        wide = struct.pack("<2H3Q", 1, 24, info.file_size, info.compress_size, info.header_offset)
        head[8] = head[9] = head[16] = 0xFFFFFFFF
        head[11], head[12] = len(wide), 0
        entries += warc_zip._ENTRY.pack(*head) + label + wide
        at += 46 + name + extra + comment
    end64 = len(body) + len(entries)
    tail = (warc_zip._END64.pack(b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(entries), len(body))
            + warc_zip._END64_AT.pack(b"PK\x06\x07", 0, end64, 1)
            + warc_zip._END.pack(b"PK\x05\x06", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))
    big = body + entries + tail
    assert zip_members(pa.BufferReader(big)) == zip_members(pa.BufferReader(data))
    with zipfile.ZipFile(io.BytesIO(big)) as z:
        assert z.testzip() is None


def test_compressed_archives_and_damage_are_refused():
    out, _ = packed(2, more=[("archive/more.warc.gz", b"x" * 99, zipfile.ZIP_DEFLATED)])
    with pytest.raises(ValueError):
        list(archive_ranges(pa.BufferReader(out.getvalue())))
    with pytest.raises(ValueError):
        zip_members(pa.BufferReader(b"no archive at all"))
    record = warc_record("response", "1", "u", digest("abc"), b"abd")
    with pytest.raises(ValueError):
        parse_record(record)


def test_extra_columns_and_query(spark):
    from ledgerscope.llm.queries import queries
    df = pages(spark).withColumn("payload", F.lit("own")).withColumn("leader", F.lit(1)).withColumn("sha", F.lit("x"))
    assert write_archives(df, run_folder(spark, "t")).agg(F.sum("records")).first()[0] == 12
    got = queries()["op5_warc_zip"](spark, "/root/testdata/sf0.001").collect()
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert {(r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got} == {
        (r["page_id"], digest(r["html"]), len(r["html"].encode())) for r in rows}
