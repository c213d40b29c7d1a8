"""WARC: the format, the round trip, revisits."""

import hashlib
import io
import os
import struct

import duckdb
import zstandard
from conftest import SMALL
from lexframe.llm import warc
from lexframe.session import scratch_path


def row(r):
    return r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]


def test_archive_format():
    records = [warc.record(i, f"http://x/{i}", f"<p>page {i} {'words ' * 50}</p>".encode(), "d", None, False)
               for i in range(200)]
    data = b"".join(warc.archive(iter(records)))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and struct.unpack("<I", data[8:12])[0] == warc.ZSTD_DICT
    assert list(warc.unarchive(io.BytesIO(data))) == records
    # every record is a frame of its own: the last one decompresses alone
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8: 8 + size]))
    last = data.rindex(b"\x28\xb5\x2f\xfd")
    assert d.decompress(data[last:]) == records[-1]
    few = b"".join(warc.archive(iter(records[:2])))
    assert list(warc.unarchive(io.BytesIO(few))) == records[:2]


def test_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SMALL}/pages.parquet'")
    assert sorted(map(row, warc.op8_warc(spark, SMALL).collect())) == sorted(con.execute(warc.OP8_SQL).fetchall())


def test_revisits_and_awkward_rows(spark):
    long, short = "<p>é " + "x" * 200, "tiny"
    rows = [(5, "u", long), (3, "u\r\nX-Page-ID: 9", long), (9, None, long), (1, "u", short), (2, "u", short),
            (4, "%0A", None), (6, "", ""), (7, "u", "y" * 300), (7, "u", "y" * 300), (None, "u", long),
            (None, "u", "z" * 150), (None, "v", "z" * 150)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = scratch_path(spark, "warc")
    out = warc.round_trip(d, folder).collect()
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    got = sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out), key=repr)
    want = [(5, sha(long), "revisit", 3), (3, sha(long), "response", None), (9, sha(long), "revisit", 3),
            (1, sha(short), "response", None), (2, sha(short), "response", None), (4, sha(""), "response", None),
            (6, sha(""), "response", None), (7, sha("y" * 300), "response", None), (7, sha("y" * 300), "revisit", 7),
            (None, sha(long), "revisit", 3), (None, sha("z" * 150), "response", None),
            (None, sha("z" * 150), "revisit", None)]
    assert got == sorted(want, key=repr)
    assert sorted((r["url"] for r in out), key=repr) == sorted((r[1] for r in rows), key=repr)
    assert all(f.endswith(".warc.zst") for f in os.listdir(folder))
    assert warc.round_trip(d.limit(0), scratch_path(spark, "warc")).count() == 0
