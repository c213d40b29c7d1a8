"""Operator 8, WARC: a dictionary-compressed writer, and its reader.

Archives are ``.warc.zst`` files: a leading skippable frame that holds a
Zstandard dictionary trained on the archive's own first records, then one
frame for each record, so that any record can be decompressed alone with the
dictionary. Writing needs no shuffle of payloads: every task turns its rows
into archives of bounded size in the shared folder, under a name of its own,
and reports them. The reports, committed by Spark, are the manifest; files of
failed or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, frugal, join_checked, number_repeats, read, scratch_path, stored

LEAST_SHARED = 100          #: payload bytes from which equal payloads become revisits
SAMPLE_BYTES = 2 << 20      #: first records of an archive that its dictionary is trained on
DICT_BYTES = 64 << 10       #: size of a dictionary
ARCHIVE_BYTES = 64 << 20    #: uncompressed records in an archive, about
LEVEL = 3
SKIPPABLE = 0x184D2A5D      # fixed value: the skippable frame that holds a dictionary
ZSTD_DICT = 0xEC30A437      # fixed value: a dictionary's magic number
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _one_line(s: str) -> str:
    return s.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _whole(s: str) -> str:
    return s.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit carries no payload; the length and the
    digest of the payload it stands for are in its headers."""
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}:{digest}:{revisit}')}>"),
            ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", _one_line(url)))
    if page is not None:
        head.append(("X-Page-ID", str(page)))
    if revisit:
        head.append(("WARC-Profile", REVISIT))
        if refers is not None:
            head.append(("X-Refers-To-Page-ID", str(refers)))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def dictionary(samples: list[bytes]):
    """A dictionary from records, or None where there are too few to train on."""
    import zstandard

    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=1000, d=8, f=18, accel=5)
    except zstandard.ZstdError:
        return None


def archive(records: Iterator[bytes]) -> Iterator[bytes]:
    """The parts of one archive. Only the sample is held in memory."""
    import zstandard

    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    trained = dictionary(sample)
    if trained is not None:
        trained.precompute_compress(level=LEVEL)
        raw = trained.as_bytes()
        yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    c = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in sample:
        yield c.compress(r)
    for r in records:
        yield c.compress(r)


def unarchive(stream) -> Iterator[bytes]:
    """The records of an archive, read in bounded pieces."""
    import zstandard

    data = stream.read(8)
    trained = None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        raw = stream.read(struct.unpack("<I", data[4:])[0])
        trained, data = zstandard.ZstdCompressionDict(raw), b""
    d = zstandard.ZstdDecompressor(dict_data=trained) if trained else zstandard.ZstdDecompressor()
    while data or (data := stream.read(1 << 20)):
        frame, parts = d.decompressobj(), []
        while not frame.eof:
            if not data and not (data := stream.read(1 << 20)):
                raise EOFError("an archive ends inside a record")
            parts.append(frame.decompress(data))
            data = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _files(folder: str):
    """File system and path of a folder's URI (file, hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
        fs.LocalFileSystem(), folder)


def plan_records(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """Add ``_digest``, ``_n`` (payload bytes), ``_refers`` and ``_revisit``.

    Of equal payloads of at least ``LEAST_SHARED`` bytes the smallest key (null
    last) is the response. Only digests that occur more than once are joined
    back, so payloads stay in their scan partitions. If rows agree in key and
    payload, the first in a numbering of those rows is the response.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    d = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_payload"),
                     F.sha2(body, 256).alias("_digest"), F.octet_length(body).cast("bigint").alias("_n"))
    ids = d.select("_key", "_digest", "_n").filter(F.col("_n") >= LEAST_SHARED)
    shared = stored(ids.groupBy("_digest").agg(F.count(F.lit(1)).alias("_m"), F.min("_key").alias("_first"))
                    .filter("_m > 1").select("_digest", "_first", F.lit(True).alias("_shared")), "warc-shared")
    d = join_checked(d, shared, ["_digest"], "left")
    d = number_repeats(d, ["_key", "_digest"])
    again = F.col("_shared") & ~(F.col("_key").eqNullSafe(F.col("_first")) & (F.col("_rep") == 0))
    return d.withColumn("_revisit", F.coalesce(again, F.lit(False)))


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """Write archives into ``folder``; returns the manifest ``name, records``."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        files.create_dir(root, recursive=True)

        def rows() -> Iterator[bytes]:
            for b in batches:
                for k, u, p, g, f, v in zip(*(b.column(c).to_pylist() for c in
                                              ("_key", "_url", "_payload", "_digest", "_first", "_revisit"))):
                    yield record(k, u, p.encode(), g, f, v)

        source, names, counts = rows(), [], []
        ahead = next(source, None)
        while ahead is not None:
            name, done = f"{uuid.uuid4().hex}.warc.zst", [0, 0]

            def some() -> Iterator[bytes]:
                nonlocal ahead
                while ahead is not None and done[0] < ARCHIVE_BYTES:
                    done[0] += len(ahead)
                    done[1] += 1
                    yield ahead
                    ahead = next(source, None)

            with files.open_output_stream(f"{root}/{name}") as out:
                for part in archive(some()):
                    out.write(part)
            names.append(name)
            counts.append(done[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())],
                                         ["name", "records"])

    cols = ["_key", "_url", "_payload", "_digest", "_first", "_revisit"]
    return stored(planned.select(*cols).mapInArrow(frugal(write), "name string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives a manifest names. Each response's digest and
    length are computed anew from the payload read."""
    fields = [f.strip().split(" ")[0] for f in READ.split(",")]
    schema = pa.schema([(f, pa.int64() if f in ("page_id", "payload_bytes", "refers_to") else pa.string())
                        for f in fields])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(folder)
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays(
            [pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], schema=schema)
        number = lambda s: None if s is None else int(s)
        for b in batches:
            for name in b.column("name").to_pylist():
                with files.open_input_stream(f"{root}/{name}") as stream:
                    for raw in unarchive(stream):
                        h, payload = parse(raw)
                        kind, told = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha256:")
                        n = int(h["X-Payload-Length"])
                        if kind == "response" and (n, told) != (len(payload), hashlib.sha256(payload).hexdigest()):
                            raise ValueError(f"{name}: a payload differs from its digest")
                        url = h.get("WARC-Target-URI")
                        rows.append((number(h.get("X-Page-ID")), n, told, kind, number(h.get("X-Refers-To-Page-ID")),
                                     None if url is None else _whole(url)))
                        if len(rows) >= 4096:
                            yield flush()
                            rows = []
        if rows:
            yield flush()

    # one archive is one unit of work: deal the names out, not the payloads
    n = max(1, manifest.count())
    return manifest.select("name").repartition(min(n, 10_000)).mapInArrow(frugal(load), READ)


def round_trip(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url",
               payload: str = "html") -> DataFrame:
    """Archive ``pages`` in ``folder`` and read the archives back.

    Null payload: an empty one (always a response). Null url: no target header.
    Null key: no page header, read back as null. Empty table: no archives.
    """
    bound_batches(pages.sparkSession)
    manifest = write_archives(plan_records(pages, key, url, payload), folder)
    return read_archives(manifest, folder)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = round_trip(read(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, payload_digest,
             min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""
