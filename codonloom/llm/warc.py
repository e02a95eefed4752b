"""WARC archives compressed record by record with a shared Zstandard dictionary.

Each archive starts with a skippable frame that holds the dictionary; every
record follows as a frame of its own. Records of equal payloads are revisits of
one response. Archives are written by the executors into the shared folder and
read back with Spark's binary file source.

Defined results: null html is an empty payload; a null url is an empty target;
rows that repeat the largest page_id of their payload are all responses; a null
page_id counts as the smallest; an empty table gives no archive and no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, slices, small_side, staged, table, tidy

DICT_FRAME = 0x184D2A5D
DICT_BYTES, SAMPLES, SAMPLE_BYTES, ARCHIVE_BYTES = 32 << 10, 256, 8 << 10, 8 << 20

ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC/1.1 record whose block is an HTTP head, and the payload unless it is a revisit."""
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple:
    """A row of ROWS from a record; a response's digest and length are taken from its payload and must agree with the head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda field: int(n) if (n := fields[field][len("<urn:page:") : -1]) else None
    if fields["WARC-Type"] == "revisit":
        return number("WARC-Record-ID"), length, digest, "revisit", number("WARC-Refers-To")
    if len(payload) != length or digest_of(payload) != digest:
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    return number("WARC-Record-ID"), length, digest, "response", None


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha1 and best: the page that is the response for this page's payload (its own for small payloads).

    Roles are settled on ids and digests; only revisits are joined back, so the payloads stay where they are read.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload.cast("binary")).alias("sha1"))
    named = hashed.filter(F.octet_length(payload) >= least_bytes).select("page_id", "sha1")
    most = named.groupBy("sha1").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = named.join(most, "sha1").filter(~F.col("page_id").eqNullSafe(F.col("best"))).select(F.col("page_id").alias("_page"), F.col("sha1").alias("_sha1"), "best").distinct()
    again = small_side(staged(again, "revisits")).withColumn("_again", F.lit(True))
    met = hashed.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha1") == F.col("_sha1")) & (F.octet_length(payload) >= least_bytes), "left")
    return met.select("page_id", "url", "html", "sha1", F.when(F.col("_again"), F.col("best")).otherwise(F.col("page_id")).alias("best"))


def train(pages: DataFrame, size: int = DICT_BYTES, samples: int = SAMPLES, sample_bytes: int = SAMPLE_BYTES) -> bytes:
    """A dictionary from at most `samples` records of at most `sample_bytes` each, chosen by a hash of the page."""
    count = pages.count()
    if not count:
        return b""
    hashed = F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < min(1 << 20, int(2 * samples * (1 << 20) / count) + 1)
    rows = pages.select("page_id", "url", F.substring("html", 1, sample_bytes).alias("html")).filter(hashed).limit(samples).collect()
    drawn = [record(r["page_id"], r["url"], (p := (r["html"] or "").encode("utf-8", "surrogatepass")), digest_of(p), None, False) for r in rows]
    try:
        return zstandard.train_dictionary(size, drawn, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few records to learn from
        return b"".join(drawn)[-size:]


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if re.match(r"file:/[^/]", path):
        path = path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write(pages_with_roles: DataFrame, path: str, dictionary: bytes, level: int = 3, most_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes archives of about most_bytes below path; returns (archive, records).

    A name holds its task attempt, and only attempts that end are in the result,
    so what a lost or repeated attempt left is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=zdict)
        lead = DICT_FRAME.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
        part, held, size = 0, [lead], 0

        def flush() -> pa.RecordBatch:
            nonlocal part, held, size
            name = f"part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(b"".join(held))
            row = pa.RecordBatch.from_pydict({"archive": pa.array([name], pa.string()), "records": pa.array([len(held) - 1], pa.int64())})
            part, held, size = part + 1, [lead], 0
            return row

        for batch in slices(batches, "html"):
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "best")]
            for page_id, url, html, sha1, best in zip(*cols):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                held.append(packer.compress(record(page_id, url, payload, digest, best, page_id != best)))
                size += len(held[-1])
                if size >= most_bytes:
                    yield flush()
        if size:
            yield flush()

    return pages_with_roles.select("page_id", "url", "html", "sha1", "best").mapInArrow(tidy(run), "archive string, records long")


def records_of(content: bytes) -> Iterator[bytes]:
    """The records of one archive, whose first frame must be its dictionary."""
    raw = memoryview(content)
    if int.from_bytes(raw[:4], "little") != DICT_FRAME:
        raise ValueError("an archive must start with its dictionary")
    at = 8 + int.from_bytes(raw[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(raw[8:at])) if at > 8 else None)
    while at < len(raw):
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            if at >= len(raw):
                raise ValueError("an archive ends inside a record")
            piece = raw[at : at + (64 << 10)]
            out.append(frame.decompress(piece))
            at += len(piece)
        at -= len(frame.unused_data)
        yield b"".join(out)


def read(manifest: DataFrame, path: str) -> DataFrame:
    """Rows of ROWS from the manifest's archives below path; each archive is one bounded file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(path)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{root}/{name}") as f:
                    rows = [parse(r) for r in records_of(f.read())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROWS)], schema=_ROWS)

    spread = manifest.sparkSession.sparkContext.defaultParallelism * 4
    return manifest.select("archive").repartition(spread).mapInArrow(tidy(run), ROWS)


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Writes the archives and returns their manifest, a table in the shared folder."""
    return staged(write(roles(pages, least_bytes), path, train(pages)), "manifest")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    return read(archive(table(spark, sf_dir, "pages"), path), path)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
b AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS best, unhex(sha1(html)) AS d FROM p),
bits AS (
  SELECT *, list_transform(range(32), lambda i: CAST(('0x' || substr(hex(d), 1 + CAST(floor(i * 5 / 4) AS INT), 2) ) AS INT)) AS h,
  list_transform(range(32), lambda i: 8 - 5 - (i * 5) % 4) AS s FROM b)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(1, 33), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((h[i] >> s[i]) & 31 AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM bits
"""
