"""Web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each of whole WARC records of about ``FRAME_BYTES``, and a
seek table at its end in a skippable frame (the public "seekable format": compressed and decompressed
size of each frame, their number, a descriptor, a magic number). Any Zstandard tool can unpack it, and
a reader can start at any frame. The index maps each record identifier to bundle, frame and the offset in the unpacked
frame, so that fetching a record unpacks one frame.

Each task writes bundles of its own into the shared folder, under names that no other attempt uses; the
index, written with them, names those of the attempts that succeeded. Tasks that are run again after
a lost executor leave stray files, never wrong records. Frames are read back by tasks that hold no
more than one frame.

A record with a payload of at least ``MIN_REVISIT`` bytes that equals another's is written as a revisit of the record with the
largest key; its block keeps the HTTP headers with the full payload's length, its header the digest.

Pages are written from the scan; only those that may be revisits or repetitions, by a filter of fixed size, are shuffled.

Defined results: null html is an empty payload, null urls are named by the key. Rows that repeat a key and a payload are
records of their own, with identifiers of their own, of one type: those of the largest key are responses. A null key is never the largest of
several; alone it is a response. Empty tables give no bundle. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bitmap, seen, shared_dir, table, written

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 128 << 20
MIN_REVISIT = 1000
LEVEL = 3
#: The tables hold no time of capture; the records need one.
CAPTURED = "1970-01-01T00:00:00Z"

_SKIPPABLE, _SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = "record_id string, page_id bigint, record_type string, bundle string, frame int, offset bigint, length bigint"


# Records ----------------------------------------------------------------------------------------


def record_id(key: int | None, digest: str, again: str | None = None) -> str:
    """again: what tells further records of the key and the payload from the first."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{key}:{digest}' + (f':{again}' if again else ''))}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, again: str | None = None) -> bytes:
    """One WARC record; digest: the payload's SHA-1 in hex; refers_to: the response's key for a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, digest, again)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~') if url else f'urn:page:{key}'}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if key is not None:
        lines.append(f"X-Page-ID: {key}")
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(data: bytes, at: int) -> tuple[dict[str, str], int]:
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, end + 4


def parse(frame: bytes) -> Iterator[tuple[int, int, dict]]:
    """(offset, length, fields) of each record of an unpacked frame. A response whose payload doesn't have its digest is an error."""
    at = 0
    while at < len(frame):
        if not frame.startswith(b"WARC/", at):
            raise ValueError(f"no record at offset {at}")
        head, body = _headers(frame, at)
        end = body + int(head["content-length"])
        http, first = _headers(frame, body)
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        kind = head["warc-type"]
        payload = frame[first:end]
        size = int(http["content-length"])
        if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"damaged payload in {head['warc-record-id']}")
        yield at, end + 4 - at, {
            "record_id": head["warc-record-id"],
            "page_id": int(head["x-page-id"]) if "x-page-id" in head else None,
            "url": head["warc-target-uri"],
            "record_type": kind,
            "payload_bytes": size,
            "payload_digest": digest,
            "refers_to": int(head["x-refers-to-page-id"]) if "x-refers-to-page-id" in head else None,
            "payload": payload if kind == "response" else None,
        }
        at = end + 4


# Bundles ----------------------------------------------------------------------------------------


class BundleWriter:
    """Frames of records, and the seek table at the end."""

    def __init__(self, out) -> None:
        self.out, self.sizes, self.written = out, [], 0
        self.compressor = zstd.ZstdCompressor(level=LEVEL, write_checksum=True)

    def frame(self, data: bytes) -> int:
        packed = self.compressor.compress(data)
        self.out.write(packed)
        self.sizes.append((len(packed), len(data)))
        self.written += len(packed)
        return len(self.sizes) - 1

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = struct.pack("<IBI", len(self.sizes), 0, _SEEKABLE)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found with its seek table."""

    def __init__(self, source) -> None:
        self.source = source
        n = source.size()
        source.seek(n - 9)
        count, descriptor, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        width = 12 if descriptor & 0x80 else 8
        source.seek(n - 9 - width * count)
        table_bytes = source.read(width * count)
        self.sizes = [struct.unpack_from("<II", table_bytes, i * width) for i in range(count)]
        self.offsets = [0]
        for packed, _ in self.sizes:
            self.offsets.append(self.offsets[-1] + packed)

    def frame(self, number: int) -> bytes:
        self.source.seek(self.offsets[number])
        packed, size = self.sizes[number]
        return zstd.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=max(size, 1))


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


#: Rows of a key and a payload that one task numbers.
REPEATS = 1000


def marked(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """pages (key, url, html) with digest, refers_to (null for responses) and again (null for the first record of a key and a payload)."""
    known = pages.select(F.col(key).alias("page_id"), "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("digest"))
    slotted = known.withColumn("_slot", F.xxhash64("page_id", "digest"))
    rows = written(slotted.select("page_id", "digest", "_slot", (F.octet_length("html") >= MIN_REVISIT).alias("large")), "digests")
    # Counted before any join: a payload shared by many rows is one row from here on.
    first = rows.filter("large").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("_n")).filter((F.col("_n") > 1) & F.col("refers_to").isNotNull()).drop("_n")
    each = rows.groupBy("page_id", "digest", "_slot").agg(F.count("*").alias("_n"), F.max("large").alias("large"))
    revisits = each.filter("large").join(first, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to", "_slot")
    doubtful = pages.sparkSession.sparkContext.broadcast(bitmap(revisits.select(F.col("_slot").alias("h")).unionByName(each.filter("_n > 1").select(F.col("_slot").alias("h")))))

    def some(doubted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(seen(doubtful.value, batch.column("_slot").to_numpy()) == doubted))

        return run

    sure = slotted.mapInArrow(some(False), slotted.schema).select("page_id", "url", "html", "digest", F.lit(None).cast("bigint").alias("refers_to"), F.lit(None).cast("string").alias("again"))
    # Equal rows are one with a number, told apart again after the join.
    counted = slotted.mapInArrow(some(True), slotted.schema).groupBy("page_id", "url", "digest").agg(F.first("html").alias("html"), F.count("*").alias("_n"))
    least = counted.groupBy("page_id", "digest").agg(F.min(F.struct("url")).alias("_least"))
    named = counted.alias("c").join(least.alias("l"), F.col("c.page_id").eqNullSafe(F.col("l.page_id")) & (F.col("c.digest") == F.col("l.digest"))).select("c.*", F.struct("c.url").eqNullSafe(F.col("_least")).alias("_first"))
    joined = named.alias("c").join(revisits.alias("r"), F.col("c.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("c.digest") == F.col("r.digest")), "left").select("c.*", "refers_to")
    some_each = joined.withColumn("_from", F.explode(F.expr(f"sequence(0L, _n - 1, {REPEATS}L)")))
    dealt = some_each.filter(f"_n <= {REPEATS}").unionByName(some_each.filter(f"_n > {REPEATS}").repartition("_from", "page_id"))
    told = dealt.withColumn("_i", F.explode(F.expr(f"sequence(_from, least(_from + {REPEATS - 1}, _n - 1))")))
    again = F.when(~F.col("_first") | (F.col("_i") > 0), F.concat_ws(":", F.col("_i").cast("string"), F.coalesce("url", F.lit(""))))
    return sure.unionByName(told.select("page_id", "url", "html", "digest", "refers_to", again.alias("again")))


def write_bundles(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html, digest, refers_to, again) as bundles under folder; the index, as a table in the shared folder."""
    names = [x.partition(" ")[0] for x in INDEX.split(", ")]
    kinds = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        writer = name = None
        held: list[bytes] = []
        size = 0
        rows: list[tuple] = []
        index: list[tuple] = []

        def flush() -> None:
            nonlocal writer, name, size
            if not held:
                return
            if writer is None:
                name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                files.create_dir(root, recursive=True)
                writer = BundleWriter(files.open_output_stream(f"{root}/{name}", compression=None))
            number = writer.frame(b"".join(held))
            index.extend((*r[:3], f"{folder}/{name}", number, *r[3:]) for r in rows)
            held.clear()
            rows.clear()
            size = 0
            if writer.written >= BUNDLE_BYTES:
                writer.close()
                writer = None

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds.types, strict=True)], names)
            index.clear()
            return out

        for batch in batches:
            for key, url, html, digest, refers, again in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to", "again")), strict=True):
                key, digest, refers, again = key.as_py(), digest.as_py(), refers.as_py(), again.as_py()
                data = record(key, url.as_py(), (html.as_py() or "").encode(), digest, refers, again)
                if size and size + len(data) > FRAME_BYTES:
                    flush()
                rows.append((record_id(key, digest, again), key, "response" if refers is None else "revisit", size, len(data)))
                held.append(data)
                size += len(data)
            if len(index) > 10_000:
                yield taken()
        flush()
        if writer is not None:
            writer.close()
        if index:
            yield taken()

    return written(pages.mapInArrow(run, INDEX), "warc-index")


def read_bundles(index: DataFrame, payloads: bool = False) -> DataFrame:
    """The records that the index names, read from their frames: fields of ``parse`` without the payload, or with it."""
    frames = index.groupBy("bundle", "frame").agg(F.collect_list("offset").alias("offsets"))
    fields = [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = "record_id string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint" + ", payload binary" * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != name:
                    name = row["bundle"]
                    files, path = _open(name)
                    reader = BundleReader(files.open_input_file(path))
                wanted = set(row["offsets"])
                found = [fields_ for offset, _, fields_ in parse(reader.frame(row["frame"])) if offset in wanted]
                if len(found) != len(wanted):
                    raise ValueError(f"records missing in frame {row['frame']} of {name}")
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in fields], [n for n, _ in fields])

    return frames.mapInArrow(run, schema)


def archive(pages: DataFrame, key: str = "page_id", folder: str | None = None) -> DataFrame:
    """Writes every row of pages (key, url, html) into bundles; the index of its records."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return write_bundles(marked(pages, key), folder)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record says, after the archives were written and read back."""
    index = archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM m
"""
