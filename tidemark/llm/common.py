"""What the operators of this package share: tables, folders, and words of Arrow text columns.

Texts reach Python in Arrow batches. ``pieces`` cuts a batch into runs of whole
texts of about a megabyte, so that the arrays made from the bytes stay small
whatever the batch holds; a longer text is a piece of its own.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where spark.checkpoint.dir is unset, as in local tests.
LOCAL_SHARED = "/tmp/checkpoints"


#: Rows of an Arrow batch of whole texts: the session's 10 000 make buffers of tens of megabytes on both sides, which a long-lived executor doesn't give back.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of an Arrow batch, where a job asks for a limit: however long the texts are, what is on its way between Java and Python stays small. Sessions that run nothing else may set it once.
BATCH_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, limit: int | None = None) -> None:
    """Lets the session's Arrow batches hold at most BATCH_ROWS rows, and limit bytes or one row if given; smaller settings stay. Both hold for what the session runs later too."""
    if limit is not None and not 0 < int(spark.conf.get(_BYTES).rstrip("b")) <= limit:
        spark.conf.set(_BYTES, str(limit))
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS or int(spark.conf.get(_BATCH)) <= 0:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, for operators that take whole texts through Arrow."""
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{LOCAL_SHARED}/{spark.sparkContext.applicationId}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Lets Spark delete a statement's shuffle files when it ends; otherwise they stay on disk until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, path: str) -> DataFrame:
    """df written as a Parquet table and read back. Its shuffle files, which nothing reads again, go at once; the session's setting stays."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read back: later jobs start from
    the files, not from the lineage, so that a lost executor costs no recomputation."""
    return saved(df, f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}")


def crc_mod(key: Column | str, m: int) -> Column:
    """crc32 of the key as text, modulo m; keeps rows of one key on one side of a split."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


# Words -------------------------------------------------------------------------------------------

#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at once.
HASHED = 1 << 20


class _Powers:
    """Powers of an odd base modulo 2**64, and those of its inverse, as many as a run of HASHED bytes needs."""

    up = down = np.zeros(0, dtype=np.uint64)

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.up):
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([[np.uint64(1)], np.full(HASHED, x, dtype=np.uint64)]).cumprod(dtype=np.uint64) for x in (int(_ODD), pow(int(_ODD), -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def text_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column and the offsets of its rows; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    offs = np.frombuffer(offsets, dtype=kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def pieces(arr: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows of at most limit bytes, or of one row."""
    data, offs = text_bytes(arr)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, apart: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the first word of each row (and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~apart[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    at = offs[:-1][full]
    first[at] = inside[at]
    at = offs[1:][full] - 1
    last[at] = inside[at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word. Bytes are taken HASHED at a time, so that the arrays stay small for any text and word."""
    up, down = _POWERS.get()
    out = np.empty(len(starts), dtype=np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            at = starts[lo]
            hi = int(np.searchsorted(ends, at + HASHED, side="right"))
            if hi > lo:
                part = data[at : ends[hi - 1]]
                sums = np.zeros(len(part) + 1, dtype=np.uint64)
                np.cumsum(_BYTE_CODES[part] * up[: len(part)], out=sums[1:])
                out[lo:hi] = (sums[ends[lo:hi] - at] - sums[starts[lo:hi] - at]) * down[starts[lo:hi] - at]
            else:
                hi, scale, total = lo + 1, np.uint64(1), np.uint64(0)
                for first in range(at, ends[lo], HASHED):
                    part = data[first : min(first + HASHED, ends[lo])]
                    total += scale * (_BYTE_CODES[part] * up[: len(part)]).sum(dtype=np.uint64)
                    scale *= up[HASHED]
                out[lo] = total
            lo = hi
        return mix(out + (ends - starts).astype(np.uint64))


def shingle_rows(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words of each row, repeats included, and where each row's begin (and the end).

    first: the number of the first word of each row. A row of fewer words is one run, one without words none.
    """
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    row = np.repeat(np.arange(len(n)), count)
    begin = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    used = np.minimum(n, size)[row]
    with np.errstate(over="ignore"):
        h = used.astype(np.uint64)
        for j in range(size):
            inside = used > j
            if inside.all():
                h = (h ^ words[begin + j]) * _ODD
                h ^= h >> np.uint64(29)
            else:
                x = (h[inside] ^ words[begin[inside] + j]) * _ODD
                h[inside] = x ^ (x >> np.uint64(29))
    return mix(h), at


# Filters of fixed size ---------------------------------------------------------------------------

#: Bits of the filters that are sent to the tasks, a multiple of 32768.
FILTER_BITS = 1 << 26


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which of FILTER_BITS places the hashes (h) fall on: a filter of fixed size that lets everything through that it has seen."""
    place = F.pmod("h", F.lit(FILTER_BITS)) + 1  # the functions count places from 1
    found = hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in found:
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def seen(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes.view(np.int64) % FILTER_BITS
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def unused(name: str, df: DataFrame) -> str:
    """name, lengthened until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
