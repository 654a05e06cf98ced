"""Benchmark decontamination: short test items found inside long documents by size-partitioned MinHash containment.

Items and documents are sets of runs of ``WIDTH`` words. A long document's similarity to a short item is near 0
however well it holds it, so what counts is containment: the share of the item's set that the document has. Items are parted by
size, in powers of two. An item's sketch is the least values of one random permutation of its set (bottom-k MinHash): as many as it
may miss, and one more. A document that holds ``percent`` per cent of the item has at least one of them, whatever its own
length, so that the search misses nothing. A document is looked up only in the partitions that it is large enough for.
Each candidate is confirmed by counting the item's whole set in the document's.

Documents are never shuffled: ``BLOCKS`` blocks of items (each of at most ``BLOCK_SHINGLES`` of their shingles, or one item) are broadcast
and every document passes by them, once for each so many blocks. Words are runs of ASCII letters, digits and characters beyond ASCII, A to Z in lower case.

Defined results: items without words match nothing; an item of fewer words than ``WIDTH`` is one run, and looked for among the runs of so
many words of every document. Null texts are empty. A repeated document gives a row for each time, a repeated item (equal id and text) one.
A document with a null key is searched like others. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, documents, mix, pieces, shingle_rows, table, word_hashes, word_spans, written

WIDTH = 5
PERCENT = 80
#: Shingles of the items that are broadcast at once: 8 bytes each, and less than half of them again as sketches.
BLOCK_SHINGLES = 1 << 20
#: Blocks that are searched for in one pass.
BLOCKS = 4
_MAP_BITS = 20

_APART = np.ones(256, dtype=bool)
_APART[list(range(ord("0"), ord("9") + 1)) + list(range(ord("a"), ord("z") + 1)) + list(range(0x80, 0x100))] = False


def words_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of the first word of each row (and the end)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, _APART)
    return word_hashes(low, starts, ends), first


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles make percent per cent."""
    return (n * percent + 99) // 100


class Block:
    """Items with their sets and sketches; ids: of the items, sets: sorted hashes of each, width: words of their runs."""

    def __init__(self, ids: pa.Array, sets: list[np.ndarray], percent: int, width: int) -> None:
        self.kind, self.ids, self.sets, self.width = ids.type, ids.to_pylist(), sets, width
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.least = needed(self.sizes, percent)
        # The partitions: the least size of a document that can hold an item of each.
        part = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(np.int64)
        self.part = part
        self.enough = np.array([self.least[part == p].min() if (part == p).any() else 1 << 62 for p in range(int(part.max(initial=0)) + 1)], dtype=np.int64)
        sketches = [s[np.argsort(mix(s), kind="stable")[: len(s) - need + 1]] for s, need in zip(sets, self.least, strict=True)]
        hashes = np.concatenate([*sketches, np.zeros(0, np.uint64)])
        items = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]
        self.map = np.zeros(1 << _MAP_BITS, dtype=bool)
        self.map[self._slot(self.hashes)] = True

    @staticmethod
    def _slot(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)

    def held(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, common shingles) for each row's set and each item that it holds."""
        place = np.flatnonzero(self.map[self._slot(hashes)])
        if not len(place) or not len(self.hashes):
            return
        found = hashes[place]
        lo, hi = np.searchsorted(self.hashes, found, side="left"), np.searchsorted(self.hashes, found, side="right")
        some = hi > lo
        place, lo, hi = place[some], lo[some], hi[some]
        times = hi - lo
        ends = np.cumsum(times)
        item = self.items[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - times), times)]
        row = np.repeat(np.searchsorted(at, place, side="right") - 1, times)
        large = np.diff(at)[row] >= self.enough[self.part[item]]
        candidates = np.unique(row[large] * len(self.sets) + item[large])
        before, own = -1, hashes[:0]
        for c in candidates:
            r, i = divmod(int(c), len(self.sets))
            if r != before:
                before, own = r, np.unique(hashes[at[r] : at[r + 1]])
            where = np.searchsorted(own, self.sets[i])
            where[where == len(own)] = 0
            common = int((own[where] == self.sets[i]).sum())
            if common >= self.least[i]:
                yield r, i, common


def blocks(items: DataFrame, key: str, percent: int, width: int) -> Iterator[Block]:
    """The items (key, text) in blocks, by the words of their runs and by size; each is collected on its own."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column("text")):
                words, first = words_of(data, offs)
                hashes, at = shingle_rows(words, first, width)
                sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.minimum(np.diff(first), width)), pa.array(sets, pa.list_(pa.int64()))], [key, "n", "width", "shingles"])

    known = items.select(key, "text").distinct().mapInArrow(run, f"`{key}` {kind}, n bigint, width bigint, shingles array<bigint>").filter("n > 0")
    known = written(known.withColumn("part", F.floor(F.log2("n")).cast("int")), "items")
    totals: dict[int, dict[int, int]] = {}
    for r in known.groupBy("width", "part").agg(F.sum("n").alias("n")).collect():
        totals.setdefault(r["width"], {})[r["part"]] = r["n"]
    for words, parts in sorted(totals.items()):
        wanted = [F.lit(True)]
        if sum(parts.values()) > BLOCK_SHINGLES:
            wanted = [(F.col("part") == p) & (F.pmod(F.xxhash64(key, "shingles"), F.lit(k)) == b) for p, n in sorted(parts.items()) for k in [-(-n // BLOCK_SHINGLES)] for b in range(k)]
        for which in wanted:
            rows = known.filter((F.col("width") == words) & which).select(key, "shingles").orderBy(key, F.xxhash64("shingles")).toArrow()
            yield Block(rows[key].combine_chunks(), [np.sort(np.array(x, dtype=np.int64).view(np.uint64)) for x in rows["shingles"].to_pylist()], percent, words)


def _held(column: pa.Array, found: list[Block]) -> Iterator[tuple[int, Block, int, int]]:
    """(row, block, item, common shingles) for each text of a column and each item that it holds."""
    for lo, _, data, offs in pieces(column):
        words, first = words_of(data, offs)
        sets = {w: shingle_rows(words, first, w) for w in {b.width for b in found}}
        for block in found:
            for row, item, common in block.held(*sets[block.width]):
                yield lo + row, block, item, common


def _passes(items: DataFrame, key: str, percent: int, width: int) -> Iterator[list[Block]]:
    every = blocks(items, key, percent, width)
    while some := list(islice(every, BLOCKS)):
        yield some


def search(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """(key, item_key, n_common, n_shingles): each document of docs (key, text) with each item that it holds."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, n_common bigint, n_shingles bigint"
    spark, found = docs.sparkSession, None

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [(row, block.ids[item], common, int(block.sizes[item])) for row, block, item, common in _held(batch.column("text"), shared.value)]
                if got:
                    rows, ids, common, sizes = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(ids, shared.value[0].kind), pa.array(common, pa.int64()), pa.array(sizes, pa.int64())], [key, item_key, "n_common", "n_shingles"])

        return run

    for some in _passes(items, item_key, percent, width):
        part = docs.select(key, "text").mapInArrow(searcher(spark.sparkContext.broadcast(some)), schema)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], schema) if found is None else found


def decontaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, width: int = WIDTH, item_key: str = "item_id") -> DataFrame:
    """The rows of docs that hold no item, all columns as they are; nothing is shuffled."""
    spark = docs.sparkSession

    def keeper(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for row, _, _, _ in _held(batch.column("text"), shared.value):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        return run

    for some in _passes(items, item_key, percent, width):
        docs = docs.mapInArrow(keeper(spark.sparkContext.broadcast(some)), docs.schema)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with every benchmark item of which it holds at least 80 per cent."""
    return search(documents(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _sql_words(source: str, key: str) -> str:
    """(r, key, k: words of the text, i: place, t: word) of every row of source."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')"
    return f"(SELECT r, {key}, len(w) AS k, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS r, {key}, {words} AS w FROM {source}))"


def _sql_run(width: int) -> str:
    return "concat_ws(' ', " + ", ".join(f"lead(t, {j}) OVER (PARTITION BY r ORDER BY i)" if j else "t" for j in range(width)) + ")"


ORACLE_SQL = f"""
WITH b0 AS (SELECT r, item_id, k, i, {_sql_run(WIDTH)} AS x FROM {_sql_words("(SELECT DISTINCT item_id, text FROM benchmark)", "item_id")}),
b AS (SELECT DISTINCT r, item_id, least(k, {WIDTH}) AS w, x FROM b0 WHERE i <= greatest(k - {WIDTH - 1}, 1)),
n AS (SELECT r, count(*) AS n FROM b GROUP BY r),
d0 AS (SELECT r, doc_id, k, i, {", ".join(f"{_sql_run(w)} AS x{w}" for w in range(1, WIDTH + 1))} FROM {_sql_words("documents", "doc_id")}),
d AS ({" UNION ALL ".join(f"SELECT DISTINCT r, doc_id, {w} AS w, x{w} AS x FROM d0 WHERE i <= k - {w - 1} AND {w} IN (SELECT w FROM b)" for w in range(1, WIDTH + 1))})
SELECT any_value(d.doc_id) AS doc_id, any_value(b.item_id) AS item_id, CAST(count(*) AS BIGINT) AS n_common, CAST(any_value(n.n) AS BIGINT) AS n_shingles
FROM d JOIN b ON d.x = b.x AND d.w = b.w JOIN n ON n.r = b.r
GROUP BY d.r, b.r
HAVING 100 * count(*) >= {PERCENT} * any_value(n.n)
"""
