"""Near-duplicate documents by MinHash, with odd sketches to verify banded candidates.

A document is the set of its runs of ``width`` words. Documents of equal sets are one class from the start.
Each class has ``SAMPLES`` MinHash values, bands of which are the buckets in which candidates meet. Classes that meet others get
``FINE`` values, folded into a bitmap by parity (an odd sketch): the population
count of the XOR of two bitmaps estimates how many values differ, which is precise just where similarities are high.
What passes the bitmaps is confirmed on the full sets, by whole numbers. All that compares is built from SQL functions.

A bucket never emits all its pairs. First each member meets the least of its bucket; then the least one that isn't yet in
the component of that meets the members of other components; at last, only what
still stands in different components of one bucket is compared, and of this only pairs leave the join whose bitmaps are
alike. Members that are linked through others need no link of their own: components come out the same.

The chance to miss a pair just at the threshold is under ``MISS`` (see ``bands``); more alike pairs are missed far less.

Texts are never shuffled: a filter of fixed size tells the tasks which documents stand in a bucket with others, and only the sets
of these are written; only rows that the deduplication may drop meet its verdict in a join. Links are between
classes, each known by its least key and a hash of its set, so that texts under one key stay apart.

Defined results: null and empty texts, or texts without words, are empty sets, linked with nothing. Fewer words than ``width`` are
one run. Rows with a null key are linked with nothing and have a null component. Rows that repeat a key each get their row; if
their texts differ, each row goes by its own text. Other columns are not read. ``deduplicated`` keeps one of the rows of equal key
and text (whichever, if other columns differ), whatever types and names the other columns have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, bitmap, documents, mix, pieces, seen, shingle_rows, unused, word_hashes, word_spans, written

SAMPLES = 128
#: MinHash values of an odd sketch, and its bits, in words of 64.
FINE = 1024
BITS = 8192
MISS = 1e-6
#: How many standard deviations below the threshold a bitmap's estimate may be.
SLACK = 5.0
#: Rows whose MinHash values are held at once.
ROWS = 256

_SEEDS = np.random.default_rng(7).integers(0, 2**63, (2, FINE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(similarity: float, samples: int = SAMPLES) -> tuple[int, int]:
    """(bands, rows of each): the most rows with which a pair of the similarity is missed with a chance under MISS."""
    rows = max(r for r in range(1, samples + 1) if r == 1 or (1 - similarity**r) ** (samples // r) <= MISS)
    return samples // rows, rows


def most_differing(similarity: float, samples: int = FINE) -> int:
    """The largest population count of the XOR of two odd sketches that a pair of the similarity may have."""
    least = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / samples)
    differ = 2 * samples * (1 - max(least, 0.0))
    return math.ceil(BITS / 2 * (1 - math.exp(-2 * differ / BITS)))


def minhash(hashes: np.ndarray, starts: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """(rows, samples): the least of each permutation of each row's hashes; no row is empty."""
    out = np.empty((len(starts) - 1, samples), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(samples):
            out[:, i] = np.minimum.reduceat((hashes ^ _SEEDS[0, i]) * _SEEDS[1, i], starts[:-1])
    return out


def _few(starts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, end row, starts) of at most ROWS rows."""
    for lo in range(0, len(starts) - 1, ROWS):
        yield lo, min(lo + ROWS, len(starts) - 1), starts[lo : lo + ROWS + 1]


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """(rows, BITS / 64) signed words: each sample flips one bit."""
    with np.errstate(over="ignore"):
        place = (mix(samples ^ _SEEDS[1, : samples.shape[1]]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    n = len(samples)
    flips = np.bincount((place + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(flips.astype(np.uint8).reshape(n, BITS), axis=1).view(np.int64)


def band_keys(samples: np.ndarray, n_bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.empty((len(samples), n_bands), dtype=np.uint64)
        for b in range(n_bands):
            h = np.full(len(samples), b + 1, dtype=np.uint64)
            for r in range(rows):
                h = mix(h * _SEEDS[1, 0] ^ samples[:, b * rows + r])
            out[:, b] = h
    return out.view(np.int64)


def _distinct(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each row, and where each row's begin."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs)
    hashes, at = shingle_rows(word_hashes(low, starts, ends), first, width)
    if not len(hashes):
        return hashes, at
    for lo, hi in zip(at, at[1:], strict=False):
        hashes[lo:hi].sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[at[:-1][at[:-1] < at[1:]]] = True
    return hashes[new], np.concatenate([[0], np.cumsum(new)])[at]


def _digests(hashes: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """Sixteen bytes of each set of hashes; no set is empty."""
    both = np.stack([np.add.reduceat(mix(hashes ^ _SEEDS[0, 0]), starts[:-1]), np.bitwise_xor.reduceat(hashes, starts[:-1])], axis=1)
    return [x.tobytes() for x in both]


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, mark, n, digest, bands) of each row of docs (id, text, mark); bands is null for empty sets."""
    n_bands, rows = bands(percent / 100)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in pieces(batch.column("text")):
                hashes, at = _distinct(data, offs, width)
                count = np.diff(at)
                some = np.flatnonzero(count)
                keys = np.zeros((hi - lo, n_bands), np.int64)
                digests = np.full(hi - lo, b"", dtype=object)
                if len(some):
                    starts = np.append(at[:-1][some], len(hashes))
                    for a, b, at_few in _few(starts):
                        keys[some[a:b]] = band_keys(minhash(hashes[at_few[0] : at_few[-1]], at_few - at_few[0]), n_bands, rows)
                    digests[some] = _digests(hashes, starts)
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * n_bands, mask=np.append(count == 0, False))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).slice(lo, hi - lo) for c in ("id", "mark")], pa.array(count.astype(np.int64)), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                    ["id", "mark", "n", "digest", "bands"],
                )

    return docs.mapInArrow(run, f"id {kinds['id']}, mark bigint, n bigint, digest binary, bands array<bigint>")


def sets_of(docs: DataFrame, width: int, wanted: np.ndarray, repeated: np.ndarray) -> DataFrame:
    """(id, digest, again, n, shingles, sketch) of the rows of docs (id, text) that the filter ``wanted`` lets through and that
    aren't empty: the full set and its odd sketch. again: the filter ``repeated`` has the row, other rows may have its id and set."""
    kind = docs.schema["id"].dataType.simpleString()
    both = docs.sparkSession.sparkContext.broadcast((wanted, repeated))
    names = ["id", "digest", "again", "n", "shingles", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(seen(both.value[0], batch.column("slot").to_numpy())))
            again = seen(both.value[1], batch.column("slot").to_numpy())
            for lo, hi, data, offs in pieces(batch.column("text")):
                hashes, at = _distinct(data, offs, width)
                some = np.flatnonzero(np.diff(at))
                for a, b, few in _few(np.append(at[:-1][some], len(hashes))):
                    own, few = hashes[few[0] : few[-1]], few - few[0]
                    sketch = odd_sketch(minhash(own, few, FINE))
                    full = pa.ListArray.from_arrays(pa.array(few.astype(np.int32)), pa.array(own.view(np.int64)))
                    words = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * sketch.shape[1]), pa.array(sketch.ravel()))
                    rows = lo + some[a:b]
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(_digests(own, few), pa.binary()), pa.array(again[rows]), pa.array(np.diff(few).astype(np.int64)), full, words], names)

    return docs.select("id", "text", _slot("id").alias("slot")).mapInArrow(run, f"id {kind}, digest binary, again boolean, n bigint, shingles array<bigint>, sketch array<bigint>")


# Links ------------------------------------------------------------------------------------------


def _slot(key: str) -> Column:
    return F.xxhash64(F.lit(17), F.col(key))


def _node() -> Column:
    """What stands for a class: its least key, and a hash of its set."""
    return F.struct("id", F.xxhash64("digest").alias("tag"))


def _sizes(a: str, b: str, percent: int) -> Column:
    """Sets of these sizes may reach the similarity."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _alike(a: str, b: str, percent: int) -> Column:
    """By sizes and odd sketches, the pair (a_n, a_sketch, b_n, b_sketch) may reach the similarity."""
    differing = F.aggregate(F.zip_with(f"{a}_sketch", f"{b}_sketch", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return _sizes(f"{a}_n", f"{b}_n", percent) & (differing <= most_differing(percent / 100))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, n, shingles) reach the similarity."""
    left, right = (sets.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common = both.select("a", "b", "a_n", "b_n", F.size(F.array_intersect("a_set", "b_set")).alias("common"))
    return common.filter(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links (a, b): the least node that is reachable.

    Alternates two steps until only stars are left: each node hangs its larger neighbours on its least one, then itself and
    its smaller neighbours. Each is an aggregation and a join; a node of any degree is only ever counted, never gathered.
    """
    edges = written(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def hung(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        if large:
            out = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        else:
            met = both.join(least, "u")
            out = met.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.filter(F.col("u") != F.col("v")).distinct()

    def stars() -> bool:
        """Each node hangs on one other, on which others hang, or holds others: v < u, so that what holds them is the least."""
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        return ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter(F.col("hangs") + F.col("holds") > 1).isEmpty()

    while not stars():
        wide = hung(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        edges = written(hung(wide, False), "edges")
    hanging = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return written(hanging.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")


def joined(of: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) with further links (a, b): only what these meet is looked at, as links between components."""
    if links.isEmpty():
        return of
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    met = of.join(ends, "node", "left_semi").select("node", "component", F.lit(False).alias("new"))
    met = written(ends.select("node", F.col("node").alias("component"), F.lit(True).alias("new")).unionByName(met).groupBy("node").agg(F.min_by("component", "new").alias("component"), F.min("new").alias("new")), "met")
    a, b = (met.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in "ab")
    top = components(links.join(a, "a").join(b, "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))).select(F.col("node").alias("component"), F.col("component").alias("_least"))
    every = of.unionByName(met.filter("new").select("node", "component"))
    return written(every.join(top, "component", "left").select("node", F.coalesce("_least", "component").alias("component")), "components")


def candidate_sets(docs: DataFrame, stars: DataFrame, width: int) -> DataFrame:
    """(node, n, shingles, sketch) of the classes in stars, each by one of its documents."""
    members = stars.select(_slot("node.id").alias("h"), "several")
    raw = written(sets_of(docs, width, bitmap(members), bitmap(members.filter("several"))), "sets").withColumn("node", _node())
    single = raw.filter(~F.col("again")).select("node", "n", "shingles", "sketch")
    others = raw.filter("again").groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "shingles", "sketch")])
    return single.unionByName(written(others, "sets"))


def similar(classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame | None:
    """(node, component) of the classes (node, n, rows, bands) that are linked with others; None if there is no candidate."""
    tall = classes.select("node", "n", (F.col("rows") > 1).alias("several"), F.explode("bands").alias("band"))
    least = tall.groupBy("band").agg(F.min(F.struct("node", "n")).alias("hub"), F.max("node").alias("_most")).filter(F.col("hub.node") != F.col("_most")).drop("_most")
    stars = written(tall.join(least, "band").select("node", "n", "several", "band", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "stars")
    if stars.isEmpty():
        return None
    sets = candidate_sets(docs, stars, width)
    known = sets.select("node", "n", "sketch")

    def checked(pairs: DataFrame) -> DataFrame:
        left, right = _named(known, "a"), _named(known, "b")
        near = pairs.join(left, F.col("a") == F.col("a_node")).join(right, F.col("b") == F.col("b_node")).filter(_alike("a", "b", percent)).select("a", "b")
        return written(confirmed(near, sets, percent), "links")

    of = components(checked(stars.filter((F.col("node") != F.col("hub")) & _sizes("n", "hub_n", percent)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()))

    def apart(of: DataFrame) -> DataFrame:
        """Members (node, n, band, component, main) of the buckets with several components; main: that of the hub."""
        standing = stars.join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
        main = standing.filter(F.col("node") == F.col("hub")).select("band", F.col("component").alias("main"))
        several = standing.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter(F.col("_lo") != F.col("_hi")).select("band")
        return written(standing.join(several.join(main, "band"), "band").select("node", "n", "band", "hub", "component", "main"), "apart")

    # The least member outside of the hub's component meets the members of other components.
    rest = apart(of)
    second = written(rest.filter(F.col("component") != F.col("main")).groupBy("band").agg(F.min(F.struct("node", "n", "component")).alias("_s")), "second")
    met = rest.filter(F.col("node") != F.col("hub")).join(second, "band").filter((F.col("component") != F.col("_s.component")) & _sizes("n", "_s.n", percent))
    of = joined(of, checked(met.select(F.col("node").alias("a"), F.col("_s.node").alias("b")).distinct()))

    # What is still apart: only those not in the hub's component, against all of their bucket.
    rest = apart(of).filter(F.col("node") != F.col("hub")).drop("n").join(known, "node").join(classes.select("node", "bands"), "node")
    all_of = _named(rest, "a")
    others = _named(rest.filter(F.col("component") != F.col("main")), "b")
    once = (F.col("a_component") == F.col("a_main")) | (F.col("a_node") < F.col("b_node"))
    # In the first of the bands that a pair has in common.
    common = F.filter(F.zip_with("a_bands", "b_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    first = F.get(common, 0) == F.col("a_band")
    near = all_of.join(others, (F.col("a_band") == F.col("b_band")) & (F.col("a_component") != F.col("b_component")) & once & first & _alike("a", "b", percent))
    return joined(of, written(confirmed(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), sets, percent), "links"))


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, mark, n, component) of every row of docs (id, text, mark); component: the least id reachable."""
    signed = written(signatures(docs, width, percent), "signatures")
    full = signed.filter((F.col("n") > 0) & F.col("id").isNotNull())
    grouped = full.groupBy("digest", "n").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.first("bands").alias("bands"))
    classes = written(grouped.select("digest", "n", _node().alias("node"), "rows", "bands"), "classes")
    of = similar(classes, docs.filter(F.col("id").isNotNull()), width, percent)
    found = classes.select("digest", "n", "node")
    if of is None:
        found = found.select("digest", "n", F.col("node.id").alias("component"))
    else:
        found = found.join(of, "node", "left").select("digest", "n", F.coalesce("component", "node")["id"].alias("component"))
    linked = full.select("id", "mark", "digest", "n").join(found, ["digest", "n"]).select("id", "mark", "n", "component")
    return linked.unionByName(signed.filter((F.col("n") == 0) | F.col("id").isNull()).select("id", "mark", "n", F.col("id").alias("component")))


def _ready(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(F.col(key).alias("id"), "text", F.xxhash64("text").alias("mark"))


def link(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of docs (key, text).

    Rows are linked if 100 * common shingles >= percent * all shingles of both; component_id is the least key reachable.
    """
    of = _linked(_ready(docs, key), width, percent)
    return of.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80, key: str = "doc_id") -> DataFrame:
    """The rows of docs that stay: the one of the least key of each component, rows with a null key, none twice.

    Rows that surely stay pass by; those that go, and those of one key and text, are all that is shuffled.
    """
    of = written(_linked(_ready(docs, key), width, percent), "linked")
    slots = of.groupBy("id", "mark").agg(F.count("*").alias("_rows"), F.bool_and(F.col("id").eqNullSafe(F.col("component"))).alias("_stays"))
    stay = slots.filter("_stays").select("id", "mark")
    slot, mark = unused("_slot", docs), unused("_mark", docs)
    doubtful = docs.sparkSession.sparkContext.broadcast(bitmap(slots.filter("NOT _stays OR _rows > 1").select(F.xxhash64("id", "mark").alias("h"))))
    marked = docs.withColumn(mark, F.xxhash64("text")).withColumn(slot, F.xxhash64(F.col(key), F.col(mark)))

    def some(doubted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(seen(doubtful.value, batch.column(slot).to_numpy()) == doubted))

        return run

    sure = marked.mapInArrow(some(False), marked.schema).select(*docs.columns)
    likely = marked.mapInArrow(some(True), marked.schema)
    judged = likely.join(stay, likely[key].eqNullSafe(stay["id"]) & (likely[mark] == stay["mark"]), "left_semi")
    return sure.unionByName(judged.dropDuplicates([key, mark]).select(*docs.columns))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component under three-word shingles and a similarity of 0.85."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return link(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (
  SELECT r, len(w) AS k, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d
), v AS (
  SELECT r, k, i, concat_ws(' ', t, lead(t) OVER (PARTITION BY r ORDER BY i), lead(t, 2) OVER (PARTITION BY r ORDER BY i)) AS sh FROM t
), x AS (
  SELECT DISTINCT r, sh FROM v WHERE i <= greatest(k - 2, 1)
), n AS (
  SELECT r, count(*) AS n FROM x GROUP BY r
), c AS (
  SELECT x.r AS a, y.r AS b, count(*) AS c FROM x JOIN x y ON x.sh = y.sh AND x.r <> y.r GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n p ON p.r = a JOIN n q ON q.r = b JOIN d e ON e.r = a JOIN d f ON f.r = b
  WHERE 100 * c >= 85 * (p.n + q.n - c) AND e.doc_id IS NOT NULL AND f.doc_id IS NOT NULL
), reach AS (
  SELECT r AS a, r AS b FROM d UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), least AS (
  SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least.component_id, d.doc_id IS NOT DISTINCT FROM least.component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""
