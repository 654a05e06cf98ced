"""How concentrated a set of return streams is: correlations of all, principal components, clusters by complete linkage.

Streams are rows (instrument, d, r); a day without a row counts as 0. Spark sums each stream by day and lays it out as one row of its days; such rows are dealt out in blocks, and a
task multiplies its own block with half of the others, a few rows at a time, so that no products by day are shuffled. The matrix has a row for each two instruments, whatever the length of history.
Components of streams come from the smaller side: where there are more instruments than days, from products of every two days. Components and clusters of a given matrix take it whole, in one
task, for at most ``MOST`` instruments (beyond, an error). Clusters of streams have no such bound: streams that are alike join first, then blocks are multiplied again and again, a task keeps the
nearest pairs of clusters among its own, one task joins those up to the distance to which all are known, and what is left meets anew; no matrix is held or written.

Defined results: streams with fewer than ``least`` rows or without variance are left out; null r counts as 0, null instruments are left out; rows of one instrument and day add up.
Without two streams there are no pairs; one stream is a component and a cluster of its own; an empty table gives none.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.streaming.windows import shared_folder

#: Most instruments whose matrix a task takes (128 MB).
MOST = 4096
#: Values of a dense block (64 MB), streams that are multiplied with it at once, and rows that a task gives back at once.
BLOCK_VALUES, AT_ONCE, OUT_ROWS = 1 << 23, 256, 1 << 18
#: Tasks that multiply blocks, some more or fewer.
TASKS = 48
#: Pairs of clusters that one task joins at a time, the nearest ones (64 MB).
NEAREST = 1 << 22
#: Parts that sum up products of days; each is a square of the days.
PARTS = 16


def _vectors(streams: DataFrame, least: int) -> DataFrame:
    """(instrument, t, i, r, top) of the streams that have at least so many rows and vary: r the sums of their days i, top the largest size of one, t how many days there are."""
    counted = streams.filter("instrument IS NOT NULL").groupBy("instrument", "d").agg(F.sum(F.coalesce(F.col("r").cast("double"), F.lit(0.0))).alias("r"), F.count("*").alias("rows"))
    # The different days, few rows whatever the number of streams; a null day is one.
    days = streams.filter("instrument IS NOT NULL").select("d").distinct().select("d", (F.row_number().over(Window.orderBy("d")) - 1).alias("i"))
    placed = counted.join(days, counted["d"].eqNullSafe(days["d"])).select("instrument", "i", "r", "rows")
    each = placed.groupBy("instrument").agg(F.array_sort(F.collect_list(F.struct("i", "r"))).alias("v"), F.sum("rows").alias("rows"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
    each = each.join(F.broadcast(days.agg(F.count("*").alias("t")))).filter((F.col("rows") >= least) & ~((F.col("lo") == F.col("hi")) & ((F.col("lo") == 0) | (F.col("n") == F.col("t")))))
    return each.select("instrument", "t", F.col("v.i").alias("i"), F.col("v.r").alias("r"), F.greatest(F.abs("lo"), F.abs("hi")).alias("top"))


def _dense(batch: pa.RecordBatch, days: int) -> np.ndarray:
    """The streams of a batch, a row each, with mean 0 and length 1."""
    i, r = batch.column("i"), batch.column("r")
    out = np.zeros((batch.num_rows, days))
    out[np.repeat(np.arange(batch.num_rows), np.diff(i.offsets.to_numpy())), i.flatten().to_numpy()] = r.flatten().to_numpy()
    out -= out.mean(axis=1, keepdims=True)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            # A copy, as offsets of a slice begin elsewhere.
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([c]) if not c.offset else c.take(pa.array(np.arange(len(c)))) for c in batch.slice(lo, rows).columns], schema=batch.schema)


def _starts(values: np.ndarray) -> np.ndarray:
    """Where equal values that follow each other begin."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, int)


def _blocks(n: int, days: int) -> tuple[int, int]:
    """Into how many blocks streams are dealt, and how many tasks share a block's work."""
    blocks = 1 if n <= 512 else max(8, -(-n * days // BLOCK_VALUES))
    return blocks, max(1, min(blocks // 2, -(-TASKS // blocks)))


def _dealt(rows: DataFrame, blocks: int, parts: int, order: list[str]) -> DataFrame:
    """Rows (with a block) for _pairs(): every two blocks meet once, each with those at most half a circle ahead of it; a task has its own block (k = 0) and a part of those ahead."""
    goes = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct((F.col("block") * parts + p).alias("task"), F.lit(0).alias("k")))
    if blocks > 1:
        ahead = F.transform(F.sequence(F.lit(1), F.lit(blocks // 2)), lambda k: F.struct((F.pmod(F.col("block") - k, F.lit(blocks)) * parts + k % parts).cast("int").alias("task"), k.alias("k")))
        goes = F.concat(goes, F.filter(ahead, lambda x: (2 * x["k"] != blocks) | (x["task"] < blocks // 2 * parts)))
    return rows.select("*", F.inline(goes)).repartitionById(blocks * parts, "task").sortWithinPartitions("task", "k", *order)


def _chunks(batches: Iterator[pa.RecordBatch], names: list[str], group: str | None) -> Iterator[tuple[int, int, np.ndarray, pa.RecordBatch]]:
    """(task, k, streams as _dense() makes them, the named columns), some AT_ONCE streams at a time; rows of one group stay together."""
    of, held = None, []

    def whole() -> tuple[np.ndarray, pa.RecordBatch]:
        return np.concatenate([x for x, _ in held]), pa.concat_batches([x for _, x in held])

    for batch in batches:
        for lo in range(0, batch.num_rows, AT_ONCE):
            few = batch.slice(lo, AT_ONCE)
            task, k = (few.column(c).to_numpy() for c in ("task", "k"))
            cuts = [*_starts(task * (k.max() + 1) + k), len(k)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                part = few.slice(at, to - at)
                if of != (here := (int(task[at]), int(k[at]))) and held:
                    yield *of, *whole()
                    held = []
                of = here
                held.append((_dense(part, part.column("t")[0].as_py()), part.select(names)))
                if sum(len(x) for x, _ in held) >= AT_ONCE:
                    rows, columns = whole()
                    end = len(rows) if group is None else _starts(columns.column(group).to_numpy())[-1]
                    if end:
                        yield *of, rows[:end], columns.slice(0, end)
                    held = [(rows[end:], columns.slice(end))] if end < len(rows) else []
    if held:
        yield *of, *whole()


def _pairs(batches: Iterator[pa.RecordBatch], parts: int, names: list[str], group: str | None = None) -> Iterator[tuple[np.ndarray, pa.RecordBatch, np.ndarray, pa.RecordBatch, int | None]]:
    """What a task of _dealt() multiplies: streams of its block and their named columns, others and theirs. Within the block the others begin at the fifth's row of it and end with it; else that is None."""
    of, own, rows, mine = None, [], None, None
    for task, k, dense, columns in itertools.chain(_chunks(batches, names, group), [(None, 1, None, None)]):
        if own and (task != of or k):
            rows, mine = np.concatenate([x for x, _ in own]), pa.concat_batches([x for _, x in own])
            own = []
            if of % parts == 0:
                ends = np.append(np.arange(len(rows)) if group is None else _starts(mine.column(group).to_numpy()), len(rows))
                at = 0
                while at < len(rows):
                    to = int(ends[min(np.searchsorted(ends, at + AT_ONCE), len(ends) - 1)])
                    yield rows[:to], mine.slice(0, to), rows[at:to], mine.slice(at, to - at), at
                    at = to
        if task != of:
            of, rows = task, None
        if k == 0:
            own.append((dense, columns))
        elif rows is not None:
            yield rows, mine, dense, columns, None


def _correlated(vectors: DataFrame, n: int, days: int, digits: int | None = None) -> DataFrame:
    blocks, parts = _blocks(n, days)
    kind = vectors.schema["instrument"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, i, j = None, None, None
        for rows, mine, dense, theirs, at in _pairs(batches, parts, ["instrument"]):
            mine, theirs = mine.column("instrument"), theirs.column("instrument")
            step = max(1, OUT_ROWS // len(rows))
            for lo in range(0, len(dense), step):
                c = dense[lo : lo + step] @ rows.T
                np.clip(c, -1.0, 1.0, out=c)
                if digits is not None:
                    # Halves up by the product, as the SQL does; 0 has no sign.
                    c = np.trunc(c * 10.0**digits + np.copysign(0.5, c)) / 10.0**digits + 0.0
                if c.shape != shape:
                    shape, (i, j) = c.shape, (x.ravel().astype(np.int32) for x in np.indices(c.shape))
                x, y, c = theirs.slice(lo, step).take(pa.array(i)), mine.take(pa.array(j)), c.ravel()
                found = pa.RecordBatch.from_arrays([x, y, pa.array(c)], ["x", "y", "corr"])
                yield found if at is None else found.filter(pa.array(j <= i + (at + lo)))

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("instrument"), F.lit(blocks)).cast("int")).select("instrument", "t", "i", "r", "block")
    found = _dealt(dealt, blocks, parts, []).mapInArrow(run, f"x {kind}, y {kind}, corr double")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.col("corr")).alias("corr"))


def matrix(streams: DataFrame, least: int = 3, digits: int | None = None) -> DataFrame:
    """(a, b, corr) for a <= b of the streams that have at least so many rows and vary; corr of a with itself is 1. Rounded to so many digits where these are given, in the tasks
    that multiply: there are as many rows as pairs."""
    # Only blocks are cut by these, so streams that are left out may count.
    named = streams.filter("instrument IS NOT NULL")
    n, days = (named.select(c).distinct().count() for c in ("instrument", "d"))
    return _correlated(_vectors(streams, least), n, days, digits)


def components_of(streams: DataFrame, k: int = 3, least: int = 3) -> DataFrame:
    """components(matrix(streams)), by products of days where there are more streams than days: no matrix of streams is made. There a component without variance has loadings of 0."""
    vectors = _vectors(streams, least)
    size = vectors.agg(F.count("*").alias("n"), F.max("t").alias("t")).first()
    n, days = size["n"], size["t"] or 0
    if n <= days:
        return components(_correlated(vectors, n, days), k)
    if days > MOST:
        raise ValueError(f"{days} days and {n} instruments; a matrix of more than {MOST} doesn't fit one task")
    kind = vectors.schema["instrument"].dataType.simpleString()

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row sums the streams.
        total = np.zeros((days + 1, days))
        for batch in _few(batches):
            z = _dense(batch, days)
            total[:days] += z.T @ z
            total[days] += z.sum(axis=0)
        for i in range(days + 1):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i].tobytes()], pa.binary())], ["i", "row"])

    def added(table: pa.Table) -> pa.Table:
        return pa.table([table["i"][:1], pa.array([sum(np.frombuffer(x) for x in table["row"].to_pylist()).tobytes()], pa.binary())], ["i", "row"])

    def largest(table: pa.Table) -> pa.Table:
        rows = dict(zip(table["i"].to_pylist(), table["row"].to_pylist(), strict=True))
        gram, total = np.stack([np.frombuffer(rows[i]) for i in range(days)]), np.frombuffer(rows[days])
        values, vectors = np.linalg.eigh(gram)
        best = np.argsort(-values, kind="stable")[:k]
        scaled = [vectors[:, j] / np.sqrt(values[j]) if values[j] > 1e-9 * n else np.zeros(days) for j in best]
        scaled = [w if total @ w >= 0 else -w for w in scaled]
        return pa.table([pa.array(np.arange(len(best)) + 1), pa.array(values[best] / np.trace(gram)), pa.array([w.tobytes() for w in scaled], pa.binary())], ["component", "share", "w"])

    parts = vectors.select("instrument", "i", "r").repartition(min(PARTS, -(-n // 1024)), "instrument").mapInArrow(products, "i int, row binary")
    axes = parts.groupBy("i").applyInArrow(added, "i int, row binary").groupBy().applyInArrow(largest, "component bigint, share double, w binary")
    # k short rows for all tasks.
    asked = vectors.join(F.broadcast(axes.agg(F.array_sort(F.collect_list(F.struct("component", "share", "w"))).alias("axes")))).select("instrument", "i", "r", "axes")

    def loadings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            if batch.num_rows:
                z, names = _dense(batch, days), batch.column("instrument")
                for x in batch.column("axes")[0].as_py():
                    yield pa.RecordBatch.from_arrays([pa.array([x["component"]] * len(z)), pa.array([x["share"]] * len(z)), names, pa.array(z @ np.frombuffer(x["w"]))], ["component", "share", "instrument", "loading"])

    return asked.mapInArrow(loadings, f"component bigint, share double, instrument {kind}, loading double")


def clusters_of(streams: DataFrame, cut: float = 0.3, least: int = 3) -> DataFrame:
    """clusters(matrix(streams), cut), for any number of streams; distances are told apart to twelve digits. Streams that are alike (to ten digits of their largest value) are one, as they
    join first whatever follows, and only the different ones meet. The result is made when this is called, and checkpointed: a row for each stream."""
    context = streams.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(streams.sparkSession, "clusters"))
    vectors = _vectors(streams, least)
    alike = F.sha2(F.to_json(F.struct("i", F.transform("r", lambda x: F.floor(x / F.col("top") * 1e10 + 0.5)).alias("r"))), 256)
    keyed = vectors.withColumn("_alike", alike if cut < 1 - 1e-9 else F.col("instrument").cast("string")).persist(StorageLevel.DISK_ONLY)
    try:
        first = keyed.groupBy("_alike").agg(F.min("instrument").alias("_first"))
        # Names in order, few whatever the length of history.
        ids = first.select("_first", "_alike", (F.row_number().over(Window.orderBy("_first")) - 1).alias("id")).persist()
        n, days = ids.count(), keyed.agg(F.max("t")).first()[0] or 0
        different = keyed.join(ids, keyed["instrument"] == ids["_first"]).select("id", "t", "i", "r")
        state = _linked_apart(different, ids.select("id", F.col("id").alias("cluster")), n, days, cut)
        named = state.join(ids, "id").select("_alike", "cluster").join(ids.select(F.col("id").alias("cluster"), F.col("_first").alias("_name")), "cluster")
        each = keyed.select("instrument", "_alike").join(named, "_alike").select("instrument", F.col("_name").alias("cluster"))
        done = each.join(each.groupBy("cluster").agg(F.count("*").alias("size")), "cluster").select("instrument", "cluster", "size").checkpoint()
        ids.unpersist()
    finally:
        keyed.unpersist()
    return done


def _linked_apart(different: DataFrame, state: DataFrame, n: int, days: int, cut: float) -> DataFrame:
    """(id, cluster), checkpointed: each of n streams (id, t, i, r) with the least id of its cluster, from the state in which each is its own.

    In a round every two clusters meet in one task, or in some tasks where a cluster is too large for one block. A task that has found more than its share of NEAREST keeps the nearest ones and
    says how far it knows all; up to the least of these distances the order of joining is that of all pairs, as joined clusters only come to stand farther from others."""
    blocks, parts = _blocks(n, days)
    most, large, farthest = -(-NEAREST // (blocks * parts)), max(1, n // blocks // 8), round(1 - cut, 12)

    def best(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        a, b, d = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a, d))[:most]
        return a[order], b[order], d[order]

    def groups(columns: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        cluster, pieces = (columns.column(c).to_numpy() for c in ("cluster", "pieces"))
        starts = _starts(cluster)
        return starts, cluster[starts], pieces[starts]

    def given(a: np.ndarray, b: np.ndarray, d: np.ndarray, pieces: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(d), pa.array(pieces, pa.int32())], ["a", "b", "d", "pieces"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, bound, over = [], 0, farthest, False
        for rows, mine, dense, theirs, at in _pairs(batches, parts, ["cluster", "pieces"], "cluster"):
            low = np.abs(dense @ rows.T)
            (from_x, x, of_x), (from_y, y, of_y) = groups(theirs), groups(mine)
            if len(x) < low.shape[0]:
                low = np.minimum.reduceat(low, from_x, axis=0)
            if len(y) < low.shape[1]:
                low = np.minimum.reduceat(low, from_y, axis=1)
            i, j = np.nonzero(low >= 1 - bound - 1e-11)
            d = np.round(1 - np.minimum(low[i, j], 1.0), 12)
            keep = (d <= bound) & (x[i] != y[j])
            if at is not None:
                keep &= j < i + np.searchsorted(from_y, at)
            i, j, d = i[keep], j[keep], d[keep]
            a, b, pieces = np.minimum(x[i], y[j]), np.maximum(x[i], y[j]), of_x[i] * of_y[j]
            whole = pieces == 1
            if not whole.all():
                yield given(a[~whole], b[~whole], d[~whole], pieces[~whole])
            held.append((a[whole], b[whole], d[whole]))
            size += int(whole.sum())
            if size > 2 * most:
                held, size, over = [best(held)], most, True
                bound = held[0][2][-1]
        if size > most:
            held, over = [best(held)], True
        for a, b, d in held:
            yield given(a, b, d, np.ones(len(a)))
        if over:
            # Not a pair to join, but the last one up to which all are known.
            yield given(a[-1:], b[-1:], d[-1:], np.zeros(1))

    def joined(table: pa.Table) -> pa.Table:
        old, new = joins(*(table[c].to_numpy() for c in ("a", "b", "d")))
        return pa.table([pa.array(old, pa.int32()), pa.array(new, pa.int32())], ["cluster", "into"])

    while True:
        counted = state.groupBy("cluster").agg(F.count("*").alias("size"))
        placed = state.join(counted, "cluster").select("id", "cluster", F.pmod(F.xxhash64(F.when(F.col("size") > large, F.col("id")).otherwise(F.col("cluster"))), F.lit(blocks)).cast("int").alias("block"))
        placed = placed.join(placed.groupBy("cluster").agg(F.countDistinct("block").cast("int").alias("pieces")), "cluster")
        found = _dealt(different.join(placed, "id"), blocks, parts, ["cluster"]).mapInArrow(run, "a int, b int, d double, pieces int").persist(StorageLevel.DISK_ONLY)
        last = found.filter("pieces = 0").agg(F.min(F.struct("d", "a", "b")).alias("last")).first()["last"]
        # Of a cluster in pieces the farthest two count, if all pieces are near.
        pieced = found.filter("pieces > 1").groupBy("a", "b").agg(F.max("d").alias("d"), F.count("*").alias("n"), F.first("pieces").alias("pieces")).filter("n = pieces")
        near = found.filter("pieces = 1").select("a", "b", "d").union(pieced.select("a", "b", "d"))
        if last:
            near = near.filter(F.struct("d", "a", "b") <= F.struct(*(F.lit(last[c]).cast(kind).alias(c) for c, kind in (("d", "double"), ("a", "int"), ("b", "int")))))
        moved = near.groupBy().applyInArrow(joined, "cluster int, into int").persist()
        # A checkpoint, as the plan would grow with the rounds.
        state = state.join(moved, "cluster", "left").select("id", F.coalesce("into", "cluster").alias("cluster")).checkpoint()
        for x in (found, moved):
            x.unpersist()
        if not last:
            return state


def joins(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(old, new) of clusters that join by complete linkage: a < b are apart by d, pairs that aren't given are too far. The order is that of linked(), by (d, a, b).

    Two clusters that are each other's nearest join whatever the others do, so all such pairs join at once."""
    m = int(b.max()) + 1 if len(b) else 0
    of = np.arange(m)
    while len(a):
        order = np.lexsort((b, a, d))
        a, b, d = a[order], b[order], d[order]
        nearest, place = np.full(m, len(a)), np.arange(len(a))
        for side in (a, b):
            np.minimum.at(nearest, side, place)
        both = np.flatnonzero((nearest[a] == place) & (nearest[b] == place))
        to, parts = np.arange(m), np.ones(m, int)
        to[b[both]], parts[a[both]] = a[both], 2
        of = to[of]
        a, b = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        apart = a != b
        key, d = a[apart].astype(np.int64) * m + b[apart], d[apart]
        order = np.lexsort((d, key))
        key, d = key[order], d[order]
        starts = _starts(key)
        ends = np.append(starts[1:], len(key))
        a, b = key[starts] // m, key[starts] % m
        # Every two parts must be near.
        near = ends - starts == parts[a] * parts[b]
        a, b, d = a[near], b[near], d[ends[near] - 1]
    old = np.flatnonzero(of != np.arange(m))
    return old, of[old]


def _square(table: pa.Table) -> tuple[list, np.ndarray]:
    names = sorted(set(table["a"].to_pylist()))
    if len(names) > MOST:
        raise ValueError(f"{len(names)} instruments; a matrix of more than {MOST} doesn't fit one task")
    of = {x: i for i, x in enumerate(names)}
    a, b = (np.array([of[x] for x in table[k].to_pylist()]) for k in "ab")
    out = np.zeros((len(names), len(names)))
    out[a, b] = out[b, a] = table["corr"].to_numpy()
    return names, out


def linked(distance: np.ndarray, cut: float) -> np.ndarray:
    """The cluster of each row, by its first member: the two clusters whose farthest members are nearest join, first ones first, as long as these are within cut."""
    n = len(distance)
    far, of, live = distance.astype(float).copy(), np.arange(n), np.ones(n, bool)
    far[np.tril_indices(n)] = np.inf
    nearest = far.min(axis=1) if n else far
    # Distances only grow, so a row's old minimum is a bound: it is computed anew only when it is the least of all.
    while live.sum() > 1:
        a = int(np.argmin(nearest))
        if not nearest[a] <= cut:
            break
        b = int(np.argmin(far[a]))
        if far[a, b] > nearest[a]:
            nearest[a] = far[a, b]
            continue
        of[of == b] = a
        live[b] = False
        # Distance of the joined cluster to each other one: the larger of both, kept above the diagonal.
        row = np.maximum(np.where(np.arange(n) < a, far[:, a], far[a]), np.where(np.arange(n) < b, far[:, b], far[b]))
        row[~live] = np.inf
        row[a] = np.inf
        far[a, a + 1 :], far[:a, a] = row[a + 1 :], row[:a]
        far[b, :], far[:, b] = np.inf, np.inf
        nearest[a], nearest[b] = far[a].min(), np.inf
    return of


def components(correlated: DataFrame, k: int = 3) -> DataFrame:
    """(component, share, instrument, loading): the k largest components of a matrix (a, b, corr), how much of the variance each explains, and unit loadings whose sum isn't negative."""
    kind = correlated.schema["a"].dataType.simpleString()

    def of(table: pa.Table) -> pa.Table:
        names, c = _square(table)
        values, vectors = np.linalg.eigh(c)
        best = np.argsort(-values, kind="stable")[:k]
        rows = [(i + 1, values[j] / values.sum(), names[m], vectors[m, j] * (1 if vectors[:, j].sum() >= 0 else -1)) for i, j in enumerate(best) for m in range(len(names))]
        return pa.table([pa.array(x) for x in zip(*rows, strict=True)], ["component", "share", "instrument", "loading"])

    return correlated.groupBy().applyInArrow(of, f"component bigint, share double, instrument {kind}, loading double")


def clusters(correlated: DataFrame, least: float = 0.3) -> DataFrame:
    """(instrument, cluster, size): clusters, named by their first member, all of whose members have absolute correlations of at least so much."""
    kind = correlated.schema["a"].dataType.simpleString()

    def of(table: pa.Table) -> pa.Table:
        names, c = _square(table)
        group = linked(1 - np.abs(c), 1 - least)
        size = np.bincount(group, minlength=len(names))
        return pa.table([pa.array(names, table.schema.field("a").type), pa.array([names[g] for g in group], table.schema.field("a").type), pa.array(size[group])], ["instrument", "cluster", "size"])

    return correlated.groupBy().applyInArrow(of, f"instrument {kind}, cluster {kind}, size bigint")
