"""Quality classifier: texts compressed with dictionaries of good and of bad labelled text.

Two Zstandard dictionaries are trained, one on good and one on bad labelled texts, whole ones. A text that a dictionary
knows compresses better with it. The evidence for a text is

    difference = (bytes with the bad dictionary - bytes with the good one) / bytes of the text

of every part of at most ``PART`` bytes, summed over the whole text, since a dictionary
serves the beginning of a frame best. A logistic curve of nothing but the difference, fitted on labelled rows that are in neither
dictionary, each class weighing as much as it has labels, turns it into a probability.

Defined results: null and empty texts have difference 0 and get the score of that point;
labels that are null or contradict each other, or of documents with null text, teach nothing; with no label of one class
every score is the share of good labels (0.5 without any label), 0.5 counting as 1. Where there is too little text to
train a dictionary on, the texts themselves are the dictionary. Repeated rows each get their row. Other columns of the inputs are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, documents, pieces, table

#: Bounds of the sample that is fitted on: labelled documents of each class for the dictionary, and for the curve.
MAX_DICTIONARY_DOCS = 400
MAX_CURVE_DOCS = 1500
#: Bytes of whole texts that a dictionary is trained on at most; a text that would go beyond is left to the curve.
MAX_DICTIONARY_TEXT = 8 << 20
DICTIONARY_BYTES = 64 << 10
#: Length of the segments that training picks, and of the pieces by which it rates them.
SEGMENT, PIECE = 1000, 8
#: Bytes of a text that are compressed in one frame.
PART = 1024
LEVEL = 3


class Dictionaries:
    """The compressors with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = (self._compressor(x) for x in (good, bad))

    @staticmethod
    def _compressor(data: bytes) -> zstd.ZstdCompressor:
        known = zstd.ZstdCompressionDict(data, dict_type=zstd.DICT_TYPE_AUTO)
        known.precompute_compress(level=LEVEL)
        return zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def difference(self, text: bytes) -> float:
        """Of a whole text."""
        found = 0
        for part in _parts(text):
            found += len(self.bad.compress(part)) - len(self.good.compress(part))
        return found / max(len(text), 1)


def _parts(text: bytes) -> Iterator[bytes]:
    for at in range(0, len(text), PART):
        yield text[at : at + PART]


def trained(texts: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of whole texts, given to the training in parts; of too little text, the text itself."""
    try:
        return zstd.train_dictionary(size, [p for t in texts for p in _parts(t)], k=SEGMENT, d=PIECE, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[:size] + b"\n" * 8


def alike(good: list[bytes], bad: list[bytes]) -> tuple[bytes, bytes]:
    """Dictionaries of both, of about the same size: a larger one compresses better whatever it knows."""
    both = [trained(x) for x in (good, bad)]
    least = max(min(map(len, both)), 2048)
    return tuple(trained(x, least) if len(known) > least else known for x, known in zip((good, bad), both, strict=True))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a weighted logistic regression by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


class Model:
    """Dictionaries with the curve's level, slope, centre and spread; plain data, sent to the tasks once."""

    def __init__(self, good: bytes, bad: bytes, curve: tuple[float, float, float, float]) -> None:
        self.good, self.bad, self.curve = good, bad, curve

    def scores(self, difference: np.ndarray) -> np.ndarray:
        level, slope, centre, spread = self.curve
        return 1 / (1 + np.exp(-np.clip(level + slope * np.clip((difference - centre) / spread, -6, 6), -30, 30)))


def known_labels(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """(key, _label) of the keys that have one label."""
    return labels.filter(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias("_label"), F.min(label).alias("_least")).filter(F.col("_label") == F.col("_least")).drop("_least")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """per_class documents of each class at most, by the order of a hash of their keys.

    The rows are (key, text, _label), the text whole. Keys without a label or with both, and null labels and texts, are left out.
    """
    first = known_labels(labels, label, key)
    known = docs.filter(F.col("text").isNotNull()).select(key, "text")
    picked = [
        first.filter(F.col("_label") == c).orderBy(F.xxhash64(F.lit(7), F.col(key)), F.col(key)).limit(per_class) for c in (0, 1)
    ]
    few = picked[0].unionByName(picked[1])
    return known.join(F.broadcast(few), key).select(key, "text", "_label")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id") -> Model:
    """Fits on a bounded sample of the rows of labels: the first of it train the dictionaries, the rest fit the curve.

    Only the texts of the dictionaries reach the driver, MAX_DICTIONARY_TEXT of each class at most; the curve's
    differences are taken of whole texts, in the tasks.
    """
    n = MAX_DICTIONARY_DOCS + MAX_CURVE_DOCS
    sample = labelled_sample(docs, labels, label, n, key).withColumns({"_order": F.xxhash64(F.lit(7), F.col(key)), "_size": F.octet_length("text")}).persist(StorageLevel.MEMORY_AND_DISK)
    sizes: dict[int, list[tuple[int, int]]] = {0: [], 1: []}
    for r in sample.select("_label", "_order", "_size").collect():
        sizes[int(r["_label"])].append((r["_order"], r["_size"]))
    every = {c: len(x) for c, x in sizes.items()}
    if not every[0] or not every[1]:
        sample.unpersist()
        share = min(max(every[1] / sum(every.values()), 1e-3), 1 - 1e-3) if sum(every.values()) else 0.5
        return Model(b"\n" * 8, b"\n" * 8, (math.log(share / (1 - share)), 0.0, 0.0, 1.0))
    # Equally many texts of either class, and at least one left for the curve where there are two.
    many = max(1, min(MAX_DICTIONARY_DOCS, *(x // 2 for x in every.values())))
    chosen = []
    for c, rows in sizes.items():
        left = MAX_DICTIONARY_TEXT
        for order, size in sorted(rows)[:many]:
            if size <= left:
                chosen.append((c, order))
                left -= size
    few = sample.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "_label int, _order bigint")), ["_label", "_order"], "left_semi") if chosen else sample.limit(0)
    texts = sorted((r["_order"], r["_label"], r["text"].encode()) for r in few.select("_order", "_label", "text").collect())
    good, bad = alike(*([t for _, c, t in texts if c == wanted] for wanted in (1, 0)))
    rest = sample.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "_label int, _order bigint")), ["_label", "_order"], "left_anti") if chosen else sample
    if rest.select("_label").distinct().count() < 2:
        rest = sample
    found = score(rest, Model(good, bad, (0.0, 0.0, 0.0, 1.0)), key, ["_label"]).select("difference", "_label").toPandas()
    sample.unpersist()
    x, y = found["difference"].to_numpy(), found["_label"].to_numpy(float)
    centre, spread = float(x.mean()), float(x.std()) + 1e-6
    share = {int(r["_label"]): r["n"] for r in known_labels(labels, label, key).groupBy("_label").agg(F.count("*").alias("n")).collect()}
    weight = np.where(y == 1, share[1] / y.sum(), share[0] / (len(y) - y.sum()))
    z = np.clip((x - centre) / spread, -6, 6)
    level, slope = logistic(np.column_stack([np.ones(len(z)), z]), y, weight * len(y) / weight.sum())
    return Model(good, bad, (float(level), float(slope), centre, spread))


def _differences(column: pa.Array, both: Dictionaries) -> np.ndarray:
    found = np.zeros(len(column))
    for lo, hi, data, offs in pieces(column):
        raw = data.tobytes()
        for i in range(lo, hi):
            found[i] = both.difference(raw[offs[i - lo] : offs[i - lo + 1]])
    return found


def score(docs: DataFrame, model: Model, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: key (and the columns in keep), score and difference."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, *[c for c in keep or [] if c != key]]
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in names) + ", score double, difference double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        both = Dictionaries(model.good, model.bad)
        for batch in batches:
            found = _differences(batch.column("text"), both)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(model.scores(found)), pa.array(found)], [*names, "score", "difference"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text's score is at least so much, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        both = Dictionaries(model.good, model.bad)
        for batch in batches:
            yield batch.filter(pa.array(model.scores(_differences(batch.column("text"), both)) >= least))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score; labels of two thirds of the keys are learnt from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs.filter(~held), labels.filter(~held))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference")
