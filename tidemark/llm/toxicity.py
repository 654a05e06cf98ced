"""Toxicity from two interpolated Kneser-Ney models of word pairs, one of toxic and one of ordinary text.

Every count is a continuation count: in how many different documents something stands, however often in each. A class gives
a word w after a word h

    P(w | h) = kept(h w) / N(h)  + free(h)  * P(w)
    P(w)     = kept(w) / N       + free     * P(stem of w) * share of w among the words of its stem
    P(stem)  = kept(stem) / N    + free'    * share of the stem

with N and N(h) the sums of the class's counts, and what is free the rest of the mass. The shares are backoff counts that both
classes have in common, taken from the whole corpus, labelled or not. What a class keeps of a count n is

    kept = max(n - DISCOUNT - TOLERANCE * E, 0)

an absolute discount and some times the number E that backoff alone would let one expect (for a pair, the class's N(h) shared
out as in the corpus). So a rare expression that happens to stand in one class weighs nothing, one of an unknown form
of a known stem weighs as its stem, and a language or topic that a class has somewhat more of moves all words of both
classes to the same backoff. A text's evidence is its log-likelihood under the toxic model less that under the
ordinary one, divided by the number of its words; a logistic curve, fitted on labelled rows that the models haven't
counted, makes it a probability.

Words are runs of ASCII letters, digits and bytes of other characters, in lower case, known by 64-bit hashes; a stem is the first ``STEM``
characters of a word. The models are fitted on at most ``MAX_DOCS`` documents of each class (a third more for the curve); only what a class has
in more than DISCOUNT of these is collected and broadcast, which that bounds. The shared counts cover every row of the corpus, and so does
the score, whole texts always.

Defined results: null and empty texts have evidence 0 and that point's score; labels that are null or contradict each other,
or whose text is null, teach nothing; without one of the classes every score is the share of toxic labels (0.5 without labels).
Repeated rows count as often as they occur and each get their row. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, crc_mod, documents, mix, pieces, table, word_hashes, word_spans
from tidemark.llm.quality import labelled_sample, logistic

#: Labelled documents of each class that the models count.
MAX_DOCS = 4000
#: Every fourth labelled document fits the curve instead.
CURVE_SHARE = 4
STEM = 6
DISCOUNT = 3.0
TOLERANCE = 2.0

_APART = np.ones(256, dtype=bool)
_APART[list(range(ord("0"), ord("9") + 1)) + list(range(ord("a"), ord("z") + 1)) + list(range(0x80, 0x100))] = False
#: What stands before the first word of a text.
_BEGIN = np.uint64(0x243F6A8885A308D3)
_PAIR = np.uint64(0x9E3779B97F4A7C15)

WORD, STEMS, PAIR = 0, 1, 2


def expressions(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of its stem, hash of the word before it, first word of each row and the end)."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, _APART)
    begins = np.flatnonzero((low & 0xC0) != 0x80)
    stop = np.searchsorted(begins, starts, side="right") - 1 + STEM
    words = word_hashes(low, starts, ends)
    stems = ~word_hashes(low, starts, np.minimum(ends, np.append(begins, len(low))[np.minimum(stop, len(begins))]))
    before = np.concatenate([[_BEGIN], words[:-1]]) if len(words) else words
    before[first[:-1][np.diff(first) > 0]] = _BEGIN
    return words, stems, before, first


def pairs(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(before * _PAIR ^ words)


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, len(keys) where absent."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


class Table:
    """Sorted hashes with a value each; 0, or another value, for all others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float = 0.0) -> None:
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.append(values[order], other)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        return self.values[_find(self.keys, wanted)]

    def has(self, wanted: np.ndarray) -> np.ndarray:
        return _find(self.keys, wanted) < len(self.keys)


class Model:
    """Log ratios of the toxic by the ordinary probability: of words, of the stems of others, of what a word before leaves free, of pairs."""

    def __init__(self, words: Table, stems: Table, contexts: Table, pair: Table, curve: tuple[float, float, float, float]) -> None:
        self.words, self.stems, self.contexts, self.pair, self.curve = words, stems, contexts, pair, curve

    def evidence(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The mean log ratio of the words of each row."""
        out = np.zeros(len(offs) - 1)
        word, stem, before, first = expressions(data, offs)
        if not len(word):
            return out
        known = _find(self.words.keys, word)
        gain = self.words.values[known]
        others = np.flatnonzero(known == len(self.words.keys))
        gain[others] = self.stems(stem[others])
        context = _find(self.contexts.keys, before)
        gain += self.contexts.values[context]
        some = np.flatnonzero(context < len(self.contexts.keys))
        place = _find(self.pair.keys, pairs(before[some], word[some]))
        there = place < len(self.pair.keys)
        gain[some[there]] = self.pair.values[place[there]]
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        n = np.diff(first)
        full = n > 0
        out[full] = (sums[first[1:]] - sums[first[:-1]])[full] / n[full]
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        a, b, centre, spread = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.clip((evidence - centre) / spread, -12, 12), -30, 30)))


def _once_a_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places of the first of each equal (row, hash)."""
    at = np.lexsort((hashes, row))
    new = np.ones(len(at), dtype=bool)
    new[1:] = (hashes[at][1:] != hashes[at][:-1]) | (row[at][1:] != row[at][:-1])
    return at[new]


def class_counts(sample: DataFrame) -> DataFrame:
    """(kind, key, of, last, n0, n1) of the documents of each class (text, _label): how many have each word (of: its stem), how many different
    words of each have each stem, summed, and how many have each pair (of: the word before, last: the other)."""
    names, kinds = ["kind", "key", "of", "last", "n0", "n1"], "kind int, key bigint, of bigint, last bigint, n0 bigint, n1 bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column("_label").to_numpy(zero_copy_only=False)
            for lo, hi, data, offs in pieces(batch.column("text"), 4 << 20):
                word, stem, before, first = expressions(data, offs)
                row = np.repeat(np.arange(hi - lo), np.diff(first))
                once, both = _once_a_row(word, row), pairs(before, word)
                twice = _once_a_row(both, row)
                for kind, key, of, last, rows in ((WORD, word[once], stem[once], word[once], row[once]), (STEMS, stem[once], stem[once], stem[once], row[once]), (PAIR, both[twice], before[twice], word[twice], row[twice])):
                    got, at, slot = np.unique(key, return_index=True, return_inverse=True)
                    n = [np.bincount(slot, weights=labels[lo:hi][rows] == c, minlength=len(got)).astype(np.int64) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), kind, np.int32)), pa.array(got.view(np.int64)), *[pa.array(x[at].view(np.int64)) for x in (of, last)], pa.array(n[0]), pa.array(n[1])], names)

    counted = sample.select("text", F.col("_label").cast("int").alias("_label")).mapInArrow(run, kinds)
    return counted.groupBy("kind", "key", "of", "last").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_counts(corpus: DataFrame, known: list[np.ndarray]) -> list[np.ndarray]:
    """Documents of the corpus (text) that have each of the known words, different words of each with each of the known stems, documents with
    each of the known pairs, and different pairs of each after each of the known words before; sorted hashes. Each with the sum of all others at the end."""
    shared = corpus.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, stems, both, contexts = shared.value
        counts = [np.zeros(len(k) + 1, dtype=np.int64) for k in shared.value]
        for batch in batches:
            for _, _, data, offs in pieces(batch.column("text"), 4 << 20):
                word, stem, before, first = expressions(data, offs)
                row = np.repeat(np.arange(len(first) - 1), np.diff(first))
                once = _once_a_row(word, row)
                counts[0] += np.bincount(_find(words, word[once]), minlength=len(words) + 1)
                counts[1] += np.bincount(_find(stems, stem[once]), minlength=len(stems) + 1)
                context = _find(contexts, before)
                some = np.flatnonzero(context < len(contexts))
                pair = pairs(before[some], word[some])
                twice = _once_a_row(pair, row[some])
                counts[2] += np.bincount(_find(both, pair[twice]), minlength=len(both) + 1)
                counts[3] += np.bincount(context[some[twice]], minlength=len(contexts) + 1)
        for kind, n in enumerate(counts):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[some])], ["kind", "place", "n"])

    found = corpus.select("text").mapInArrow(run, "kind int, place bigint, n bigint").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    kind, place, n = (found[c].to_numpy() for c in ("kind", "place", "n"))
    out = [np.zeros(len(k) + 1) for k in known]
    for i, counts in enumerate(out):
        counts[place[kind == i]] = n[kind == i]
    return out


def _kept(n: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return np.maximum(n - DISCOUNT - TOLERANCE * expected, 0)


def ratios(found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], sums: np.ndarray, contexts: np.ndarray, context_sums: np.ndarray, shared: list[np.ndarray]) -> tuple[Table, Table, Table, Table]:
    """The model's tables. found: by kind (sorted keys, of, counts of both classes, last), of what a class has more than DISCOUNT times; sums: N of both classes;
    contexts, context_sums: the words before of the pairs found, sorted, with N(h) of both classes; shared: of ``shared_counts``."""
    (words, stem_of, n_word, _), (stems, _, n_stem, _), (both, before, n_pair, second) = (found[k] for k in (WORD, STEMS, PAIR))
    # What the model has counted the corpus has too; all that it hasn't may be nothing, and then weighs nothing.
    in_corpus, of_stem, of_pair, of_context = (np.append(np.maximum(x[:-1], 0.1), max(x[-1], 1e-12)) for x in shared)
    stem_share = of_stem / of_stem.sum()
    at_stem, at_context = _find(stems, stem_of), _find(contexts, before)
    p_stem, p_word, free, p_pair, left = [], [], [], [], []
    for c in (0, 1):
        n = max(float(sums[c]), 1.0)
        kept = np.append(_kept(n_stem[c], n * stem_share[:-1]), 0.0)
        p_stem.append(kept / n + (1 - kept.sum() / n) * stem_share)
        backoff = p_stem[c][at_stem] * np.minimum(in_corpus[:-1] / of_stem[at_stem], 1.0)
        kept = _kept(n_word[c], n * backoff)
        free.append(1 - kept.sum() / n)
        p_word.append(kept / n + free[c] * backoff)
        below = np.maximum(context_sums[c], 1.0)
        kept = _kept(n_pair[c], context_sums[c][at_context] * of_pair[:-1] / of_context[at_context])
        left.append(1 - np.bincount(at_context, weights=kept, minlength=len(contexts)) / below)
        p_pair.append(kept / below[at_context])
    second = _find(words, second)
    some = np.flatnonzero((p_pair[0] > 0) | (p_pair[1] > 0))
    full = [p_pair[c][some] + left[c][at_context[some]] * p_word[c][second[some]] for c in (0, 1)]
    held = np.unique(at_context[some])
    stem_gain = np.log(free[1] * p_stem[1]) - np.log(free[0] * p_stem[0])
    return (
        Table(words, np.log(p_word[1]) - np.log(p_word[0])),
        Table(stems, stem_gain[:-1], float(stem_gain[-1])),
        Table(contexts[held], np.log(left[1][held]) - np.log(left[0][held])),
        Table(both[some], np.log(full[1]) - np.log(full[0])),
    )


def fit(docs: DataFrame, labels: DataFrame, corpus: DataFrame, label: str = "toxic", key: str = "doc_id") -> Model:
    """Learns from the rows of docs that labels names, and takes the shared counts from corpus, which has these rows too."""
    none = Table(np.zeros(0, np.uint64), np.zeros(0))
    per_class = MAX_DOCS * CURVE_SHARE // (CURVE_SHARE - 1)
    sample = labelled_sample(docs, labels, label, per_class, key).withColumn("_curve", F.pmod(F.xxhash64(F.lit(11), F.col(key)), F.lit(CURVE_SHARE)) == 0).persist(StorageLevel.MEMORY_AND_DISK)
    rows = {r["_label"]: r["n"] for r in sample.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        sample.unpersist()
        share = min(max(rows.get(1, 0) / sum(rows.values()), 1e-3), 1 - 1e-3) if rows else 0.5
        return Model(none, none, none, none, (math.log(share / (1 - share)), 0.0, 0.0, 1.0))
    counted = class_counts(sample.filter(~F.col("_curve"))).persist(StorageLevel.MEMORY_AND_DISK)
    often = (F.col("n0") > DISCOUNT) | (F.col("n1") > DISCOUNT)
    total = counted.filter(F.col("kind") == WORD).agg(F.sum("n0"), F.sum("n1")).first()
    rare = counted.filter(often).toArrow()
    kind, keys, of, last = rare["kind"].to_numpy(), *(rare[c].to_numpy().view(np.uint64) for c in ("key", "of", "last"))
    n = np.stack([rare[f"n{c}"].to_numpy().astype(float) for c in (0, 1)])
    found = {}
    for k in (WORD, STEMS, PAIR):
        order = np.flatnonzero(kind == k)[np.argsort(keys[kind == k])]
        found[k] = (keys[order], of[order], n[:, order], last[order])
    before = counted.filter((F.col("kind") == PAIR) & often).select("of").distinct()
    by_context = counted.filter(F.col("kind") == PAIR).join(before, "of", "left_semi").groupBy("of").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    contexts = by_context["of"].to_numpy().view(np.uint64)
    order = np.argsort(contexts)
    contexts, context_sums = contexts[order], np.stack([by_context[f"n{c}"].to_numpy().astype(float)[order] for c in (0, 1)])
    shared = shared_counts(corpus, [found[WORD][0], found[STEMS][0], found[PAIR][0], contexts])
    counted.unpersist()
    model = Model(*ratios(found, np.array([float(x or 0) for x in total]), contexts, context_sums, shared), (0.0, 1.0, 0.0, 1.0))
    # The curve, on what the models haven't counted.
    held = measured(sample.filter("_curve"), model, key, ["_label"]).select("evidence", "_label").toPandas()
    sample.unpersist()
    if held["_label"].nunique() == 2:
        e, y = held["evidence"].to_numpy(), held["_label"].to_numpy(float)
        centre, spread = float(np.median(e)), float(e.std() + 1e-9)
        weights = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        a, b = logistic(np.column_stack([np.ones(len(e)), np.clip((e - centre) / spread, -12, 12)]), y, weights)
        model.curve = (float(a), float(b), centre, spread)
    else:
        model.curve = (0.0, 50.0, 0.0, 1.0)
    return model


def measured(docs: DataFrame, model: Model, key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row per row of docs: key, the kept columns, score and evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [key, *(keep or [])]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            evidence = np.zeros(batch.num_rows)
            for lo, hi, data, offs in pieces(batch.column("text")):
                evidence[lo:hi] = model.evidence(data, offs)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(model.scores(evidence)), pa.array(evidence)], [*names, "score", "evidence"])

    return docs.select(*dict.fromkeys([*names, "text"])).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", score double, evidence double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity; labels of four fifths of the keys are learnt from."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held = crc_mod("doc_id", 5) == 0
    model = fit(docs.filter(~held), labels.filter(~held), docs)
    return measured(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
