"""Language identification by prediction by partial matching over bytes.

For each language a context tree of variable order is counted from the labelled texts: how
often each byte follows each context of at most ``ORDER`` bytes. A byte is coded in the longest
context that the language has seen, or after escapes in shorter ones (method C: a context seen n times
with d different bytes gives a byte of count c the probability c / (n + d), and
the escape d / (n + d)), at last uniformly over the alphabet. The statistics are frozen, so
the exact code length of a byte depends only on the context and the byte: it is
tabulated once for every context, and a text's code length in each language is a sum of table entries.

Texts are folded first: lower case, and each run of ASCII characters that are not letters
is one blank. Every byte of the whole text counts.

Defined results: a text that is null or has no letter gets ``und`` and score 0, as every text does
when nothing was learnt. Rows with null text or null lang teach nothing. A tie goes to the language
that sorts first. Repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, documents, pieces

#: Longest context in bytes.
ORDER = 3
#: A context of the longest order is kept where the languages have seen it as often as this together.
MIN_CONTEXT = 16
#: Bytes that texts have after folding: the blank, a to z, and those of multi-byte characters.
BLANK = 0x20
_ALPHABET = np.array([BLANK, *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)], dtype=np.uint8)
SIZE = len(_ALPHABET)
_CODE = np.zeros(256, dtype=np.int32)
_CODE[_ALPHABET] = np.arange(SIZE)
_CODE[ord("A") : ord("Z") + 1] = _CODE[ord("a") : ord("z") + 1]


def folded(data: np.ndarray, offs: np.ndarray, table: np.ndarray = _CODE) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the folded rows, each with one blank before it, and their offsets."""
    codes = table[data]
    blank = codes == 0
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    full = offs[:-1] < offs[1:]
    at = offs[:-1][full]
    keep[at] = ~blank[at]
    ends = np.concatenate([[0], np.cumsum(keep)])[offs]
    lengths = np.diff(ends) + 1
    out_offs = np.concatenate([[0], np.cumsum(lengths)])
    out = np.zeros(out_offs[-1], dtype=np.int32)
    place = np.flatnonzero(keep)
    row = np.searchsorted(offs, place, side="right") - 1
    out[np.arange(len(place)) + row + 1] = codes[place]
    return out, out_offs


def grams(codes: np.ndarray, offs: np.ndarray, size: int = SIZE) -> np.ndarray:
    """For each byte but a row's first blank: the context of ORDER codes before it and itself, as one number.

    What lies before a row counts as blanks.
    """
    key = codes.astype(np.int64)
    index = np.arange(len(codes))
    since = index - np.repeat(offs[:-1], np.diff(offs))
    for back in range(1, ORDER + 1):
        before = np.zeros(len(codes), dtype=np.int64)
        before[back:] = codes[:-back]
        before[since < back] = 0
        key += before * size**back
    return key[since > 0]


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over every byte of docs (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column("lang")
            for name in pc.unique(lang).to_pylist():
                texts = batch.column("text").filter(pc.equal(lang, name))
                for _, _, data, offs in pieces(pc.utf8_lower(texts), 4 << 20):
                    gram, n = np.unique(grams(*folded(data, offs)), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """langs; codes: the code of each byte; states: the state of each context of ORDER codes, which is its
    longest known suffix; bits[state, code, language]: exact code lengths."""

    def __init__(self, langs: list[str], codes: np.ndarray, states: np.ndarray, bits: np.ndarray) -> None:
        self.langs, self.codes, self.states, self.bits = langs, codes, states, bits

    def lengths(self, codes: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Code length in bits of each row of folded codes in each language."""
        out = np.zeros((len(offs) - 1, len(self.langs)))
        if not len(codes):
            return out
        size = self.bits.shape[1]
        gram = grams(codes, offs, size)
        context = gram // size
        cost = self.bits[self.states[context], gram - context * size]
        sums = np.concatenate([np.zeros((1, cost.shape[1])), np.cumsum(cost, axis=0, dtype=np.float64)])
        ends = offs - np.arange(len(offs))
        return sums[ends[1:]] - sums[ends[:-1]]


def _frozen(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Method C: (probability of each seen code, escape) for rows of counts of contexts."""
    total, kinds = counts.sum(axis=-1), (counts > 0).sum(axis=-1)
    below = np.maximum(total + kinds, 1)
    return counts / below[..., None], np.where(total > 0, kinds / below, 1.0)


def _compact(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[list[tuple[str, np.ndarray, np.ndarray]], np.ndarray, int]:
    """The grams over the codes that occur, with one more code for all others."""
    used = np.zeros(SIZE, dtype=bool)
    used[:27] = True
    for _, gram, _ in rows:
        used[np.unique(gram % SIZE)] = True
    size = int(used.sum()) + 1
    new = np.full(SIZE, size - 1, dtype=np.int64)
    new[used] = np.arange(size - 1)
    out = [(lang, sum(new[(gram // SIZE**o) % SIZE] * size**o for o in range(ORDER + 1)), n) for lang, gram, n in rows]
    return out, new[_CODE].astype(np.int32), size


def build(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """rows: (language, grams, counts). Tabulates exact code lengths for the contexts that occur."""
    langs = [r[0] for r in rows]
    if not rows:
        return Model([], _CODE, np.zeros(0, np.int32), np.zeros((0, SIZE, 0), np.float32))
    rows, codes, size = _compact(rows)
    context, place = np.unique(np.concatenate([g // size for _, g, _ in rows]), return_inverse=True)
    seen = np.bincount(place, weights=np.concatenate([n for _, _, n in rows]), minlength=len(context))
    keys, shorter, p = np.zeros(1, np.int64), np.zeros(1, np.int64), np.full((len(langs), 1, size), 1.0 / size)
    states, tables, at = np.zeros(size**ORDER, dtype=np.int32), [], 0
    every = np.arange(size**ORDER)
    for order in range(ORDER + 1):
        keys = context[seen >= MIN_CONTEXT] if order == ORDER else np.unique(context % size**order)
        up = np.searchsorted(shorter, keys % size ** (order - 1)) if order else np.zeros(len(keys), np.int64)
        now = np.empty((len(langs), len(keys), size))
        for i, (_, gram, n) in enumerate(rows):
            short = gram % size ** (order + 1)
            slot = np.searchsorted(keys, short // size)
            good = slot < len(keys)
            good[good] = keys[slot[good]] == short[good] // size
            counts = np.bincount(slot[good] * size + (short % size)[good], weights=n[good], minlength=len(keys) * size).reshape(len(keys), size)
            likely, escape = _frozen(counts)
            now[i] = np.where(counts > 0, likely, escape[:, None] * p[i][up])
        slot = np.searchsorted(keys, every % size**order)
        good = slot < len(keys)
        good[good] = keys[slot[good]] == (every % size**order)[good]
        states[good] = at + slot[good]
        tables.append(-np.log2(np.maximum(now, 1e-12)).transpose(1, 2, 0).astype(np.float32))
        at += len(keys)
        shorter, p = keys, now
    return Model(langs, codes, states, np.concatenate(tables))


def fit(docs: DataFrame) -> Model:
    """Learns from every row of docs (text, lang). The counts per language that reach the driver are
    bounded by the number of different runs of ORDER + 1 bytes that the languages' letters form."""
    counts = count_grams(docs).toArrow()
    lang, gram, n = counts["lang"].to_pandas().to_numpy(), counts["gram"].to_numpy(), counts["n"].to_numpy()
    return build([(name, gram[lang == name], n[lang == name]) for name in sorted(set(lang))])


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score, bits) for every row of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n = batch.num_rows
            text = batch.column("text")
            best, score, bits = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            letters = np.zeros(n, bool)
            for lo, hi, data, offs in pieces(pc.utf8_lower(text)):
                codes, at = folded(data, offs, model.codes)
                plain = np.concatenate([[0], np.cumsum((codes > 0) & (codes < 27))])
                letters[lo:hi] = plain[at[1:]] > plain[at[:-1]]
                if model.langs:
                    got = model.lengths(codes, at)
                    best[lo:hi] = got.argmin(axis=1)
                    least = got.min(axis=1)
                    bits[lo:hi] = least
                    score[lo:hi] = 1 / np.exp2(np.maximum(least[:, None] - got, -60)).sum(axis=1)
            for i in np.flatnonzero(~letters):
                letters[i] = _has_letter(text[int(i)].as_py() or "")
            und = ~letters if model.langs else np.ones(n, bool)
            names = np.array([*model.langs, "und"], dtype=object)
            best[und] = len(model.langs)
            score[und] = 0.0
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits)], [key, "lang_pred", "score", "bits"])

    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, bits double")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language, learnt from two thirds of the keys."""
    docs = documents(spark, sf_dir)
    held = crc_mod("doc_id", 3) == 1
    model = fit(docs.filter(~held).select("text", "lang"))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "bits")
