"""Source divergence audit: how far the words of each source are from those of other sources and of the whole language.

1. Tokens. A table of 256 entries says which bytes belong to terms (letters of ASCII and all bytes from 0x80). Applied to the bytes of a run of texts at once it gives where
   terms begin and end. Lower-cased slices are hashed (xxh3) and grouped by hash, and all bytes of each slice are compared with those of its group's first; groups
   of unequal slices are split by their bytes. A matrix of documents by terms in compressed rows then gives counts and document frequencies per (lang, source).
2. Spark adds up the counts per (lang, source, term), then the sources of each (lang, term), and keeps terms of at least ``MIN_DOCS`` documents. The table of kept terms is written.
3. It is dealt out in slices of about ``SLICE_TERMS`` terms of a language, each with the totals of all sources of the language. In a slice a matrix of sources by
   terms in compressed rows gives the pair sums, by reduceat over its rows: terms that neither source has add the same amount each, those that one has are corrected for.
   Spark adds up the slices' sums. Each slice hands on no more than ``TOP`` terms of a source.

All arithmetic is in whole numbers: shares by long division in 64 bits, exact for sums below 9 * 10^15.

Defined results: null text, lang and source are ''. A language without kept terms has pair rows of value 0; a source alone in its language has no pair rows, a group none of
whose terms stand out no term rows; a table without rows gives none. Repeated rows count as documents of their own; nothing but the three columns is read. Very long texts are taken in
blocks cut between terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, documents, pieces, word_spans, written

MIN_DOCS = 3
#: Ranks of terms that are reported.
TOP = 200
SCALE = 1_000_000_000
#: Kept terms of a slice, about.
SLICE_TERMS = 8192
#: Bytes of texts that are cut into terms at once.
RUN = 4 << 20
#: Cells of a matrix that are computed at once.
CELLS = 1 << 20

#: Bytes that stand between terms: control characters, space, digits and punctuation of ASCII.
APART = np.ones(256, dtype=bool)
APART[0x41:0x5B] = APART[0x61:0x7B] = APART[0x80:] = False


# Tokens ------------------------------------------------------------------------------------------


def grouped_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms. Slices are grouped by digest; each is compared with its group's first, byte by byte."""
    whole = data.tobytes()
    hashes = np.fromiter((digest(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    size = ends - starts
    unequal = size != size[first[term]]
    same = np.flatnonzero(~unequal)
    if len(same):
        begin = np.concatenate([[0], np.cumsum(size[same])])
        inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size[same])
        differs = data[np.repeat(starts[same], size[same]) + inside] != data[np.repeat(starts[first[term[same]]], size[same]) + inside]
        unequal[same] = np.add.reduceat(differs, begin[:-1]) > 0
    terms = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    if unequal.any():  # different bytes of one digest: terms of their own
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(unequal).tolist():
            term[i] = len(terms) + more.setdefault(whole[starts[i] : ends[i]], len(more))
        terms += more
    return term, terms


def _blocks(data: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of about RUN bytes of one text, cut between terms."""
    lo = 0
    while lo < len(data):
        hi = min(lo + RUN, len(data))
        while hi < len(data) and not APART[data[hi]]:
            hi += 1
        yield data[lo:hi]
        lo = hi


def counted(data: np.ndarray, offs: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of a run of texts; group: the number of each text's group."""
    data = LOWER[data]
    if len(offs) == 2 and len(data) > 2 * RUN:
        total: Counter[bytes] = Counter()
        for block in _blocks(data):
            starts, ends, _ = word_spans(block, np.array([0, len(block)]), APART)
            term, terms = grouped_slices(block, starts, ends)
            total.update(dict(zip(terms, np.bincount(term, minlength=len(terms)).tolist(), strict=True)))
        return np.full(len(total), group[0]), list(total), np.fromiter(total.values(), np.int64, len(total)), np.ones(len(total), np.int64)
    starts, ends, first = word_spans(data, offs, APART)
    term, terms = grouped_slices(data, starts, ends)
    n = max(len(terms), 1)
    # Documents by terms, in compressed rows, with the documents of a group side by side.
    order = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[order] = np.arange(len(group))
    cell, times = np.unique(np.repeat(place, np.diff(first)) * n + term, return_counts=True)
    key = group[order][cell // n] * n + cell % n
    by_key = np.argsort(key, kind="stable")
    some, begin = np.unique(key[by_key], return_index=True)
    occurrences = np.add.reduceat(times[by_key], begin) if len(begin) else times
    return some // n, [terms[i] for i in (some % n).tolist()], occurrences, np.diff(np.append(begin, len(key)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs: a row for each of them in each run of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"]).to_pylist()
            numbers: dict[tuple[str, str], int] = {}
            group = np.array([numbers.setdefault((x["lang"], x["source"]), len(numbers)) for x in names], dtype=np.int64)
            langs, sources = (pa.array([k[i] for k in numbers], pa.string()) for i in (0, 1))
            for lo, hi, data, offs in pieces(batch.column("text"), RUN):
                of, terms, n, df = counted(data, offs, group[lo:hi])
                of = pa.array(of)
                yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "docs"])

    return docs.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


# Divergences -------------------------------------------------------------------------------------


def shares(count: np.ndarray, below: np.ndarray | int) -> np.ndarray:
    """1 + floor(SCALE * (count + 1) / below), for count + 1 <= below < 9 * 10^15: long division by three digits of 1000."""
    whole, rest = np.divmod(np.asarray(count, np.int64) + 1, below)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _row_sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of the rows of a matrix in compressed rows; begin: where each row begins, and the end. reduceat takes no empty rows."""
    out = np.zeros(len(begin) - 1, np.int64)
    some = np.flatnonzero(np.diff(begin))
    if len(some):
        out[some] = np.add.reduceat(values, begin[some])
    return out


def pair_sums(begin: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, n_terms: int) -> np.ndarray:
    """[a, b]: the sum over n_terms terms of the divergence of source a from source b.

    A matrix of sources by terms in compressed rows: begin, term and p of the cells. zero: the share of a term that a source doesn't have."""
    n = len(zero)
    row = np.repeat(np.arange(n), np.diff(begin))
    out = np.zeros((n, n), np.int64)
    for b in range(n):
        cells = slice(begin[b], begin[b + 1])
        q = np.full(n_terms, zero[b])
        q[term[cells]] = p[cells]
        # As if no source a had any term ...
        step = max(1, CELLS // max(int(begin[b + 1] - begin[b]), 1))
        for lo in range(0, n, step):
            out[lo : lo + step, b] = divergence(zero[lo : lo + step, None], p[None, cells]).sum(axis=1)
        out[:, b] += (n_terms - (begin[b + 1] - begin[b])) * divergence(zero, zero[b])
        # ... and corrected by the terms that it has.
        at = q[term]
        out[:, b] += _row_sums(divergence(p, at) - divergence(zero[row], at), begin)
    return out


def top_terms(begin: np.ndarray, term: np.ndarray, p: np.ndarray, whole: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(source, terms, values) of the terms that stand out most against the language (whole: its share of each term); terms are numbered in the order of their bytes."""
    value, over = divergence(p, whole[term]), p > whole[term]
    for a in range(len(begin) - 1):
        cells = np.arange(begin[a], begin[a + 1])[over[begin[a] : begin[a + 1]]]
        cells = cells[np.lexsort((term[cells], -value[cells]))[:top]]
        yield a, term[cells], value[cells]


def _slice(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one slice. left: term and counts (source, n) of its kept terms; right: source, total and kept (terms of the language) of all sources of the language."""
    left, right = left.sort_by("term"), right.sort_by("source")
    sources, totals = pa.array(right["source"].to_pylist(), pa.string()), right["total"].to_numpy()
    lang, kept, n_terms = right["lang"][0].as_py(), right["kept"][0].as_py(), left.num_rows
    out = []
    if n_terms:
        lists = left["counts"].combine_chunks()
        cells, length = lists.flatten(), lists.value_lengths().to_numpy()
        term, count = np.repeat(np.arange(n_terms), length), cells.field("n").to_numpy()
        row = pc.index_in(cells.field("source"), sources).to_numpy()
        whole = shares(np.add.reduceat(count, np.cumsum(length) - length), int(totals.sum()) + kept)
        order = np.lexsort((term, row))
        row, term, below = row[order], term[order], totals + kept
        begin = np.searchsorted(row, np.arange(len(sources) + 1))
        p = shares(count[order], below[row])
        sums = pair_sums(begin, term, p, shares(np.zeros(len(sources), np.int64), below), n_terms)
        names = left["term"].combine_chunks()
        out += [("term", np.full(len(t), a), names.take(pa.array(t)), v) for a, t, v in top_terms(begin, term, p, whole, TOP)]
    else:
        sums = np.zeros((len(sources), len(sources)), np.int64)
    a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
    out.append(("pair", a, sources.take(pa.array(b)), sums[a, b]))
    kinds = pa.schema({"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()})
    return pa.concat_tables([pa.table([pa.array([lang] * len(v)), sources.take(pa.array(a)), pa.array([part] * len(v)), item, pa.array(v)], schema=kinds) for part, a, item, v in out if len(v)] or [kinds.empty_table()])


def divergences(docs: DataFrame, min_docs: int = MIN_DOCS, slice_terms: int = SLICE_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source)."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
    kept = written(terms.filter(F.col("docs") >= min_docs).select("lang", "term", "counts"), "terms")
    per_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(0, ["total", "kept"])
    # Languages of more than one slice: a row for each slice_terms kept terms at most.
    large = F.broadcast(per_lang.filter(F.col("kept") > slice_terms).select("lang", F.ceil(F.col("kept") / slice_terms).cast("int").alias("slices")))
    number = F.pmod(F.xxhash64("term"), F.coalesce("slices", F.lit(1))).cast("int")
    left = kept.join(large, "lang", "left").select("lang", number.alias("slice"), "term", "counts")
    right = groups.join(large, "lang", "left").select("lang", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"), "source", "total", "kept")
    found = left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_slice, "lang string, source string, part string, item string, value bigint")
    parts = written(found, "divergences")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    names = ("lang", "source", "part", "item", "value", "rank")
    pairs = parts.filter("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(by_value))
    top = parts.filter("part = 'term'").withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= TOP)
    return pairs.select(*names).unionByName(top.select(*names))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair and term divergences of all sources of documents."""
    return divergences(documents(spark, sf_dir))


_SHARE = f"1 + (({SCALE}::HUGEINT * ({{n}} + 1)) // ({{total}} + kept))"
_DIVERGENCE = "((p - q) * (p - q)) // q"
ORACLE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS MATERIALIZED (
  SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(terms) AS term FROM d) GROUP BY ALL
), k AS MATERIALIZED (
  SELECT lang, term, sum(n) AS whole FROM w GROUP BY ALL HAVING count(*) >= {MIN_DOCS}
), c AS MATERIALIZED (
  SELECT lang, source, term, sum(n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), g AS MATERIALIZED (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(kept, 0) AS kept FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source) LEFT JOIN (SELECT lang, count(*) AS kept FROM k GROUP BY ALL) USING (lang)
), l AS (
  SELECT lang, sum(total) AS total FROM g GROUP BY ALL
), s AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, whole, coalesce(n, 0) AS n, kept, l.total AS all_total, {_SHARE.format(n="coalesce(n, 0)", total="g.total")} AS p
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum({_DIVERGENCE}) AS value FROM (SELECT lang, source, term, p FROM s) a
  JOIN (SELECT lang, source, term, p AS q FROM s) b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL
), named AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, {_DIVERGENCE} FROM (SELECT *, {_SHARE.format(n="whole", total="all_total")} AS q FROM s) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM named) WHERE part = 'pair' OR rank <= {TOP}
"""
