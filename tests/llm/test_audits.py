"""Exact duplicates, centroids and source divergences against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import centroids, divergence, exact_dedup

# Exact duplicates --------------------------------------------------------------------------------


def _texts(n: int) -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 9, 3)), "x", i, "h") for i in range(n)]
    rows += [(1000 + i, "one and the same", "x", i, "h") for i in range(n)]  # half of all rows
    rows += [(2000 + i, " one\tand the\n same ", "x", i, "h") for i in range(3)]
    return rows + [(None, "w1 w1 w1", None, None, None), (None, None, None, None, None), (7, None, None, None, None), (8, " \r\n", None, None, None), (9, "", None, None, None), (9, "", None, None, None), (10, "a\x0bb\x0cc", None, None, None), (11, "ß🙂" * 3000, None, None, None), (12, "a bc", None, None, None)]


def _groups(rows: list[tuple]) -> dict:
    by = defaultdict(list)
    for i, text, *_ in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v), min(v)[0]) for k, v in by.items()}


_SCHEMA = "doc_id bigint, text string, sha string, n bigint, hash string"


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_WORDS, 0])
def test_exact_duplicates_are_those_of_a_loop(spark, monkeypatch, limit):
    """With the second filter broadcast and joined; half of all rows are one text."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_WORDS", limit)
    rows = _texts(300)
    want = _groups(rows)
    docs = spark.createDataFrame(rows, _SCHEMA)
    got = [tuple(r) for r in exact_dedup.marked(docs).select("doc_id", "keep_id", "group_size", "text_sha256").collect()]
    bare = [(i, re.sub(r"[\x20\x09-\x0D]", "", text or "")) for i, text, *_ in rows]
    assert Counter(got) == Counter((i, *want[t][:2], hashlib.sha256(t.encode()).hexdigest()) for i, t in bare)
    kept = exact_dedup.marked(docs).filter("kept").select("text_sha256", "doc_id", "keep_id").collect()
    assert len(kept) == len(want) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], -len(r["text"] or "")) for r in left.collect()) == Counter((i, k) for i, _, k in want.values())


def test_exact_duplicates_shuffle_only_what_may_be_repeated(spark):
    """Rows of no equal aren't in the second filter, but for a few; nothing of the plan runs in Python."""
    rows = exact_dedup.digests(spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 10, "same").otherwise(F.concat(F.lit("t"), "id")).alias("text")))
    single, maybe = exact_dedup.sifted(rows, exact_dedup.repeated(rows))
    assert single.count() + maybe.count() == 5000 and 10 <= maybe.count() < 40
    plan = exact_dedup.marked(spark.range(9).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


# Centroids ---------------------------------------------------------------------------------------


def _clusters(vectors: list[tuple], k: int, rounds: int, scale: int):
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in vectors]
    at = [v for _, v in sorted(kept, key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1]))[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(at))

    for _ in range(rounds):
        mine = defaultdict(list)
        for _, v in kept:
            mine[near(v)[1]].append(v)
        for j, members in mine.items():
            at[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), at


@pytest.mark.parametrize("size", [1.0, 2000.0])
def test_clusters_are_those_of_a_loop(spark, size):
    """Among them vectors that tie, and ones far beyond what float32 holds exactly."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, size, 8) + 100 * size * (i % 3)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(500 + i, [float(i % 2)] * 8) for i in range(100)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5)
    got, found = centroids.clustered(docs, k=7, rounds=3, dims=8)
    want, at = _clusters(rows, 7, 3, 256)
    assert found.tolist() == at
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want
    r = got.filter("cluster = 0").first()
    assert r["inertia"] == sum(x[2] for x in want) and r["cluster_inertia"] == sum(x[2] for x in want if x[1] == 0)


def test_screening_loses_no_nearest_centroid():
    rng = np.random.default_rng(6)
    for size in (3, 300, 1 << 20, 1 << 26):
        at = rng.integers(-size, size, (40, 64))
        at[7] = at[3]
        x = np.concatenate([rng.integers(-size, size, (500, 64)), at, (at[:20] + at[20:]) // 2])
        model = centroids.Centroids(at)
        exact = ((x[:, None, :] - at[None]) ** 2).sum(axis=2)
        cluster, distance, undecided = model.nearest(x)
        assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and undecided
        assert model.screened(x - model.middle)[np.arange(len(x)), exact.argmin(axis=1)].all()


def test_empty_clusters_stay_and_few_vectors_give_few_centroids(spark):
    docs = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4)] + [(9, [50.0, 0.0])], "vec_id bigint, embedding array<float>")
    got, at = centroids.clustered(docs, k=40, rounds=2, dims=2)
    assert len(at) == 5 and {tuple(c) for c in at.tolist()} == {(256, 512), (12800, 0)}
    assert len({r["cluster"] for r in got.collect()}) == 2


# Divergences -------------------------------------------------------------------------------------


def test_slices_are_grouped_by_their_bytes_even_where_digests_are_equal():
    words = [b"aa", b"ab", b"aa", b"b", b"ccc", b"", b"ab", b"\xc3\xa4", b"aa"]
    data, ends = np.frombuffer(b" ".join(words), dtype=np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    some = [i for i, w in enumerate(words) if w]
    for digest in (hash, len, lambda _: 1):
        term, terms = divergence.grouped_slices(data, starts[some], ends[some], lambda b, d=digest: d(b) & 0xFFFF)
        assert [terms[t] for t in term] == [words[i] for i in some] and len(set(terms)) == len(terms)


def test_shares_are_exact():
    for count, below in [(0, 1), (2, 3), (10**12, 10**12 + 7), (5 * 10**15, 9 * 10**15 - 1), (0, 8 * 10**15)]:
        assert divergence.shares(np.array([count]), below)[0] == 1 + 10**9 * (count + 1) // below


def test_pair_sums_are_those_of_the_dense_matrix(monkeypatch):
    rng = np.random.default_rng(7)
    dense = rng.integers(0, 4, (6, 50)) * (rng.random((6, 50)) < 0.4)
    dense[2] = 0
    below = dense.sum(axis=1) + 50
    p = np.stack([divergence.shares(dense[i], below[i]) for i in range(6)])
    row, term = np.nonzero(dense)
    begin = np.searchsorted(row, np.arange(7))
    monkeypatch.setattr(divergence, "CELLS", 16)
    got = divergence.pair_sums(begin, term, p[row, term], divergence.shares(np.zeros(6, int), below), 50)
    assert (got == ((p[:, None] - p[None]) ** 2 // p[None]).sum(axis=2)).all()


def _counts(text: str) -> Counter:
    return Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)))


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "RUN", 64)
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("abÄ é🙂.-_9\n"), 5000)) + "x" * 500 + " end"
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    group, terms, n, df = divergence.counted(data, np.array([0, len(data)]), np.array([4]))
    assert {t.decode(): c for t, c in zip(terms, n.tolist(), strict=True)} == _counts(text)
    assert (group == 4).all() and (df == 1).all() and len(set(terms)) == len(terms)


@pytest.mark.parametrize("slice_terms", [10**6, 7])
def test_divergences_are_those_of_a_loop(spark, slice_terms):
    rng = np.random.default_rng(9)
    rows = [(" ".join(rng.choice(["the", "of", "Ärger", "foo-bar", "Über9", *[f"t{chr(97 + i)}" for i in range(20)]], rng.integers(0, 30))), str(rng.choice(["en", "de"])), str(rng.choice(["a", "b", "c"], p=[0.6, 0.3, 0.1]))) for _ in range(120)]
    rows += [(None, "en", None), ("the the", None, "a"), ("lone", "xx", "a"), ("only", "xx", "b")]
    by, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        c = _counts(text or "")
        by[lang or "", source or ""] += c
        df[lang or ""].update(c.keys())
        by[lang or "", source or ""].update({})
    want = set()
    for lang in df | {g[0]: 0 for g in by}:
        kept = [t for t, n in df[lang].items() if n >= 3]
        of = {s: c for (l, s), c in by.items() if l == lang}
        total = {s: sum(c[t] for t in kept) for s, c in of.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (total[s] + len(kept)) for t in kept} for s, c in of.items()}
        whole = {t: 1 + 10**9 * (sum(c[t] for c in of.values()) + 1) // (sum(total.values()) + len(kept)) for t in kept}
        for s in of:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in of if o != s]
            terms = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept if of[s][t] and p[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                want |= {(lang, s, part, o.decode(), -v, k) for k, (v, o) in enumerate(sorted(found)[: divergence.TOP if part == "term" else None], 1)}
    docs = spark.createDataFrame(rows, "text string, lang string, source string").repartition(3)
    got = [tuple(r) for r in divergence.divergences(docs, slice_terms=slice_terms).collect()]
    assert len(got) == len(set(got)) and set(got) == want
