"""The operators and the pipeline: brute force, round trips, held-out accuracy, and odd inputs."""

from __future__ import annotations

import hashlib
import re
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import normalised
from tidemark.llm import bpe, decontamination, html_text, langid, near_dedup, pii, quality, registry, toxicity, warc
from tidemark.llm.common import pieces, shingle_rows, table, word_hashes, word_spans, written

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEM = "the quick brown fox jumps over a lazy dog near the old river bank at noon"
NEAR = " ".join(f"word{i}" for i in range(60))

DIRTY = {
    "documents": (
        "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id bigint, band string, _stays bigint",
        [
            (1, NEAR, "en", "s", 1, 0.1, 7, "x", 1),
            (2, NEAR + " more", "en", "s", 1, None, 7, "x", 2),
            (2, NEAR + " more", "en", "s", 1, None, 7, "x", 2),
            (3, None, None, None, None, None, None, None, None),
            (4, "", "de", "s", 0, 0.5, 1, "", 4),
            (None, "kein Schluessel, aber Text", "de", None, 3, 0.5, 1, "", 4),
            (5, " \t\n ", "de", "s", 0, 0.5, 1, "", 4),
            (6, "long " * 30000 + ITEM, "en", "s", 0, 0.5, 1, "", 4),
            (7, f"mail a.b@example.org or +1 (538) 555-3805, ip 10.0.0.255, card 4111 1111 1111 1111 {ITEM}", "en", "s", 0, 0.5, 1, "", 4),
            (8, "Ärger ß 日本語 🙂 <b>\n<b>\n<b>", "de", "s", 0, 0.5, 1, "", 4),
            (9, "one", "en", "s", 0, 0.5, 1, "", 4),
            (10, "one", "en", "s", 0, 0.5, 1, "", 4),
            (12, "no two, but One.", "en", "s", 0, 0.5, 1, "", 4),
            (12, "other text of the same key", "en", "s", 0, 0.5, 1, "", 4),
        ],
    ),
    "labels": ("doc_id bigint, quality int, toxic int, text string", [(1, 1, 0, "x"), (6, 0, 1, "x"), (None, 1, 1, None), (7, None, None, None), (99, 1, 1, ""), (8, 0, 1, ""), (8, 0, 1, "")]),
    "benchmark": ("item_id bigint, text string, doc_id bigint", [(1, ITEM, 1), (1, ITEM, 1), (2, None, 1), (3, "", 1), (None, ITEM.upper(), 1), (4, "one", 1)]),
    "embeddings": (
        "vec_id bigint, embedding array<float>, label int, v string, cluster string, distance int",
        [
            (1, [0.5] * 64, 1, "x", "y", 1),
            (1, [0.5] * 64, 1, "x", "y", 1),
            (1, [-0.25] * 64, 1, "x", "y", 1),
            (2, None, None, None, None, None),
            (3, [], 1, "x", "y", 1),
            (4, [0.5] * 63, 1, "x", "y", 1),
            (5, [0.5] * 63 + [None], 1, "x", "y", 1),
            (6, [0.5] * 63 + [float("nan")], 1, "x", "y", 1),
            (7, [0.5] * 63 + [float("-inf")], 1, "x", "y", 1),
            (8, [3e38] * 64, 1, "x", "y", 1),
            (None, [0.125] * 64, 1, "x", "y", 1),
            (9, [500000.0] * 64, 1, "x", "y", 1),
        ],
    ),
    "pages": (
        "page_id bigint, url string, html string, text string",
        [
            (1, "http://a.example/1", "<html><nav>menu</nav><article><p>Hello &amp; good   day</p><p>two</p></article></html>", "t"),
            (2, None, None, None),
            (3, "", "", None),
            (4, "http://a.example/2", "x" * 2000, None),
            (5, "http://a.example/3", "x" * 2000, None),
            (5, "http://a.example/3", "x" * 2000, None),
            (None, "http://b", "y", None),
        ],
    ),
}


@pytest.fixture(scope="module", params=["dirty", "empty"])
def odd_dir(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(request.param)
    for name, (schema, rows) in DIRTY.items():
        spark.createDataFrame(rows if request.param == "dirty" else [], schema).write.parquet(f"{folder}/{name}.parquet")
    return request.param, str(folder)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_odd_inputs(spark, odd_dir, name):
    """Nulls, empty and long texts, repeats, clashing names, empty tables: a row for each row, the same again."""
    kind, folder = odd_dir
    got = registry.QUERIES[name](spark, folder).toPandas()
    source = "pages" if name in ("op5_warc", "op10_html_extraction") else "documents"
    if name == "op9_decontamination":
        pairs = {(int(d), None if pd.isna(i) else int(i)) for d, i in zip(got.doc_id, got.item_id, strict=True)}
        assert kind == "empty" and not pairs or pairs == {(6, 1), (6, None), (7, 1), (7, None), (9, 4), (10, 4), (12, 4)}
    elif name == "op12_centroids":
        assert len(got) == (5 if kind == "dirty" else 0)
    elif name == "op11_divergence":
        assert kind == "empty" and not len(got) or {(r.lang, r.source, r.item, r.value) for r in got.itertuples()} == {("de", "", "s", 0), ("de", "s", "", 0)}
    else:
        assert len(got) == (len(DIRTY[source][1]) if kind == "dirty" else 0)
    if name in registry.ORACLE_SQL:
        assert normalised(got) == normalised(_oracle(folder, registry.ORACLE_SQL[name]))
    if kind == "dirty" and name == "op7_near_dedup":
        of = {(-1 if pd.isna(d) else int(d)): (int(n), c) for d, n, c in zip(got.doc_id, got.n_shingles, got.component_id, strict=True)}
        assert of[2][1] == 1 and of[3] == (0, 3) and of[5] == (0, 5) and of[10] == (1, 9) and pd.isna(of[-1][1])
    if kind == "dirty" and name == "op10_html_extraction":
        assert got.set_index("page_id").text[1] == "Hello & good day\n\ntwo"


def test_odd_inputs_of_the_pipeline(spark, odd_dir):
    kind, folder = odd_dir
    docs = table(spark, folder, "documents")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns or k == len(corpus_pipeline.STAGES) - 1
        docs = spark.createDataFrame(out.toArrow(), out.schema)
    left = [r["doc_id"] for r in docs.collect()]
    assert len(left) == len(set(left)) or left.count(12) == 2
    assert kind == "empty" and not left or {6, 7}.isdisjoint(left)


def _oracle(folder: str, sql: str):
    with duckdb.connect() as con:
        for p in Path(folder).iterdir():
            if p.suffix == ".parquet":
                con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        return con.sql(sql).df()


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_sql(spark, name):
    assert normalised(registry.QUERIES[name](spark, SF).toPandas()) == normalised(_oracle(SF, registry.ORACLE_SQL[name]))


def _sets(docs: pd.DataFrame, width: int) -> dict:
    out = {}
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        w = WORD.findall((text or "").translate(LOW))
        out[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def _components(sets: dict, percent: int) -> dict:
    inverted: dict = {}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        common: dict = {}
        for s in sets[i]:
            for j in inverted.setdefault(s, []):
                common[j] = common.get(j, 0) + 1
            inverted[s].append(i)
        for j, k in common.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_are_those_of_brute_force(spark, width, percent):
    docs = table(spark, SF, "documents")
    sets = _sets(docs.toPandas(), width)
    got = near_dedup.link(docs, width, percent).toPandas()
    want = _components(sets, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == {i: (len(sets[i]), want[i]) for i in sets}


def test_near_duplicates_beyond_the_hub(spark):
    """Chains of copies, each like the next only, in buckets that many share."""
    words = [f"w{i}" for i in range(400)]
    rows = [(g * 100 + k, " ".join(words[g * 40 : g * 40 + 200 + 0] if k == 0 else [*words[g * 40 + k * 6 : g * 40 + 200], *[f"n{g}x{j}" for j in range(k * 6)]])) for g in range(4) for k in range(25)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.link(docs, 3, 85).toPandas()
    want = _components(_sets(docs.toPandas(), 3), 85)
    assert dict(zip(got.doc_id, got.component_id, strict=True)) == want and len(set(want.values())) > 1


def test_components_take_further_links(spark):
    """Links that come later, between components, to new nodes and to none: as if all had been known from the start."""
    rng = np.random.default_rng(5)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2))] + [(k, k + 1) for k in range(300, 330)]
    later = [(int(a), int(b)) for a, b in rng.integers(0, 400, (60, 2))] + [(310, 5), (500, 501), (501, 329), (7, 7)]

    def of(links: list) -> dict:
        least = {x: x for link in links for x in link if link[0] != link[1]}
        for _ in least:
            for a, b in links:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        return least

    def table_of(links: list):
        return spark.createDataFrame(links, "a bigint, b bigint")

    known = near_dedup.components(table_of(first))
    assert {r["node"]: r["component"] for r in known.collect()} == of(first)
    more = near_dedup.joined(known, table_of(later))
    got = {r["node"]: r["component"] for r in more.collect()}
    want = of(first + later)
    assert more.count() == len(got) and {x: c for x, c in got.items() if x in want} == want and all(got[x] == x for x in got.keys() - want.keys())
    assert near_dedup.joined(known, table_of([])) is known


def test_stars_are_told_without_another_round(spark, monkeypatch):
    tags = []
    monkeypatch.setattr(near_dedup, "written", lambda df, tag: tags.append(tag) or written(df, tag))
    got = near_dedup.components(spark.createDataFrame([(k, k % 3) for k in range(3, 40)], "a bigint, b bigint"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: k % 3 for k in range(40)}
    assert tags.count("edges") == 1


def test_written_tables_leave_no_shuffle_files(spark):
    def files() -> int:
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").count("shuffle_")

    rows = spark.range(1000, numPartitions=5).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))
    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    left = [files()]
    got = [written(rows, "counts") for _ in range(3)]
    for _ in range(50):
        left.append(files())
        if left[-1] <= left[0]:
            break
        time.sleep(0.1)
    assert left[-1] <= left[0]
    assert all(sorted(x.collect()) == sorted(rows.collect()) for x in got) and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting


def test_odd_sketches_estimate_high_similarities():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for similarity in (0.95, 0.85, 0.75):
        shared = int(1000 * 2 * similarity / (1 + similarity))
        a, b = pool[:1000], np.concatenate([pool[:shared], pool[1000 : 2000 - shared]])
        sketches = near_dedup.odd_sketch(near_dedup.minhash(np.concatenate([a, b]), np.array([0, 1000, 2000]), near_dedup.FINE))
        differing = sum(int(x).bit_count() for x in np.bitwise_xor(*sketches.view(np.uint64)))
        estimate = 1 + near_dedup.BITS / 2 * np.log(1 - 2 * differing / near_dedup.BITS) / (2 * near_dedup.FINE)
        assert abs(estimate - similarity) < 0.05
    assert all((1 - s**r) ** b <= near_dedup.MISS for s in (0.8, 0.85, 0.9) for b, r in [near_dedup.bands(s)])


def test_tokens_are_those_of_the_library(spark):
    ranks = {t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, "/root/testdata/sf0.001", "documents").toPandas()
    got = bpe.op8_bpe(spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        ids = known.encode_ordinary(text or "")
        assert got.n_tokens[i] == len(ids) and got.ids_sha256[i] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256[i] == hashlib.sha256((text or "").encode()).hexdigest()


def test_replay_with_merges_out_of_order():
    """A vocabulary in which a merge makes a pair of earlier rank: the ids are still those of the definition."""
    tokens = [b"ab" + b"c", b"bc", b"ab", b"abcab", *[bytes([b]) for b in range(256)]]
    replay = bpe.Replay(tokens)
    words = [b"abcabc", b"aabcb", b"ab", b"c", b"abcab" * 9]
    ids, ends = replay.many(words)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [replay.one(w) for w in words]


def test_replay_at_many_places_is_the_definition():
    """All places of a pair are merged at once: overlapping and neighbouring ones too, whatever the order of the vocabulary."""
    rng = np.random.default_rng(3)
    single = [bytes([b]) for b in range(256)]
    for turn in range(150):
        more = {bytes(rng.choice(list(b"abc"), rng.integers(2, 6))) for _ in range(12)}
        tokens = [*single, *sorted(more, key=lambda t: (len(t), t))] if turn % 2 else [*more, *single]
        replay = bpe.Replay(tokens)
        words = [bytes(rng.choice(list(b"abc"), n)) for n in rng.integers(0, 25, 15)] + [b"a" * 9]
        ids, ends = replay.many(words)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [replay.one(w) for w in words]


def test_texts_that_are_read_together_are_replayed_once(monkeypatch):
    """Several runs of texts, of several batches, are one replay; matches in use stay known when the memory is full. The ids are those of each text alone."""
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    monkeypatch.setattr(bpe, "OUT_CHARS", 400)
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    replayed = []
    many = bpe.Replay.many
    monkeypatch.setattr(bpe.Replay, "many", lambda self, words: replayed.append([w for w in words if w]) or many(self, words))
    texts = [" ".join(["qwxzv", "zzqqk", f"uniq{k * 7919}", f"vxq{'abcdefghij'[k % 10]}zk{chr(97 + k // 10)}"] * 3) for k in range(100)]
    texts[7], texts[60] = None, ""
    encoder = bpe.Encoder(tokens, public_tokenizers.PATTERN)

    def ids(rows: list) -> list:
        batches = [pa.RecordBatch.from_pydict({"text": pa.array(rows[lo : lo + 10], pa.string())}) for lo in range(0, len(rows), 10)]
        return [x for b in bpe._encoded(iter(batches), encoder, ()) for x in b.column("ids").to_pylist()]

    got = ids(texts[:50])
    assert len(replayed) == 1
    got += ids(texts[50:])
    assert len(replayed) == 2 and b" qwxzv" in replayed[0] and b" qwxzv" not in replayed[1] and b" zzqqk" not in replayed[1]
    monkeypatch.setattr(bpe, "GROUP_CHARS", 1)
    assert ids(texts) == got
    known = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert got == [known.encode_ordinary(t or "") for t in texts]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _plain_base(text: str) -> list:
    out = []
    for k, (kind, form) in enumerate(BASE.items()):
        for m in re.finditer(form, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            checked = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and checked % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_base_spans(spark):
    texts = [r["text"] or "" for r in table(spark, SF, "documents").collect()]
    texts += ["a@b@c.d.e f..@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3", "+1234567890 +1(2)3 ++49 30 1234567", "4111-1111 1111-1111 0 4111111111111111", "x@y.z" * 50]
    assert all(pii.base_spans(t) == _plain_base(t) for t in texts)
    assert "<email>" in pii.redacted("write a@b.org", None)


def test_votes_find_reliabilities():
    """Labelers of known reliability: the posteriors follow the hidden truth better than the votes' majority."""
    rng = np.random.default_rng(5)
    truth = rng.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.6, 0.6, 0.55, 0.55])
    vote = np.where(rng.random((4000, 6)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    post = pii.reliabilities(np.zeros(4000, int), vote, np.ones(4000))
    assert ((post > 0.5) == truth).mean() > max(0.93, ((vote.sum(axis=1) > 0) == truth).mean())


def test_posteriors_of_patterns_are_those_of_spans():
    """Counting equal votes first changes nothing; one step of the formulas, span by span, leaves the posteriors where they are."""
    rng = np.random.default_rng(6)
    kinds, vote = rng.integers(0, 2, 300), rng.integers(-1, 2, (300, 6))
    rows, slot, n = np.unique(np.column_stack([kinds, vote]), axis=0, return_inverse=True, return_counts=True)
    grouped = pii.reliabilities(rows[:, 0], rows[:, 1:], n.astype(float), 2000)[slot]
    single = pii.reliabilities(kinds, vote, np.ones(300), 2000)
    assert np.abs(grouped - single).max() < 1e-6
    chances = {}
    for truth in (0, 1):
        weight = grouped if truth else 1 - grouped
        for j in range(6):
            each = {v: sum(w for w, row in zip(weight, vote, strict=True) if row[j] == v) + ((v + 2) if truth else (2 - v)) for v in (-1, 0, 1)}
            chances |= {(truth, j, v): x / sum(each.values()) for v, x in each.items()}
    for i in range(0, 300, 17):
        odds = []
        for truth in (0, 1):
            weight = grouped if truth else 1 - grouped
            here = sum(w for w, k in zip(weight, kinds, strict=True) if k == kinds[i]) + 2
            odds.append(here * np.prod([chances[truth, j, v] for j, v in enumerate(vote[i])]))
        assert abs(odds[1] / sum(odds) - grouped[i]) < 1e-5


def test_long_candidates_are_whole(spark):
    for length in (200, 5000):
        secret = ("aB3dE6gH9" * 600)[:length]
        text = f"token={secret} end"
        (span,) = [s for s in pii.candidates(text) if s[0] == "secret"]
        assert text[span[1] : span[2]] == secret and pii.votes(text, span)[4] == 1
    address = f"{'x' * 90} [at] {'y' * 70} [dot] a.b.c.d.e.f.g.org"
    assert ("email", 3, 3 + len(address)) in pii.candidates(f"to {address} now")
    rows = [(i, f"api_key = {('xY9' + chr(97 + i % 26)) * (3 + i * 7)} and the rest") for i in range(60)] + [(100 + i, f"no key {i} here") for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == "api_key = <secret> and the rest" and got[100 + i] == f"no key {i} here" for i in range(60))


def test_dictionaries_know_more_than_a_common_opening(spark):
    rng = np.random.default_rng(5)
    words = [[f"{c}{x:x}" for x in rng.integers(1 << 20, 1 << 24, 300)] for c in ("good", "bad")]
    rows = [(i, "one licence for all of the files " * 20 + " ".join(rng.choice(words[i % 2], 200)), 1 - i % 2) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    model = quality.fit(docs.filter("doc_id < 500"), docs.select("doc_id", "quality"))
    known = [sum(w.encode() in d for w in words[0]) for d in (model.good, model.bad)]
    assert known[0] > 200 and known[1] == 0
    got = quality.score(docs.filter("doc_id >= 500"), model, keep=["quality"]).toPandas()
    assert ((got.score >= 0.5) == (got.quality == 1)).all()


@pytest.mark.parametrize(("query", "column", "least"), [(toxicity.op1_toxicity, "toxic", 0.94), (quality.op6_quality_classifier, "quality", 0.93)])
def test_held_out_accuracy(spark, query, column, least):
    got = query(spark, SF).toPandas().merge(table(spark, SF, "labels").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held[column]).mean() > least and got.score.between(0, 1).all()


def _kneser_ney(texts: list, classes: list, corpus: list):
    """The evidence of a text by dictionaries of counts, straight from the formulas."""
    d, t = toxicity.DISCOUNT, toxicity.TOLERANCE
    split = lambda x: re.findall(r"[a-z0-9\x80-\U0010ffff]+", x.translate(LOW))
    pairs = lambda w: list(zip(["", *w], w, strict=False))
    stem = lambda w: w[: toxicity.STEM]

    def counts(docs):
        words, stems, both, after = {}, {}, {}, {}
        for doc in docs:
            for w in set(split(doc)):
                words[w] = words.get(w, 0) + 1
                stems[stem(w)] = stems.get(stem(w), 0) + 1
            for h, w in set(pairs(split(doc))):
                both[h, w] = both.get((h, w), 0) + 1
                after[h] = after.get(h, 0) + 1
        return words, stems, both, after

    words, stems, both, after = counts(corpus)
    total = sum(stems.values())
    models = []
    for c in (0, 1):
        n_words, n_stems, n_both, n_after = counts([x for x, y in zip(texts, classes, strict=True) if y == c])
        n = sum(n_words.values())
        kept = {s: max(k - d - t * n * stems[s] / total, 0) for s, k in n_stems.items()}
        free = 1 - sum(kept.values()) / n
        p_stem = {s: kept.get(s, 0) / n + free * stems[s] / total for s in stems}
        back = {w: p_stem[stem(w)] * k / stems[stem(w)] for w, k in words.items()}
        kept = {w: max(k - d - t * n * back[w], 0) for w, k in n_words.items()}
        free = 1 - sum(kept.values()) / n
        p_word = {w: kept.get(w, 0) / n + free * back[w] for w in words}
        kept = {x: max(k - d - t * n_after[x[0]] * both[x] / after[x[0]], 0) for x, k in n_both.items()}
        gone: dict = {}
        for (h, _), k in kept.items():
            gone[h] = gone.get(h, 0) + k
        models.append((n_after, kept, gone, p_word))

    def evidence(text):
        found = 0.0
        for h, w in pairs(split(text)):
            p = []
            for n_after, kept, gone, p_word in models:
                below = n_after.get(h, 0)
                p.append(kept.get((h, w), 0) / max(below, 1) + (1 - gone.get(h, 0) / max(below, 1)) * p_word[w])
            found += np.log(p[1]) - np.log(p[0])
        return found / max(len(split(text)), 1)

    return evidence


def test_evidence_is_that_of_the_formulas(spark):
    rng = np.random.default_rng(8)
    common, foul, bits = [f"w{i}" for i in range(30)], ["scheußlich", "scheußlicher", "blöd"], ["go", "away"]
    rows = []
    for i in range(240):
        toxic = i % 3 == 0
        words = list(rng.choice(common, rng.integers(0, 40)))
        for _ in range(3 * toxic):
            words.insert(rng.integers(0, len(words) + 1), str(rng.choice(foul)))
        words += bits if toxic else bits[::-1]
        rows.append((i, " ".join(words) if i else "", int(toxic)))
    docs = spark.createDataFrame([*rows, (None, None, None)], "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), docs)
    counted = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(toxicity.CURVE_SHARE)) != 0).collect()}
    known = [r for r in rows if r[0] in counted]
    evidence = _kneser_ney([r[1] for r in known], [r[2] for r in known], [r[1] for r in rows])
    got = toxicity.measured(docs.filter("doc_id IS NOT NULL"), model).toPandas().set_index("doc_id").evidence
    assert len(model.pair.keys) and all(abs(got[i] - evidence(t)) < 1e-9 for i, t, _ in rows)


def test_differences_are_those_of_plain_compression(spark):
    import zstandard as zstd

    docs = table(spark, SF, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, SF, "labels"))
    sizes = [lambda b, d=d: len(zstd.ZstdCompressor(level=3, dict_data=zstd.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(b)) for d in (model.good, model.bad)]
    level, slope, centre, spread = model.curve
    got = quality.score(docs, model).toPandas().set_index("doc_id")
    for i, text in list(zip(*(docs.toPandas()[c] for c in ("doc_id", "text")), strict=True))[:150]:
        raw = (text or "").encode()
        parts = [raw[a : a + quality.PART] for a in range(0, len(raw), quality.PART)]
        difference = sum(sizes[1](p) - sizes[0](p) for p in parts) / max(len(raw), 1)
        assert got.difference[i] == pytest.approx(difference) and got.score[i] == pytest.approx(1 / (1 + np.exp(-(level + slope * np.clip((difference - centre) / spread, -6, 6)))))
    assert slope > 0


def test_language(spark):
    got = langid.op4_language_id(spark, SF).toPandas().merge(table(spark, SF, "documents").toPandas(), on="doc_id")
    held = got[got.held_out & got.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.97


def test_a_record_is_fetched_from_its_frame(spark):
    pages = table(spark, SF, "pages").select("page_id", "url", "html")
    index = warc.archive(pages)
    some = index.filter("record_type = 'response'").orderBy("page_id").limit(20)
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_bundles(some, payloads=True).collect()}
    want = {r["page_id"]: r["html"] or "" for r in pages.join(some.select("page_id"), "page_id").collect()}
    assert got == want
    row = some.first()
    files, path = warc._open(row["bundle"])
    reader = warc.BundleReader(files.open_input_file(path))
    assert reader.frame(row["frame"])[row["offset"] :].startswith(b"WARC/1.1")


def test_every_record_has_an_identifier_of_its_own(spark):
    body = "x" * 2000
    rows = [(1, "u", body)] * 3 + [(2, "u", body)] * 2 + [(2, "v", body), (3, None, "small"), (3, None, "small"), (None, "w", "small"), (None, "w", body)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    index = warc.archive(pages)
    ids = [(r["record_id"], r["bundle"], r["frame"], r["offset"]) for r in index.collect()]
    assert len(ids) == len(rows) == len({i[0] for i in ids}) == len({i[1:] for i in ids})
    got = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in warc.read_bundles(index).collect())
    assert got == sorted([("1", "revisit", "2")] * 3 + [("2", "response", "None")] * 3 + [("3", "response", "None")] * 2 + [("None", "response", "None"), ("None", "revisit", "2")])
    responses = {r["record_id"] for r in index.filter("record_type = 'response'").collect()}
    heads = [warc._headers(r, 0)[0] for r in _records(index)]
    assert all(h["warc-refers-to"] in responses for h in heads if "warc-refers-to" in h)


def _records(index):
    for name, frame in {(r["bundle"], r["frame"]) for r in index.collect()}:
        files, path = warc._open(name)
        data = warc.BundleReader(files.open_input_file(path)).frame(frame)
        for at, length, _ in warc.parse(data):
            yield data[at : at + length]


def test_boilerplate_of_a_host_goes(spark):
    common = "sign up for our weekly letter and never miss any of the great offers"
    rows = [(i, f"http://h.example/{i}", f"<div>{common}</div><div>{' '.join(f'own{i}x{j}' for j in range(30))}</div>") for i in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).toPandas().set_index("page_id")
    assert all(common not in got.text[i] and f"own{i}x29" in got.text[i] for i in range(3))


def test_boilerplate_in_articles_goes_and_quotes_stay(spark):
    common = "sign up for our weekly letter and never miss any of the great offers"
    own = {i: " ".join(f"own{i}x{j}" for j in range(30)) for i in range(4)}
    rows = [(i, f"http://h.example/{i}", f"<article><p>{own[i]}</p><p>{common}</p></article><div class='related'>{own[(i + 1) % 4]}</div>") for i in range(4)]
    rows += [(9, "http://other.example/9", f"<article><p>{common}</p></article>")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).toPandas().set_index("page_id")
    assert got.from_article.all() and [got.text[i] for i in range(4)] == [own[i] for i in range(4)] and got.text[9] == common


def test_articles_keep_what_few_share_and_names_that_only_look_like_parts(spark):
    title = "a title of eleven words that two of these five pages have both"
    own = {i: " ".join(f"own{i}x{j}" for j in range(20)) for i in range(5)}
    rows = [(i, "http://h.example/", f"<article><p>{own[i]}</p>{f'<p>{title}</p>' if i < 2 else ''}<div class='social-history'>past {i}</div><section class='related-work'>work</section><div class='related-posts'>no</div><div class='share ad-slot2'>no</div></article>") for i in range(5)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).toPandas().set_index("page_id")
    assert all(got.text[i] == "\n\n".join([own[i], *[title] * (i < 2), f"past {i}", "work"]) for i in range(5))


def test_runs_of_most_pages_against_brute_force(spark, monkeypatch):
    """Every run of three tokens that more than half of the articles of a host have, in batches of few pages."""
    rng = np.random.default_rng(4)
    words = {i: [f"w{min(x, y)}" for x, y in rng.integers(0, 4, (80, 2))] for i in range(26)}
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<nav>w0 w0 w0 w1</nav><article><p>{' '.join(w)}</p></article>") for i, w in words.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        pages = html_text._hosted(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3, "page_id"), "page_id")
        got = {r["page_id"]: set(r["starts"]) for r in html_text.repeats_of(pages, "page_id", 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = {i: [tuple(w[k : k + 3]) for k in range(78)] for i, w in words.items()}
    want = {i: {k + 4 for k, run in enumerate(r) if 2 * sum(run in runs[j] for j in words if j % 2 == i % 2) > 13} for i, r in runs.items()}
    assert got == {i: x for i, x in want.items() if x}


def test_runs_against_brute_force(spark):
    """Every run of five tokens that another page of the host has, in random pages of few words."""
    rng = np.random.default_rng(3)
    words = {i: [f"w{x}" for x in rng.integers(0, 6, 60)] for i in range(12)}
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<p>{' '.join(w)}</p>") for i, w in words.items()]
    pages = html_text._hosted(spark.createDataFrame(rows, "page_id bigint, url string, html string"), "page_id")
    got = {r["page_id"]: set(r["starts"]) for r in html_text.repeated_tokens(pages, "page_id", 5).collect()}
    runs = {i: [tuple(w[k : k + 5]) for k in range(56)] for i, w in words.items()}
    want = {i: {k for k, run in enumerate(r) if any(run in runs[j] for j in words if j != i and j % 2 == i % 2)} for i, r in runs.items()}
    assert got == {i: x for i, x in want.items() if x}


def test_items_in_blocks(spark, monkeypatch):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = normalised(decontamination.search(docs, items).toPandas())
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 300)
    assert normalised(decontamination.search(docs, items).toPandas()) == one
    assert decontamination.decontaminated(docs, items).count() == docs.count() - len({r[0] for r in one[1]})


def test_shingles_of_rows():
    import pyarrow as pa

    _, _, data, offs = next(iter(pieces(pa.array(["a b c d", "", "a b", "a b c d"]))))
    starts, ends, first = word_spans(data, offs)
    hashes, at = shingle_rows(word_hashes(data, starts, ends), first, 3)
    assert np.diff(at).tolist() == [2, 0, 1, 2] and (hashes[:2] == hashes[3:]).all()


def test_pipeline_stage_by_stage(spark):
    """Every stage against brute force on its own input."""
    docs = table(spark, SF, "documents").limit(400)
    docs = spark.createDataFrame(docs.toArrow(), docs.schema)
    (_, first), (_, dedup), (_, clean), (_, private), (_, tokens) = corpus_pipeline.STAGES
    model = quality.fit(docs, table(spark, SF, "labels"))
    kept = {r["doc_id"] for r in quality.score(docs, model).filter("score >= 0.5").collect()}
    assert {r["doc_id"] for r in first(spark, docs, SF).collect()} == kept
    want = _components(_sets(docs.toPandas(), 5), 80)
    assert sorted(r["doc_id"] for r in dedup(spark, docs, SF).collect()) == sorted(i for i, c in want.items() if i == c)
    found = {r["doc_id"] for r in decontamination.search(docs, table(spark, SF, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean(spark, docs, SF).collect()} == set(want) - found
    redacted = private(spark, docs, SF)
    assert all(not pii.base_spans(r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in redacted.filter(F.col("text").isNotNull()).collect())
    assert tokens(spark, docs, SF).count() == docs.count()
