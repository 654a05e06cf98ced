"""Personal data by weak supervision: labelers vote on candidate spans, and no span is hand-labelled.

One pass over the texts finds the base spans, whose form alone settles them, and candidates: looser
forms (national phone numbers, spelled-out addresses, bank and insurance numbers, keys, titled names).
Six labelers vote +1, -1 or 0 on each: its checksum or form, a gazetteer, cue words before it, words that speak
against it, its neighbours, and its grouping. The votes are counted over all documents; the
different patterns of votes are few, so expectation-maximisation (each labeler has a probability of each vote
given that the span is or is not personal data, shared by all kinds, and each kind has a prior)
runs over the counts. Its posteriors are the soft labels of a logistic regression, the final span classifier, which doesn't see
the votes: its features are the span's kind, length, shape, make-up and neighbours, and the words around it. It is trained on at most
``MAX_SPANS`` spans, in the order of a hash of their places; what it accepts is added to the base spans.

The base, leftmost and non-overlapping for each kind, failing matches dropped:

* email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts of at most 255
* card ``[0-9]([\\x20-]?[0-9])+``, 14 to 19 digits that pass Luhn's test
* phone ``\\+[0-9][\\x20().0-9-]+[0-9]``, 10 to 15 digits

They are searched by equivalent forms that take linear time on any text. An added span
never overlaps a base span or another added one (the likelier one stays, then the earlier).

Defined results: null is the empty text, without spans. Positions count code points, the end is exclusive. With no candidate
at all nothing is learnt and nothing added. Repeated rows count as often as they occur and each get their row; other columns
are kept out of the way.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents, written

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "secret", "name")
LABELERS = ("form", "gazetteer", "cue", "against", "isolated", "grouping")
#: Accepted at this probability of the final classifier.
ACCEPT = 0.5
#: Spans that the final classifier is trained on.
MAX_SPANS = 10_000

Span = tuple[str, int, int]

_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_SET:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = end = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """The base spans by start, then by the order of the kinds."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (s[1], order[s[0]]))


# Candidates and labelers --------------------------------------------------------------------------

_CANDIDATES = {
    "phone": re.compile(r"(?<![0-9A-Za-z.+/-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])|(?<![0-9A-Za-z.+/-])00[1-9][0-9]{0,2}[ -][0-9][0-9 -]{6,14}[0-9](?![0-9A-Za-z])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "card": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}(?:([ -]?)[0-9]{4})(?:\1[0-9]{4}){1,2}(?:\1?[0-9]{1,3})?(?![0-9A-Za-z])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({]at[\])}] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[({]dot[\])}]) ?[A-Za-z0-9-]++)++", re.I)
_BRACKET = re.compile(r"[\[({]at[\])}]", re.I)
_SECRET = re.compile(r"(?i)(?<![a-z])(?:token|api[_-]?key|secret|passw(?:or)?d|access[_-]?key)[\"']? {0,3}[=:] {0,3}[\"']?([^\s\"'`]{12,}+)")
_NAME = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Señor|Señora)\.? ([A-ZÀ-Þ][a-zß-ÿ]{2,20}(?: [A-ZÀ-Þ][a-zß-ÿ]{2,20})*)")

# Gazetteers, fixed values.
_TLDS = frozenset("com org net edu gov mil int info biz io co uk de fr es it nl be at ch pl pt se no dk fi ie us ca mx br ar cl jp cn in au nz ru eu example test".split())
_COUNTRIES = frozenset("AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR".split())
_FIRST_NAMES = frozenset("james john robert michael william david mary patricia jennifer linda elizabeth anna maria peter paul thomas hans karl klaus jürgen jean pierre marie michel claude josé juan carlos antonio carmen luis ana sofia emma".split())
_CUES = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|write|address"),
    "ip": re.compile(r"\bip\b|host|server|address|login"),
    "card": re.compile(r"card|visa|master|amex|karte|carte|tarjeta|credit|payment"),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|contact|anruf|handy|appel|llam|móvil"),
    "ssn": re.compile(r"ssn|social|security|insurance|sozial"),
    "iban": re.compile(r"iban|bank|account|konto|compte|cuenta"),
    "secret": re.compile(r"token|key|secret|passw"),
    "name": re.compile(r"name|dear|regards|sincerely|signed|patient|customer"),
}
_AGAINST = re.compile(r"version|\bv\.?$|order|isbn|invoice|ticket|serial|model|part no|article no|page|pages|figure|table|section|[$€£]\s?$|\bid\b|no\.\s?$|#\s?$|year|score")


def _iban_ok(text: str) -> bool:
    t = text.replace(" ", "")
    return 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def candidates(text: str) -> list[Span]:
    """Looser spans, each kind leftmost and non-overlapping."""
    out: list[Span] = []
    if _DIGIT.search(text):
        for kind, form in _CANDIDATES.items():
            out += [(kind, *m.span()) for m in form.finditer(text)]
    if _BRACKET.search(text):
        out += [("email", *m.span()) for m in _AT.finditer(text)]
    if "=" in text or ":" in text:
        out += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    out += [("name", *m.span(1)) for m in _NAME.finditer(text)]
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """The labelers' votes on a span, in the order of LABELERS."""
    kind, start, end = span
    own = text[start:end]
    digits = _digits(own)
    before, after = text[max(0, start - 48) : start].lower(), text[end : end + 16].lower()
    form = gazetteer = 0
    if kind == "card":
        form = 1 if luhn(digits) and len(digits) >= 13 else -1
        gazetteer = 1 if digits[:1] in ("3", "4", "5", "6") else -1
    elif kind == "ip":
        form = 1
        gazetteer = -1 if own.startswith(("0.", "255.")) else 0
    elif kind == "phone":
        form = 1 if own.startswith(("+", "00", "(")) else 0 if len(digits) >= 9 else -1
        gazetteer = 1 if len(digits) in (10, 11, 12) and len(set(digits)) > 3 else -1
    elif kind == "email":
        form = 1 if "@" in own else 0
        gazetteer = 1 if re.split(r"[. \])}]", own)[-1].lower() in _TLDS else -1
    elif kind == "iban":
        form = 1 if _iban_ok(own) else -1
        gazetteer = 1 if own[:2] in _COUNTRIES else -1
    elif kind == "ssn":
        form = -1 if own.startswith(("000", "666", "9")) or "-00-" in own or own.endswith("0000") else 1
    elif kind == "secret":
        form = 1 if digits and any(c.isalpha() for c in own) and len(set(own)) >= 8 else -1
    elif kind == "name":
        gazetteer = 1 if own.split(" ")[0].lower() in _FIRST_NAMES else 0
        form = 1 if " " in own else 0
    cue = 1 if _CUES[kind].search(before) or _CUES[kind].search(after) else 0
    against = -1 if _AGAINST.search(before[-20:]) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    isolated = -1 if left.isalnum() or right.isalnum() else 1
    grouping = 1 if re.fullmatch(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{2,4}|\+?[0-9]{0,3} ?\([0-9]{2,4}\) ?[0-9 .-]+", own) else 0
    return form, gazetteer, cue, against, isolated, grouping


# Expectation-maximisation and the final classifier -------------------------------------------------


def reliabilities(kinds: np.ndarray, vote: np.ndarray, n: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Posterior that each pattern is personal data. kinds: index of its kind; vote: (patterns, labelers) in -1, 0, 1; n: counts.

    Starts from the balance of the votes and keeps every probability of a vote away from 0 by a few pseudo-counts,
    among them some that say that a labeler's vote rather agrees with the truth.
    """
    post = 1 / (1 + np.exp(-1.5 * vote.sum(axis=1)))
    onehot = np.stack([vote == v for v in (-1, 0, 1)], axis=2).astype(float)
    prior_counts = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])
    n_kinds = int(kinds.max()) + 1 if len(kinds) else 0
    for _ in range(rounds):
        w = np.stack([(1 - post) * n, post * n])
        given = np.einsum("cp,plv->clv", w, onehot) + prior_counts[:, None, :]
        given /= given.sum(axis=2, keepdims=True)
        share = np.stack([np.bincount(kinds, weights=x, minlength=n_kinds) for x in w]) + 2.0
        share /= share.sum(axis=0)
        log = np.log(share)[:, kinds] + np.einsum("plv,clv->cp", onehot, np.log(given))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post


_SHAPES, _WORDS = 32, 64
_RUNS = re.compile(r"(.)\1+")
_AROUND = re.compile(r"\w+")


def _shape(text: str) -> str:
    return _RUNS.sub(r"\1", "".join("d" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text))


def _level(x: float, bounds: tuple[float, ...]) -> int:
    return sum(x > b for b in bounds)


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalnum() else 3


#: The groups of features, each with as many places: of each kind, and of all kinds together.
_OF_KIND = (1, 6, _SHAPES, 5, 4)
_OF_ALL = (_WORDS, _WORDS, 4, 4)
N_FEATURES = len(KINDS) * sum(_OF_KIND) + sum(_OF_ALL)


def features(text: str, span: Span) -> list[int]:
    """The places of the features that a span has."""
    kind, start, end = span
    own = text[start:end]
    digits = sum(c.isdigit() for c in own)
    before, after = _AROUND.findall(text[max(0, start - 48) : start].lower()), _AROUND.findall(text[end : end + 48].lower())
    found = [0, _level(len(own), (8, 12, 16, 24, 40)), zlib.crc32(_shape(own).encode()) % _SHAPES, _level(digits / max(len(own), 1), (0.0, 0.3, 0.6, 0.85)), _level(len(set(own)), (4, 8, 12))]
    at, out = KINDS.index(kind) * sum(_OF_KIND), []
    for place, size in zip(found, _OF_KIND, strict=True):
        out.append(at + place)
        at += size
    at = len(KINDS) * sum(_OF_KIND)
    out += [at + zlib.crc32(w.encode()) % _WORDS for w in before[-2:]]
    out += [at + _WORDS + zlib.crc32(w.encode()) % _WORDS for w in after[:1]]
    at += 2 * _WORDS
    out += [at + _side(text[start - 1 : start] if start else ""), at + 4 + _side(text[end : end + 1])]
    return sorted(set(out))


def trained(spans: list[list[int]], truth: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a logistic regression on soft labels; the last one is the level."""
    x = np.zeros((len(spans), N_FEATURES + 1))
    x[:, -1] = 1
    for i, places in enumerate(spans):
        x[i, places] = 1
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(hess, x.T @ (truth - p) - ridge * beta)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def likelihood(weights: np.ndarray, places: list[int]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(weights[places].sum() + weights[-1])))))


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, base, more) for every row: base and candidate spans with their votes and features; one pass over the texts."""
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(text: str, s: Span) -> dict:
            return {"kind": s[0], "start": s[1], "end": s[2], "votes": ",".join(map(str, votes(text, s))), "features": features(text, s)}

        for batch in batches:
            base, more = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                found = base_spans(text)
                base.append([row(text, s) for s in found])
                more.append([row(text, s) for s in candidates(text) if not any(b[1] < s[2] and s[1] < b[2] for b in found)])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(span))], [key, "base", "more"])

    spans = "array<struct<kind:string,start:bigint,end:bigint,votes:string,features:array<int>>>"
    return docs.select(key, "text").mapInArrow(run, f"`{key}` {kind}, base {spans}, more {spans}")


def learn(scanned: DataFrame, key: str = "doc_id") -> np.ndarray | None:
    """Weights of the final classifier; None without any span. At most 3 ** 6 patterns of each kind reach the driver, with their counts over
    all spans, and the features of MAX_SPANS spans."""
    spans = scanned.select(key, F.explode(F.concat("base", "more")).alias("s")).select(key, "s.*")
    rows = sorted(spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect(), key=lambda r: (r["kind"], r["votes"]))
    if not rows:
        return None
    kinds = np.array([KINDS.index(r["kind"]) for r in rows])
    vote = np.array([[int(v) for v in r["votes"].split(",")] for r in rows])
    n = np.array([r["n"] for r in rows], dtype=float)
    truth = dict(zip(((r["kind"], r["votes"]) for r in rows), reliabilities(kinds, vote, n), strict=True))
    place = F.xxhash64(F.lit(19), key, "kind", "start")
    few = spans.orderBy(place, key, "kind", "start", "end", "votes").limit(MAX_SPANS).select("kind", "votes", "features").collect()
    return trained([r["features"] for r in few], np.array([truth[r["kind"], r["votes"]] for r in few]))


def chosen(base: list[Span], more: list[tuple[float, Span]]) -> list[Span]:
    """The base spans and, the likeliest first, the candidates that are accepted and overlap none of those taken before."""
    order = {k: i for i, k in enumerate(KINDS)}
    taken = list(base)
    for p, s in sorted(more, key=lambda x: (-x[0], x[1][1], x[1][2], order[x[1][0]])):
        if p >= ACCEPT and not any(t[1] < s[2] and s[1] < t[2] for t in taken):
            taken.append(s)
    return sorted(taken, key=lambda s: (s[1], order[s[0]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, base, spans) for every row of docs: arrays of kind, start and end; base spans, and these with the accepted ones."""
    scanned = written(scan(docs, key), "pii")
    model = learn(scanned, key)
    kind = docs.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, every = [], []
            for b, m in zip(batch.column("base").to_pylist(), batch.column("more").to_pylist(), strict=True):
                sure = [(s["kind"], s["start"], s["end"]) for s in b]
                found = chosen(sure, [(likelihood(model, s["features"]), (s["kind"], s["start"], s["end"])) for s in m])
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in sure])
                every.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], [key, "base", "spans"])

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return scanned.mapInArrow(run, f"`{key}` {kind}, base {spans}, spans {spans}")


def redact(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs, with each span of personal data in the texts replaced by its kind in angle brackets; null texts stay null.

    The model is learnt from all of docs first; the second pass finds each text's spans anew.
    """
    model = learn(written(scan(docs, key), "pii"), key)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if v is None else redacted(v, model) for v in (x.as_py() for x in batch.column("text"))]
            at = names.index("text")
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field("text").type) if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(run, docs.schema)


def redacted(text: str, model: np.ndarray | None) -> str:
    """text with the spans that the model finds, and the base spans, replaced; without a model only these."""
    base = base_spans(text)
    more = [] if model is None else [(likelihood(model, features(text, s)), s) for s in candidates(text)]
    out, at = [], 0
    for k, s, e in chosen(base, more):
        if s >= at:
            out += [text[at:s], f"<{k}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts, the digest of its base spans, and all its spans."""
    found = detect(documents(spark, sf_dir).select("doc_id", "text"))

    def text(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def base_digest(text: str | None) -> str:
    return hashlib.sha256(joined(base_spans(text or "")).encode()).hexdigest()
