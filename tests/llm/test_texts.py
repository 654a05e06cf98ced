"""Blocks of pages, candidates and spans of personal data against plain versions."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tests.llm.test_operators import DIRTY
from tidemark.llm import bpe, html_text, pii, registry

# Pages -------------------------------------------------------------------------------------------

_SKIP = ["<nav>{}</nav>", "<footer>{}</footer>", "<aside>{}</aside>", "<form>{}</form>", "<div class=ad>{}</div>", '<div class="sidebar-left menu">{}</div>', '<section id="comments">{}</section>', "<script>if (a < b) {{ {} }}</script>", "<style>p {{ {} }}</style>", "<!-- {} -->", '<div role="complementary">{}</div>']
_KEEP = ["<div>{}</div>", "<section>{}</section>", '<div class="content social">{}</div>', '<div class="search">{}</div>', '<div style="display:none">{}</div>', "<blockquote>{}</blockquote>", "<div hidden>{}</div>", "<!-->{}", "<!--->{}", "<!-- x > y --!>{}", '<div data-x="a > b">{}</div>', "{}"]
_INLINE = ["{}", "<b>{}</b>", '<a href="x?a=1&amp;b=2">{}</a>', "<em>{}</em>", "<span class='x'>{}</span>", "<code>{}</code>"]
_WORDS = ["Rain", "fell &amp; fell", "on &lt;town&gt;", "caf&eacute;", "&#39;so&#x27;", "naïve", "日本", "a\n\t b", "5 < 6", "x"]
_PLAIN = {"fell &amp; fell": "fell & fell", "on &lt;town&gt;": "on <town>", "caf&eacute;": "café", "&#39;so&#x27;": "'so'", "a\n\t b": "a b"}


def _tree(rng: random.Random, depth: int) -> tuple[str, list[str]]:
    """Well-formed markup inside an article, and the blocks of its text as they are built."""
    markup, blocks = "", []
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        if kind < 0.25:
            markup += rng.choice(_SKIP).format(_tree(rng, 0)[0].replace("<!-->", "").replace("<!--->", "") if rng.random() < 0.3 and depth else "gone " + rng.choice(_WORDS[:1]))
        elif kind < 0.5 and depth:
            inner, found = _tree(rng, depth - 1)
            markup += rng.choice(_KEEP[:-1]).format(inner)
            blocks += found
        else:
            words = [rng.choice(_WORDS) for _ in range(rng.randint(1, 5))]
            markup += "<p>" + " ".join(rng.choice(_INLINE).format(w) for w in words) + "</p>"
            blocks.append(" ".join(_PLAIN.get(w, w) for w in words))
    return markup, blocks


@pytest.mark.parametrize("seed", range(60))
def test_blocks_are_those_that_the_page_was_built_of(seed):
    rng = random.Random(seed)
    markup, want = _tree(rng, 3)
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body><header>top</header><nav>menu</nav><main><article>{markup}</article></main><footer>end</footer></body></html>"
    got = [t for t, place, skipped in html_text.blocks(page) if place == html_text.ARTICLE and not skipped]
    assert got == want, markup


# Personal data -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("password: abcdefghij12$klmn!op end", "secret", "abcdefghij12$klmn!op"),
        ("api_key='a1b2c3d4e5f6#@%&*()-~g7' x", "secret", "a1b2c3d4e5f6#@%&*()-~g7"),
        ('{"token": "Zz9$Zz9$Zz9$Zz9"}', "secret", "Zz9$Zz9$Zz9$Zz9"),
        ("secret=äöü12345678ß\nnext", "secret", "äöü12345678ß"),
        ("Dr Anna Maria Luisa Fernanda Lopez came", "name", "Anna Maria Luisa Fernanda Lopez"),
        ("Frau Anna Maria Luisa Fernanda Sofia Carmen Lopez", "name", "Anna Maria Luisa Fernanda Sofia Carmen Lopez"),
        *[(f"write to joe {b}, please", "email", f"joe {b}") for b in ("[At] example.org", "(At) example.org", "{AT} example [Dot] org", "[aT] mail (DOT) example.org", "(at)example.org")],
    ],
)
def test_added_spans_are_whole(text, kind, want):
    assert [text[s:e] for k, s, e in pii.candidates(text) if k == kind] == [want]


def test_candidates_are_those_of_a_walk():
    """Secrets and bracketed addresses, found character by character."""
    rng = random.Random(4)
    pieces = ["password: ", "Token=", 'api-key "', "joe", " [At] ", "(at)", "example", ".org", " {dot} com", "$x!y@z", "0123456789ab", " ", "\n", "'", "ä", "Secret : ", "at]"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        want = []
        free = 0
        for at in range(len(text)):
            low = text.lower()
            if at < free or at and (low[at - 1].isascii() and low[at - 1].isalpha() or low[at - 1] in "ſK"):
                continue
            for word in ("token", "api_key", "api-key", "apikey", "secret", "password", "passwd", "access_key", "access-key", "accesskey"):
                if not low.startswith(word, at):
                    continue
                i = at + len(word)
                i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
                found = _value(text, i)
                if found:
                    want.append(found)
                    free = found[1]
                    break
        assert [(s, e) for k, s, e in pii.candidates(text) if k == "secret"] == want, text


def _value(text: str, i: int) -> tuple[int, int] | None:
    blank = lambda i: next((n for n in range(4) if text[i + n : i + n + 1] != " "), 3)
    i += blank(i)
    if text[i : i + 1] not in ("=", ":") or i >= len(text):
        return None
    i += 1
    i += blank(i)
    if text[i : i + 1] in ("'", '"') and i < len(text):
        i += 1
    end = i
    while end < len(text) and not text[end].isspace() and text[end] not in "\"'`":
        end += 1
    return (i, end) if end - i >= 12 else None


def test_spans_are_those_of_a_plain_loop(spark):
    rng = random.Random(5)
    parts = ["Dr Anna Maria Luisa Lopez", "call 555 123 4567 now", "ip 10.0.0.7", "a.b@example.org", "joe [At] example.org", "password: abcdefghij12$klmn!op", "card 4111-1111-1111-1111", "IBAN DE89 3704 0044 0532 0130 00", "ssn 123-45-6789", "version 1.2.3.4", "order 4111 1111 1111 1112", "plain words here", "+1 (538) 555-3805"]
    rows = [(i, None if i == 3 else ", ".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = pii.learn(pii.scan(docs))
    got = {r["doc_id"]: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["spans"]) for r in pii.detect(docs).collect()}
    for i, text in rows:
        text = text or ""
        base = pii.base_spans(text)
        free = [c for c in pii.candidates(text) if all(b[2] <= c[1] or c[2] <= b[1] for b in base)]
        scored = sorted(((pii.likelihood(weights, pii.features(text, c)), c) for c in free), key=lambda x: (-x[0], x[1][1], x[1][2], pii.KINDS.index(x[1][0])))
        taken = list(base)
        for p, c in scored:
            if p >= pii.ACCEPT and all(t[2] <= c[1] or c[2] <= t[1] for t in taken):
                taken.append(c)
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(taken, key=lambda s: (s[1], pii.KINDS.index(s[0]))))
        assert got[i] == want
        assert set(got[i].split(",")) >= set(want.split(","))
    # Each span goes whole.
    left = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    for i, text in rows:
        out, at = "", 0
        for kind, start, end in (x.split(":") for x in got[i].split(",") if x):
            if int(start) >= at:
                out += (text or "")[at : int(start)] + f"<{kind}>"
            at = max(at, int(end))
        assert left[i] == (None if text is None else out + text[at:])
    assert {i for i, t in left.items() if "<secret>" in (t or "")} == {i for i, t in rows if "klmn" in (t or "")}


# Odd inputs --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    for name, (schema, rows) in DIRTY.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder), [(r[0], r[1]) for r in DIRTY["documents"][1]]


def _by_row(frame) -> dict:
    """Results by key: of keys that repeat, all of them."""
    out: dict = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_odd_texts_have_the_values_that_the_docstrings_state(spark, dirty):
    """Null, empty, blank, very long, repeated and mixed texts, keys that are null or repeat."""
    folder, rows = dirty
    blank = [i for i, t in rows if not (t or "").strip()]
    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    sha = lambda x: hashlib.sha256(x).hexdigest()
    encoded = _by_row(registry.QUERIES["op8_bpe"](spark, folder))
    for i, text in rows:
        ids = library.encode(text or "", disallowed_special=())
        want = (len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode()))
        assert want in {(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in encoded[i]}, i
    found = _by_row(registry.QUERIES["op3_pii"](spark, folder))
    for i, text in rows:
        base = pii.base_spans(text or "")
        assert all(r["base_sha256"] == sha(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()) for r in found[i]) or i == 12
    assert all(r["spans"] == "" for i in blank for r in found[i]) and (found[7][0]["n_email"], found[7][0]["n_ip"], found[7][0]["n_card"], found[7][0]["n_phone"]) == (1, 1, 1, 1)
    languages = _by_row(registry.QUERIES["op4_language_id"](spark, folder))
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for i in blank for r in languages[i])
    assert all(r["lang_pred"] in ("en", "de", "und") and 0 <= r["score"] <= 1 for rs in languages.values() for r in rs) and languages[6][0]["lang_pred"] != "und"
    for name in ("op1_toxicity", "op6_quality_classifier"):
        scored = _by_row(registry.QUERIES[name](spark, folder))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for rs in scored.values() for r in rs)
        assert scored[2][0]["score"] == scored[2][1]["score"] and scored[9][0]["score"] == scored[10][0]["score"]  # equal texts
        assert scored[3][0]["score"] == scored[4][0]["score"]  # null and empty
