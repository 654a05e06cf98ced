"""Main text of web pages: tags find the article, a suffix array per host finds what its pages repeat.

A pass over the markup gives the blocks of each page and where they stand: in an article, in a
part that is no article by its tag, class or role (menus, headers, footers, sidebars, notices, adverts,
forms, comments), or elsewhere. Where a page marks its article, that is its text; else all that stands in no such part. The
streams of all pages of a host are concatenated, and what its pages repeat goes, in runs of ``MIN_RUN`` tokens or more:

* in a page that marks no article, each run that another page of the host has too, wherever that stands;
* in a marked article, each run that more than half of the host's pages, and at least ``MIN_PAGES``, have in their text. What
  a few articles share is quoted, or a title, or a licence, and stays: the article is not to lose anything else.

The suffix array is never held in one place. Its suffixes are dealt out by their first
``MIN_RUN`` tokens, hashed; two suffixes have a common prefix of that length exactly if they are in one bucket, so a bucket
is an interval of the array, and overlapping intervals make up longer runs. Buckets are only
ever aggregated, so one of any size costs no more than its rows. Only suffixes that can be in a bucket
of enough pages are dealt out: those whose least gram of half that length has enough pages too, by a filter that may
let others through and loses none. A run of most pages of a host has most of its pages in at least one batch; a batch
reports no other grams. Pages are parsed anew for each step, so that no texts are stored.

Defined results: null or empty html has an empty text, and so has a page without words outside of
skipped parts. A page that repeated runs cover wholly, or a marked article that they cover by more than half, is a copy and keeps
its blocks. Null urls form one host. Rows that repeat a page_id each get their row; they are one page where another page is asked for, and
count as often as they occur where a host's pages are counted. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import BATCH_BYTES, FILTER_BITS, bitmap, mix, pieces, seen, small_batches, table, word_hashes, word_spans, written

#: Tokens that a substring needs to count as repeated.
MIN_RUN = 10
#: Pages of a host that need to have it, for a marked article to lose it.
MIN_PAGES = 3

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed template".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are kept on the stack of open ones; others only if they are marked.
_HELD = _BLOCK - {"p", "li", "td", "th", "tr", "dd", "dt", "option", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
_SKIPPED_TAGS = frozenset("head nav footer aside form button select datalist dialog menu svg canvas audio video object map search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What classes, ids and roles call parts that are no article, and words that such names are combined with.
_SKIPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner cookie cookies consent gdpr notice notification alert popup modal overlay promo promotion sidebar "
    "menu navbar nav navigation breadcrumb breadcrumbs comment comments commentlist disqus respond share sharing social related recommended newsletter subscribe signup login masthead footer "
    "pagination pager toolbar copyright complementary contentinfo search".split()
)
_HEADER_NAMES = frozenset("header banner".split())
_IN_ARTICLE = _SKIPPED_NAMES - {"search", "copyright", "toolbar", "modal", "overlay"}
_PART_NAMES = frozenset(
    "a area articles bar block bottom box btn button buttons by center col column container content desktop div fixed form global group header holder icons inner item items js left link links list "
    "main media mobile module new outer page panel post posts primary region right row secondary section site slot stories sub text thread top unit up us widget widgets wrap wrapper".split()
)
_TAG_REST = re.compile(r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_COMMENT_END = re.compile("--!?>")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)

ELSEWHERE, MAIN, ARTICLE = 0, 1, 2


def _calls(value: str, names: frozenset[str]) -> bool:
    """One of the words of a class, id or role is such a name, alone or only with words that names are combined with."""
    for word in value.split():
        parts = {p.rstrip("0123456789") for p in re.split("[-_]+", word)} - {""}
        if parts & names and parts <= names | _PART_NAMES:
            return True
    return False


def _says(value: str, names: frozenset[str]) -> bool:
    """Every word of a class, id or role says so: inside an article one word among others (``content social``) is no reason to drop text."""
    words = value.split()
    return bool(words) and all(_calls(w, names) for w in words)


def _mark(tag: str, rest: str, inside: bool = False) -> tuple[bool, bool, int]:
    """(skipped, header, place) of an element by its tag and attributes; inside: in an article, which loses only what is a part of the named kinds, and nothing for being hidden."""
    place = ARTICLE if tag == "article" else MAIN if tag == "main" else ELSEWHERE
    if tag in _SKIPPED_TAGS:
        return True, False, ELSEWHERE
    header = tag == "header"
    if rest and tag not in ("html", "body"):
        if not inside and _HIDDEN.search(rest):
            return True, False, ELSEWHERE
        calls = _says if inside else _calls
        for m in _NAMED.finditer(rest):
            value = (m[2] or m[3] or m[4] or "").lower()
            if m[1].lower() == "itemprop":
                place = ARTICLE if value == "articlebody" else place
            elif value == "main" and m[1].lower() == "role":
                place = max(place, MAIN)
            elif calls(value, _HEADER_NAMES):
                header = True
            elif tag != "main" and calls(value, _IN_ARTICLE if inside else _SKIPPED_NAMES):
                return not (tag == "article" and "comment" not in value), False, place
    return False, header, place


def blocks(page: str) -> list[tuple[str, int, bool]]:
    """(text, place, skipped) of each block with text, in page order. Takes time in proportion to the page."""
    out: list[tuple[str, int, bool]] = []
    now: list[str] = []
    stack: list[tuple[str, bool, bool, int]] = []
    opened: Counter[str] = Counter()
    skips = headers = articles = mains = headings = 0
    quotes, at, n = True, 0, len(page)

    def flush() -> None:
        if now:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                out.append((text, ARTICLE if articles else MAIN if mains else ELSEWHERE, bool(skips or headers and not (headings and articles))))

    def pop() -> str:
        nonlocal skips, headers, articles, mains
        tag, skip, header, place = stack.pop()
        opened[tag] -= 1
        skips -= skip
        headers -= header
        articles -= place == ARTICLE
        mains -= place == MAIN
        return tag

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            now.append(entities.unescape(page[at:]))
            break
        if begin > at:
            now.append(entities.unescape(page[at:begin]))
        after = page[begin + 1 : begin + 2]
        if page.startswith("<!--", begin):
            end = _COMMENT_END.search(page, begin + 4)
            at = end.end() if end else n
            if page.startswith((">", "->"), begin + 4):  # <!--> and <!---> are whole comments
                at = page.index(">", begin + 4) + 1
            continue
        closing = after == "/"
        name = _NAME.match(page, begin + 1 + closing)
        if not name:
            if after in ("!", "?", "/") and after:
                end = page.find(">", begin)
                at = n if end < 0 else end + 1
            else:
                now.append("<")
                at = begin + 1
            continue
        rest = _TAG_REST.match(page, name.end()) if quotes else None
        if rest:
            end = rest.end()
        else:
            quotes = False
            end = page.find(">", name.end()) + 1
            if not end:
                break
        tag, attributes = name[0].lower(), page[name.end() : end - 1]
        at = end
        if tag in _BLOCK:
            flush()
        elif tag == "br":
            now.append(" ")
        if closing:
            if tag in _HEADINGS:
                headings = max(0, headings - 1)
            if opened[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in _RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = n if not found else found.start()
            continue
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        headings += tag in _HEADINGS
        if tag in ("p", "li") and opened[tag] and stack and stack[-1][0] == tag:
            pop()
        skip, header, place = _mark(tag, attributes.strip(), articles > 0)
        if skip or header or place or tag in _HELD:
            if tag not in _BLOCK and (skip or header):
                flush()
            stack.append((tag, skip, header, place))
            opened[tag] += 1
            skips += skip
            headers += header
            articles += place == ARTICLE
            mains += place == MAIN
    flush()
    return out


class _Page:
    """The blocks of a page's text with the number of their first token, all tokens in page order, which of them are text, and whether tags mark its article."""

    def __init__(self, page: str | None) -> None:
        found = blocks(page or "")
        best = max((p for _, p, skipped in found if not skipped), default=ELSEWHERE)
        self.marked = best > ELSEWHERE
        self.unmarked = not self.marked and any(not skipped for _, _, skipped in found)
        self.stream = " ".join(t for t, _, _ in found)
        self.kept: list[bool] = []
        self.blocks: list[dict] = []
        for t, p, skipped in found:
            length, kept = t.count(" ") + 1, p >= best and not skipped
            if kept:
                self.blocks.append({"first": len(self.kept), "length": length, "text": t})
            self.kept += [kept] * length

    def within(self, starts: np.ndarray, n: int) -> np.ndarray:
        """Which of the runs of n tokens are text throughout."""
        sums = np.concatenate([[0], np.cumsum(self.kept)])
        return sums[starts + n] - sums[starts] == n


def _hosted(pages: DataFrame, key: str) -> DataFrame:
    """(key, html, _host: hash of the url's host)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return pages.select(key, "html", F.xxhash64(host).alias("_host"))


def _rolled(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n words in a row."""
    out = np.zeros(max(len(words) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        out = mix(out + words[j : j + len(out)])
    return out


def _windows(batch: pa.RecordBatch, min_run: int, unmarked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[_Page]]]:
    """Of the pages of a batch, some at a time, (row of the batch, first token, hash of the least gram, hash of all tokens, place
    among the pages) of each run of min_run tokens, and the pages. Hashes are of the host too.

    Grams are half as long as a run. Equal runs have the same least gram, so pages that share a run share that gram. unmarked is
    filled, if given, with which pages of the batch have text and mark no article.
    """
    k = (min_run + 1) // 2
    for at in range(0, batch.num_rows, 64):
        part = batch.slice(at, 64)
        pages = [_Page(x.as_py()) for x in part.column("html")]
        if unmarked is not None:
            unmarked[at : at + 64] = [p.unmarked for p in pages]
        hosts = part.column("_host").to_numpy().view(np.uint64)
        for lo, hi, data, offs in pieces(pa.array([p.stream for p in pages], pa.string())):
            starts, ends, first = word_spans(data, offs)
            row = np.repeat(np.arange(lo, hi), np.diff(first))
            n = len(row) - min_run + 1
            if n < 1:
                continue
            words = word_hashes(data, starts, ends)
            grams = _rolled(words, k)
            least = np.lib.stride_tricks.sliding_window_view(grams, min_run - k + 1)[:n].min(axis=1)
            runs = np.flatnonzero(row[:n] == row[min_run - 1 :])
            which = row[runs]
            yield at + which, runs - first[which - lo], mix(least[runs] ^ hosts[which]), mix(_rolled(words, min_run)[runs] ^ hosts[which]), which, pages


def _text_windows(batch: pa.RecordBatch, min_run: int, unmarked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of the batch, first token, hash of the least gram, hash of all tokens) of the runs that are text throughout."""
    for row, start, gram, prefix, which, pages in _windows(batch, min_run, unmarked):
        kept = np.zeros(len(row), dtype=bool)
        edges = np.searchsorted(which, np.arange(len(pages) + 1))
        for i in np.unique(which):
            kept[edges[i] : edges[i + 1]] = pages[i].within(start[edges[i] : edges[i + 1]], min_run)
        yield row[kept], start[kept], gram[kept], prefix[kept]


def _on(batch: pa.RecordBatch, hosts: np.ndarray) -> pa.RecordBatch:
    """The pages on hosts that the filter lets through."""
    return batch.filter(pa.array(seen(hosts, batch.column("_host").to_numpy())))


def host_grams(pages: DataFrame, min_run: int) -> DataFrame:
    """(host, gram, n, half, unmarked): of each batch, with a null gram, the number of pages of each host, half of it and how many mark no
    article; and the grams that more than half of these pages have, with the number of pages by which they are more."""
    names, kinds = ["host", "gram", "n", "half", "unmarked"], "host bigint, gram bigint, n bigint, half bigint, unmarked bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hosts, place, rows = np.unique(batch.column("_host").to_numpy(), return_inverse=True, return_counts=True)
            unmarked = np.zeros(batch.num_rows, dtype=bool)
            found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, _, gram, _ in _text_windows(batch, min_run, unmarked):
                new = np.ones(len(row), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
                order = np.lexsort((gram[new], row[new]))
                row, gram = row[new][order], gram[new][order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
                found.append(gram[new])
                at.append(row[new])
            few = np.bincount(place, weights=unmarked, minlength=len(hosts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.nulls(len(hosts), pa.int64()), pa.array(rows), pa.array(rows // 2), pa.array(few)], names)
            gram, first, n = np.unique(np.concatenate(found), return_index=True, return_counts=True)
            host = place[np.concatenate(at)[first]]
            some = np.flatnonzero(n > rows[host] // 2)
            host, more = host[some], (n - rows[host] // 2)[some]
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(hosts[host]), pa.array(gram[some].view(np.int64)), pa.array(more), pa.array(np.zeros(len(some), np.int64)), pa.array(np.zeros(len(some), np.int64))], names)

    return pages.mapInArrow(run, kinds)


def common_tokens(pages: DataFrame, grams: DataFrame, totals: DataFrame, key: str, min_run: int = MIN_RUN, min_pages: int = MIN_PAGES) -> DataFrame | None:
    """(key, starts): at which tokens of a page (key, html, _host) a run of its text begins that more than half of the pages of its host have
    in theirs, and min_pages at least; None if there is none. grams, totals: of ``host_grams``, and (host, rows, halves) summed."""
    # A batch that doesn't report a gram has it in half of its pages at most.
    likely = grams.groupBy("host", "gram").agg(F.sum("n").alias("more")).join(totals, "host").filter((2 * (F.col("more") + F.col("halves")) > F.col("rows")) & (F.col("rows") >= min_pages))
    likely = written(likely.select("host", "gram"), "grams")
    kind = pages.schema[key].dataType.simpleString()
    spark = pages.sparkSession
    bits = bitmap(likely.select(F.col("gram").alias("h")))
    if not bits.any():
        return None
    both = spark.sparkContext.broadcast((bitmap(likely.select(F.col("host").alias("h"))), bits))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = _on(batch, both.value[0])
            for row, start, gram, prefix in _text_windows(batch, min_run):
                some = np.flatnonzero(seen(both.value[1], gram))
                row, start, prefix = row[some], start[some], prefix[some]
                order = np.lexsort((start, prefix, row))
                first = np.ones(len(order), dtype=bool)
                first[1:] = (row[order][1:] != row[order][:-1]) | (prefix[order][1:] != prefix[order][:-1])
                row, start, prefix = row[order], start[order], prefix[order]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in (key, "_host")] + [pa.array(prefix.view(np.int64)), pa.array(start), pa.array(first)], [key, "host", "prefix", "start", "first"])

    suffixes = written(pages.mapInArrow(runs, f"`{key}` {kind}, host bigint, prefix bigint, start bigint, first boolean"), "suffixes")
    counted = suffixes.groupBy("host", "prefix").agg(F.count_if("first").alias("n")).join(totals, "host")
    common = counted.filter((2 * F.col("n") > F.col("rows")) & (F.col("n") >= min_pages)).select("host", "prefix")
    return suffixes.join(common, ["host", "prefix"]).groupBy(key).agg(F.collect_set("start").alias("starts"))


def repeated_tokens(pages: DataFrame, key: str, min_run: int = MIN_RUN) -> DataFrame:
    """(key, starts): at which tokens of a page (key, html, _host) that marks no article a run of min_run tokens begins that another page of the host has too."""
    kind = pages.schema[key].dataType.simpleString()
    spark = pages.sparkSession

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What several pages of a batch have is two rows for the batch, however many they are.
        for batch in batches:
            found, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for row, _, gram, _, _, _ in _windows(batch, min_run):
                new = np.ones(len(row), dtype=bool)
                new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
                found.append(gram[new])
                at.append(row[new])
            gram, row = np.concatenate(found), np.concatenate(at)
            order = np.lexsort((row, gram))
            gram, row = gram[order], row[order]
            edge = np.ones(len(gram) + 1, dtype=bool)
            edge[1:-1] = gram[1:] != gram[:-1]
            some = np.flatnonzero(edge[:-1] | edge[1:])
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row[some])), pa.array(gram[some].view(np.int64))], [key, "h"])

    both = (F.min(key).alias("_least"), F.max(key).alias("_most"))
    apart = F.col("_least") != F.col("_most")
    shared_grams = spark.sparkContext.broadcast(bitmap(pages.mapInArrow(grams, f"`{key}` {kind}, h bigint").groupBy("h").agg(*both).filter(apart).select("h")))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, start, gram, prefix, which, found in _windows(batch, min_run):
                some = np.flatnonzero(seen(shared_grams.value, gram))
                row, start, prefix = row[some], start[some], prefix[some]
                marked = np.array([p.marked for p in found], dtype=bool)[which[some]]
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), pa.array(prefix.view(np.int64)), pa.array(start), pa.array(marked)], [key, "prefix", "start", "marked"])

    suffixes = written(pages.mapInArrow(runs, f"`{key}` {kind}, prefix bigint, start bigint, marked boolean"), "suffixes")
    shared = suffixes.groupBy("prefix").agg(*both).filter(apart).select("prefix")
    return suffixes.filter("NOT marked").join(shared, "prefix").groupBy(key).agg(F.collect_set("start").alias("starts"))


def _unique_runs(page: _Page, starts: list[int], min_run: int) -> str:
    """The text of a page without the tokens that repeated runs cover; whole where they cover everything, or most of a marked article."""
    last = max((b["first"] + b["length"] for b in page.blocks), default=0)
    change = [0] * (last + 1)
    for s in starts:
        if s < last:
            change[s] += 1
            change[min(s + min_run, last)] -= 1
    covered, depth = [], 0
    for c in change:
        depth += c
        covered.append(depth > 0)
    kept, gone, every = [], 0, 0
    for b in page.blocks:
        tokens = b["text"].split(" ")
        left = [t for i, t in enumerate(tokens, b["first"]) if not covered[i]]
        gone, every = gone + len(tokens) - len(left), every + len(tokens)
        if left:
            kept.append(" ".join(left))
    return "\n\n".join(b["text"] for b in page.blocks) if not kept or page.marked and 2 * gone > every else "\n\n".join(kept)


def repeats_of(pages: DataFrame, key: str, min_run: int = MIN_RUN) -> DataFrame | None:
    """(key, starts) of the pages (key, html, _host) that lose something; None if none does."""
    reported = written(host_grams(pages, min_run), "host-grams")
    totals = reported.filter("gram IS NULL").groupBy("host").agg(F.sum("n").alias("rows"), F.sum("half").alias("halves"), F.sum("unmarked").alias("unmarked"))
    totals = written(totals, "hosts")
    found = common_tokens(pages, reported.filter("gram IS NOT NULL"), totals.select("host", "rows", "halves"), key, min_run)
    unmarked = bitmap(totals.filter("unmarked > 0").select(F.col("host").alias("h")))
    if unmarked.any():
        shared = pages.sparkSession.sparkContext.broadcast(unmarked)

        def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield _on(batch, shared.value)

        more = repeated_tokens(pages.mapInArrow(there, pages.schema), key, min_run)
        found = more if found is None else found.unionByName(more).groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"))
    return found


def extract(pages: DataFrame, key: str = "page_id", min_run: int = MIN_RUN) -> DataFrame:
    """(key, url, text, from_article) for every row of pages (key, url, html)."""
    kind = pages.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, url string, text string, from_article boolean"

    def texts(batch: pa.RecordBatch, starts: list) -> pa.RecordBatch:
        found = [_Page(x.as_py()) for x in batch.column("html")]
        out = [_unique_runs(p, s or [], min_run) for p, s in zip(found, starts, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(key), batch.column("url"), pa.array(out, pa.string()), pa.array([p.marked for p in found], pa.bool_())], [key, "url", "text", "from_article"])

    repeats = repeats_of(_hosted(pages, key), key, min_run)
    slot = F.xxhash64(key)
    slotted = pages.select(key, "url", "html", slot.alias("_slot"))
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    if repeats is not None:
        repeats = written(repeats, "repeats")
        bits = bitmap(repeats.select(slot.alias("h")))
    repeating = pages.sparkSession.sparkContext.broadcast(bits if bits.any() else None)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if repeating.value is not None:
                batch = batch.filter(pa.array(~seen(repeating.value, batch.column("_slot").to_numpy())))
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield texts(part, [None] * part.num_rows)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(seen(repeating.value, batch.column("_slot").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield texts(part, part.column("starts").to_pylist())

    if not bits.any():
        return slotted.mapInArrow(whole, schema)
    # Only pages that may have repeated runs meet these in a join.
    few = slotted.mapInArrow(likely, slotted.schema).join(repeats, key, "left").select(key, "url", "html", "starts")
    return slotted.mapInArrow(whole, schema).unionByName(few.mapInArrow(cut, schema))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    small_batches(spark, BATCH_BYTES)
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "from_article")
