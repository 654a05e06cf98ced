"""Byte-level byte-pair encoding by merge replay over a whole slice of the corpus, and decoding.

A text is cut into matches of a pattern, each of which is encoded separately. A task reads several batches of texts
ahead, numbers their different matches and encodes those that it doesn't know together: all their bytes lie in one array,
and an inverted index maps each mergeable pair (known by the rank of what it merges to) to the positions where it stands.
The merges are replayed in rank order. One merge visits just the positions in its entry, all at once, joins the pair there
and enters the two pairs that this makes with the neighbours; nothing else is looked at. What the matches
became is then laid out along the texts by their numbers; those in frequent use are remembered for later texts of the worker.

In rank order a merge can only make pairs of later rank, if the ranks come from training; a
vocabulary may still hold a word whose merge makes an earlier pair. Such words are noticed and encoded one
at a time by the definition, so that ids are always those of lowest rank first, leftmost first. A match
that is a token itself is that token, as in the tiktoken library.

Defined results: null texts are encoded as empty ones: no ids. Repeated rows each get their row. Columns other than
the key and the text are not read, so their names don't matter. No text is cut: a long one is a piece of its own.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import documents

#: Bytes of different matches that are replayed together.
SLICE_BYTES = 1 << 20
#: Different matches that a worker remembers; of more it keeps half so many.
REMEMBERED = 100_000
#: New matches of texts that are read ahead are learnt together when they are so many, or the texts have so many characters; a row counts as some characters more.
NEW, GROUP_CHARS, ROW_CHARS = 100_000, 8 << 20, 100
#: Texts of about so many characters make an output batch.
OUT_CHARS = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Replay:
    """Encodes many words at once; tokens: the vocabulary by rank, with all single bytes."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = tokens
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Rank of what two bytes merge to, -1 if they don't.
        self.of_bytes = np.array([[self.ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], dtype=np.int32)
        # All pairs of tokens that merge, by the left one and by the right one.
        get = self.ranks.get
        cuts = [(x, y, r) for t, r in self.ranks.items() for i in range(1, len(t)) if (x := get(t[:i])) is not None and (y := get(t[i:])) is not None]
        left, right, merged = np.array(cuts, dtype=np.int32).reshape(-1, 3).T
        self.rights, self.lefts = self._table(left, right, merged), self._table(right, left, merged)

    def _table(self, one: np.ndarray, other: np.ndarray, merged: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(where each token's pairs begin, the other tokens, what they merge to)."""
        order = np.argsort(one, kind="stable")
        return np.searchsorted(one[order], np.arange(len(self.tokens) + 1)).tolist(), other[order], merged[order]

    def rank(self, left: int, right: int) -> int:
        """Rank of what the two tokens merge to, -1 if they don't."""
        return self.ranks.get(self.tokens[left] + self.tokens[right], -1)

    def one(self, word: bytes) -> list[int]:
        """By the definition: the pair of lowest rank, leftmost, again and again."""
        ids = [int(self.single[b]) for b in word]
        while len(ids) > 1:
            best, at = min(((r, i) for i in range(len(ids) - 1) if (r := self.rank(ids[i], ids[i + 1])) >= 0), default=(-1, -1))
            if best < 0:
                break
            ids[at : at + 2] = [best]
        return ids

    def many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, end of each word's ids with a 0 before)."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words], dtype=np.int64)])
        first, last = bounds[:-1][bounds[:-1] < bounds[1:]], bounds[1:][bounds[:-1] < bounds[1:]] - 1
        # One place beyond the end stands for what is before and after a word; nothing merges with it.
        end = len(data)
        symbols = np.append(self.single[data], np.int32(-1))
        after, before = np.arange(1, end + 2, dtype=np.int32), np.arange(-1, end, dtype=np.int32)
        after[last] = before[first] = after[end] = before[end] = end
        # pair[p]: rank of the pair that begins at p; index: positions by that rank.
        pair = np.full(end + 1, -1, dtype=np.int32)
        pair[: max(end - 1, 0)] = self.of_bytes[data[:-1], data[1:]]
        pair[last] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        odd: list[np.ndarray] = []
        # Ranks of the pairs with a token on one side, by the token on the other; always -1 between uses. The last is for the end.
        row = np.full(len(self.tokens) + 1, -1, dtype=np.int32)

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for rank, lo, hi in zip(ranks[cuts[:-1]].tolist(), cuts, cuts[1:], strict=False):
                if rank in index:
                    index[rank].append(places[lo:hi])
                else:
                    index[rank] = [places[lo:hi]]
                    heappush(heap, rank)

        def partners(table: tuple[list[int], np.ndarray, np.ndarray], r: int, others: np.ndarray) -> np.ndarray | None:
            """Ranks of the pairs of r with the others, -1 for those that don't merge; None if r merges with nothing."""
            begins, tokens, merged = table
            lo, hi = begins[r], begins[r + 1]
            if lo == hi:
                return None
            row[tokens[lo:hi]] = merged[lo:hi]
            found = row[others]
            row[tokens[lo:hi]] = -1
            return found

        def note(ranks: np.ndarray | None, places: np.ndarray, r: int) -> None:
            """Enters what merges; a rank before r makes a word odd."""
            if ranks is not None and (some := ranks >= 0).any():
                ranks, places = ranks[some], places[some]
                enter(ranks, places)
                if ranks.min() <= r:
                    odd.append(places[ranks <= r])

        places = np.flatnonzero(pair >= 0).astype(np.int32)
        if len(places):
            enter(pair[places], places)
        while heap:
            r = heappop(heap)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.concatenate(parts)
            p = p[pair[p] == r]
            if len(parts) > 1 and len(p) > 1:
                p.sort()
                p = p[np.append(True, p[1:] != p[:-1])]
            if not len(p):
                continue
            q = after[p]
            if (pair[q] == r).any():
                # Places that overlap, as in a run of one letter: from the left.
                taken, gone = [], -1
                p = np.sort(p)
                for x, y in zip(p.tolist(), after[p].tolist(), strict=True):
                    if x != gone:
                        taken.append(x)
                        gone = y
                p = np.array(taken, dtype=np.int32)
                q = after[p]
            nexts, befores = after[q], before[p]
            if (pair[nexts] == r).any():
                # Where two merges are neighbours, the left one's pair with the other's unmerged token lies between them in order.
                between = partners(self.rights, r, symbols[nexts])
                if between is not None and (early := (between >= 0) & (between <= r)).any():
                    odd.append(p[early])
            symbols[p] = r
            symbols[q] = pair[q] = pair[p] = -1
            after[p], before[nexts] = nexts, p
            before[end] = end
            pair[befores] = -1
            right, left = partners(self.rights, r, symbols[nexts]), partners(self.lefts, r, symbols[befores])
            if right is not None:
                pair[p] = right
            if left is not None:
                pair[befores] = left
            pair[end] = -1
            note(right, p, r)
            note(left, befores, r)
        alive = symbols[:-1] >= 0
        ids, ends = symbols[:-1][alive], np.concatenate([[0], np.cumsum(alive)])[bounds]
        if odd:
            again = set((np.searchsorted(bounds, np.concatenate(odd), side="right") - 1).tolist())
            parts = [np.array(self.one(w), dtype=np.int32) if i in again else ids[ends[i] : ends[i + 1]] for i, w in enumerate(words)]
            ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, ends


class _Numbers(dict):
    """Numbers of matches in the order in which they are met."""

    def __missing__(self, word: str) -> int:
        found = self[word] = len(self)
        return found


class Encoder:
    """Encodes texts, remembering the ids of matches it has met: texts are numbered, what is new is learnt at once, then ids are laid out."""

    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        self.replay, self.pattern = Replay(tokens), regex.compile(pattern)
        self.number = _Numbers()
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(1, np.int64)
        self.uses = np.zeros(0, np.int64)

    def unlearnt(self) -> int:
        """Different matches that are numbered only."""
        return len(self.number) - len(self.starts) + 1

    def numbered(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the matches of all texts, end of each text's with a 0 before)."""
        get = self.number.__getitem__
        found = [np.fromiter(map(get, words), dtype=np.int32, count=len(words)) for t in texts for words in [self.pattern.findall(t) if t else []]]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)])
        return np.concatenate([np.zeros(0, np.int32), *found]), ends

    def learn(self) -> None:
        """Encodes all that is numbered only."""
        if not self.unlearnt():
            return
        raw = [w.encode() for w in islice(self.number, len(self.starts) - 1, None)]
        whole = np.fromiter((self.replay.ranks.get(b, -1) for b in raw), dtype=np.int32, count=len(raw))
        ids, starts = [self.ids], [self.starts]
        lo = 0
        sizes = np.cumsum([len(b) for b in raw])
        while lo < len(raw):
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SLICE_BYTES, side="right")))
            # A match that is a token itself isn't replayed: it is empty there, and its token is put in.
            is_token = whole[lo:hi] >= 0
            found, ends = self.replay.many([b"" if t else b for b, t in zip(raw[lo:hi], is_token.tolist(), strict=True)])
            ids.append(np.insert(found, ends[:-1][is_token], whole[lo:hi][is_token]))
            starts.append(ends[1:] + np.cumsum(is_token) + starts[-1][-1])
            lo = hi
        self.ids, self.starts = np.concatenate(ids), np.concatenate(starts)

    def laid_out(self, which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's with a 0 before), from what numbered gave."""
        if len(self.uses) < len(self.number):
            self.uses = np.append(self.uses, np.zeros(len(self.number) - len(self.uses), np.int64))
        self.uses += np.bincount(which, minlength=len(self.uses))
        begin = self.starts[which]
        lengths = self.starts[which + 1] - begin
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], lengths)], ends[bounds]

    def forget(self) -> None:
        """Of more than REMEMBERED matches, keeps the half of so many that are used most, what is long ago counting less."""
        if len(self.number) > REMEMBERED:
            kept = np.sort(np.argpartition(-self.uses, REMEMBERED // 2)[: REMEMBERED // 2])
            words = list(self.number)
            self.number = _Numbers(zip((words[i] for i in kept.tolist()), range(len(kept)), strict=True))
            lengths = np.diff(self.starts)[kept]
            starts = np.concatenate([[0], np.cumsum(lengths)])
            self.ids = self.ids[np.arange(starts[-1]) + np.repeat(self.starts[kept] - starts[:-1], lengths)]
            self.starts, self.uses = starts, self.uses[kept]
        self.uses >>= 1

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, end of each text's ids with a 0 before)."""
        found = self.numbered(texts)
        self.learn()
        out = self.laid_out(*found)
        self.forget()
        return out


def _runs(column: pa.Array) -> Iterator[tuple[int, list[str | None], int]]:
    """(first row, texts, characters) of runs of about OUT_CHARS characters."""
    first, texts, size = 0, [], 0
    for i, value in enumerate(column):
        texts.append(value.as_py())
        size += len(texts[-1] or "")
        if size >= OUT_CHARS:
            yield first, texts, size
            first, texts, size = i + 1, [], 0
    if texts:
        yield first, texts, size


#: The encoder of this worker process, by vocabulary and pattern: what it remembers serves later tasks.
_ENCODERS: dict[tuple[str, str], Encoder] = {}

Batches = Iterator[pa.RecordBatch]


def _encoder(tokens: list[bytes], pattern: str, name: str) -> Encoder:
    if (name, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name, pattern] = Encoder(tokens, pattern)
    return _ENCODERS[name, pattern]


def _name(tokens: list[bytes]) -> str:
    return hashlib.sha1(b"\n".join(base64.b64encode(t) for t in tokens)).hexdigest()


def _encoded(batches: Batches, encoder: Encoder, keep: tuple[str, ...]) -> Batches:
    waiting: list[tuple[list[pa.Array], tuple[np.ndarray, np.ndarray]]] = []
    size = 0

    def ready() -> Batches:
        encoder.learn()
        for kept, found in waiting:
            ids, ends = encoder.laid_out(*found)
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], [*keep, "ids"])
        encoder.forget()
        waiting.clear()

    for batch in batches:
        for first, texts, chars in _runs(batch.column("text")):
            waiting.append(([batch.column(c).slice(first, len(texts)) for c in keep], encoder.numbered(texts)))
            size += chars + ROW_CHARS * len(texts)
            if size >= GROUP_CHARS or encoder.unlearnt() >= NEW:
                yield from ready()
                size = 0
    if waiting:
        yield from ready()


def _decoded(batches: Batches, tokens: list[bytes], keep: tuple[str, ...]) -> Batches:
    whole = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    for batch in batches:
        column = batch.column("ids")
        step = 256
        for lo in range(0, batch.num_rows, step):
            part = column.slice(lo, step)
            ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([len(x) if x.is_valid else 0 for x in part], dtype=np.int64)
            lengths = starts[ids + 1] - starts[ids]
            ends = np.concatenate([[0], np.cumsum(lengths)])
            data = whole[np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], lengths)]
            rows = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            out = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(rows.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(lo, step) for c in keep], out], [*keep, "decoded"])


def _kinds(df: DataFrame, keep: tuple[str, ...]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return "".join(f"`{c}` {kinds[c]}, " for c in keep)


def encode(docs: DataFrame, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of docs and ids, the tokens of the whole text. The vocabulary's size bounds what is broadcast."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tokens), _name(tokens)
    run = lambda batches: _encoded(batches, _encoder(shared.value, pattern, name), keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, _kinds(docs, keep) + "ids array<int>")


def decode(encoded: DataFrame, tokens: list[bytes], keep: tuple[str, ...] = ("doc_id", "ids")) -> DataFrame:
    """The kept columns of encoded and decoded, the bytes that the ids stand for; null ids stand for none."""
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    run = lambda batches: _decoded(batches, shared.value, keep)
    return encoded.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, _kinds(encoded, keep) + "decoded binary")


def round_trip(docs: DataFrame, tokens: list[bytes], pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids, and decoded from these ids, in one pass through Python."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tokens), _name(tokens)

    def run(batches: Batches) -> Batches:
        return _decoded(_encoded(batches, _encoder(shared.value, pattern, name), keep), shared.value, (*keep, "ids"))

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, _kinds(docs, keep) + "ids array<int>, decoded binary")


def digests(docs: DataFrame, tokens: list[bytes] | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for every row of docs (doc_id, text)."""
    tokens = tokens or load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    found = round_trip(docs, tokens)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with the 50k vocabulary, and decoded again."""
    return digests(documents(spark, sf_dir).select("doc_id", "text"))
