"""Byte-level BPE by corpus-level merge replay.

Texts are cut into the matches of the tokenizer's pattern. The distinct new pieces of a block of documents are encoded
together: an inverted index maps each mergeable rank to the places (piece, position) where a pair of neighbours makes
that token, and the ranks are replayed in ascending order; a merge looks again only at the pairs to its left and right,
which may enter the index at any rank. Places of one rank are taken from left to right. Within a piece this is the order
in which the greedy encoder merges, so ids are the same. Encoded units stay in caches of bounded size while a task
runs.

Most of the cutting is done by a plain split at single spaces, since no match runs from a non-space into a space: a text
is the pieces of its first unit and those of each further unit with its space in front. Only where white space follows a
space can a match cover more than one unit; such texts are cut by the pattern as a whole.

Nulls: a null text is an empty one and has no ids. Ids and decoded bytes of any length are whole. Repeated rows are
encoded alike; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import operator
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import chunks, give_back

CACHE, WORDS = 300_000, 500_000
#: Bytes of text whose new pieces are replayed together: the more, the more places share a rank's step.
BLOCK_BYTES = 4 << 20
#: The white space of Unicode, which \s stands for in the pattern.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def load_ranks(path: str) -> dict[bytes, int]:
    """token -> rank, from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes pieces by replaying merges over an inverted index, the places of one rank at a time as vectors."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        made = {ranks[a] << 32 | ranks[b]: r for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks}
        self.keys = np.array(sorted(made), np.int64)
        self.made = np.array([made[k] for k in self.keys.tolist()], np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the tokens that neighbours a and b make; -1 where they make none."""
        key = a << 32 | b
        at = self.keys.searchsorted(key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.made[at], -1) if len(self.keys) else np.full(len(key), -1)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece; one that is a token is that token."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        todo = np.flatnonzero(whole < 0)
        sizes = np.fromiter((len(pieces[i]) for i in todo), np.int64, len(todo))
        token = self.byte[np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)]
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        ends = np.cumsum(sizes)
        self.replay(token, ends)
        alive = token >= 0
        cuts = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])]
        token, out = token[alive].astype("<u4"), list(whole.astype("<u4")[:, None])
        for i, a, b in zip(todo.tolist(), cuts.tolist(), cuts[1:].tolist(), strict=False):
            out[i] = token[a:b]
        return out

    def replay(self, token: np.ndarray, ends: np.ndarray) -> None:
        """Merge in place: a merged pair leaves its token at its first place and -1 at the other. ends: where pieces end."""
        n = len(token)
        if not n:
            return
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends[ends > 0] - 1] = -1
        before[np.concatenate([[0], ends])[:-1][np.diff(ends, prepend=0) > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            """Enter places into the index under the rank that their pair makes."""
            real = np.flatnonzero(ranks >= 0)
            if not len(real):
                return
            ranks, places = ranks[real], places[real]
            if len(real) > 1:
                order = ranks.argsort(kind="stable")
                ranks, places = ranks[order], places[order]
                cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            else:
                cuts = [0, 1]
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(ranks[a])
                if r in index:
                    index[r].append(places[a:b])
                else:
                    index[r] = [places[a:b]]
                    heapq.heappush(heap, r)

        first = np.flatnonzero(after >= 0)
        note(self.pair(token[first], token[first + 1]), first)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            p = found[0] if len(found) == 1 else np.concatenate(found)
            if len(p) > 1:
                p = np.sort(p)
                p = p[np.concatenate([[True], p[1:] != p[:-1]])]
            q = after[p]
            ok = np.flatnonzero((token[p] >= 0) & (q >= 0))
            p, q = p[ok], q[ok]
            ok = np.flatnonzero(self.pair(token[p], token[q]) == rank)  # else a neighbour was merged before
            p, q = p[ok], q[ok]
            if len(p) > 1 and (chained := q[:-1] == p[1:]).any():  # overlapping places: every second one, from the left
                at = np.arange(len(p))
                lead = np.concatenate([[True], ~chained])
                taken = (at - np.maximum.accumulate(np.where(lead, at, 0))) % 2 == 0
                p, q = p[taken], q[taken]
            if not len(p):
                continue
            end = after[q]
            token[p], token[q], after[p] = rank, -1, end
            more = end >= 0
            right, e = p[more], end[more]
            before[e] = right
            start = before[p]
            more = start >= 0
            left = start[more]
            a = np.concatenate([token[right], token[left]])
            b = np.concatenate([token[e], token[p[more]]])
            if len(a):
                note(self.pair(a, b), np.concatenate([right, left]))


def plain(text: str) -> bool:
    """No white space follows a space, and none ends the text after one: a cut before each space then is one of the pattern's."""
    if "  " in text or " \n" in text or " \t" in text or " \r" in text or text.endswith(" "):
        return False
    return text.isascii() and " \x0b" not in text and " \x0c" not in text or not any(c in text and " " + c in text for c in SPACES)


#: Punctuation that can only continue a run of itself after letters.
MARKS = ".,;:!?%#&$*()-\""


class Units:
    """Encodes texts by way of a cache of space-led units. encode: texts, each split on its own -> little-endian ids of each.

    With words > 0, a new unit of letters and then marks, which are two matches of the pattern, is put together from the
    ids of both; as many encoded words are kept. Letters are those up to U+024F, which all Unicode versions agree on.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], size: int = CACHE, words: int = 0):
        self.encode, self.size, self.words = encode, size, words
        self.cache: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # words with a space in front, and marks without

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.cache) > self.size:
            self.cache.clear()
        split = [text.split(" ") if plain(text) else None for text in texts]
        new = set().union(*(u[1:] for u in split if u)) - self.cache.keys()
        own = [u[0] if u else text for u, text in zip(split, texts, strict=True)]  # the first unit, or a whole text
        if self.words:
            new = self.composed(new)
        order = list(new)
        done = self.encode([*(" " + u for u in order), *own])
        self.cache.update(zip(order, done, strict=False))
        get = self.cache.__getitem__
        return [first + b"".join(map(get, u[1:])) if u else first for u, first in zip(split, done[len(order) :], strict=True)]

    def forget(self) -> None:
        """Empty the caches, which are worth their memory only while a task runs."""
        self.cache, self.known = {}, {}

    def composed(self, units: set[str]) -> list[str]:
        """Enter the units of letters and marks into the cache; returns the others."""
        if len(self.known) > self.words:
            self.known.clear()
        other, whole, words, marks = [], [], [], []
        for u in units:
            w = u.rstrip(MARKS)
            if w.isalpha() and (w.isascii() or max(w) < "\u0250"):
                whole.append(u)
                words.append(w)
                marks.append(u[len(w) :])
            else:
                other.append(u)
        known = self.known
        new, ends = list(set(words) - known.keys()), list(set(marks) - known.keys())
        known.update(zip(new + ends, self.encode([*(" " + w for w in new), *ends]), strict=True))
        get = known.__getitem__
        self.cache.update(zip(whole, map(operator.add, map(get, words), map(get, marks)), strict=True))
        return other


def replay_encoder(path: str, pattern: str) -> Callable[[list[str]], list[bytes]]:
    """texts -> ids as little-endian unsigned 32-bit integers."""
    import regex

    replay, find = MergeReplay(load_ranks(path)), regex.compile(pattern).findall

    def encode(texts: list[str]) -> list[bytes]:
        split = [find(t) for t in texts]
        new = list(set().union(*split))
        done = {piece: ids.tobytes() for piece, ids in zip(new, replay.encode([p.encode() for p in new]), strict=True)}
        return [done[s[0]] if len(s) == 1 else b"".join(map(done.__getitem__, s)) for s in split]

    return encode


_worker: dict = {}


def worker_units(kind: Callable[..., Callable], *args, words: int = 0) -> Units:
    """One encoder for each Python worker; its tables are kept from task to task."""
    key = (kind.__name__, words, *args)
    if key not in _worker:
        _worker.clear()
        _worker[key] = Units(kind(*args), words=words)
    return _worker[key]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs(doc_id, text); ids: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = worker_units(replay_encoder, path, pattern, words=WORDS)
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                ids = units([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])
        units.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def decoder(path: str) -> Callable[[bytes], bytes]:
    """ids as little-endian unsigned 32-bit integers -> the bytes that they stand for."""
    ranks = load_ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return lambda ids: b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of encode() with one more column, decoded: the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(path)
        for batch in batches:
            for part in chunks(batch, "ids", BLOCK_BYTES):
                out = [back(x) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])
        give_back()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{kinds}, decoded binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one pass: (doc_id, n_tokens, ids, decoded). Half as many Python workers hold memory at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, back = worker_units(replay_encoder, path, pattern, words=WORDS), decoder(path)
        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                ids = units([t or "" for t in part.column("text").to_pylist()])
                columns = [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(back, ids), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"])
        units.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
