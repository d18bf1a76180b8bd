"""Benchmark decontamination by spaced-seed hashing.

A seed looks at words in a row through a fixed mask and hashes only those that the mask lets through, so a substituted word
under a hole leaves the hash as it was. The seed hashes of the benchmark meet those of every place of every document, and
each meeting fixes an alignment of item and document, which is then verified word by word: it counts if some stretch of it
has at least 80 % of its words equal and holds ``least`` equal words, or 80 % of the words of a shorter item. The longest
such stretch is reported.

No such overlap is missed. A stretch of n words, n >= 5, with at most n / 5 substitutions leaves n - k words in k + 1 runs.
If n > 4 k + 3, a run has four words and the mask 1111 meets it; of other cases there are only n = 5, 6, 7 with k = 1,
n = 10, 11 with k = 2 and n = 15 with k = 3, each of which is met by one of the three masks with a hole. Items of fewer
than five words allow no substitution and are looked up by all their words together.

Seeds that continue a meeting of the place before add nothing, since that one has the same alignment; they are passed
over by looking the seed up together with its predecessor. Repetitive texts and items thus cost the sum of their lengths
and not the product.

The benchmark is cut into blocks of a bounded number of words, whose indexes are files of the shared folder; neither the
driver nor a broadcast ever holds them. A task hashes its texts once and goes through the blocks one at a time, whatever
their number. No document is shuffled.

Nulls: a null text is an empty one; items without words match nothing; rows with null ids are reported under null. Ids may
be of any type. Repeated rows are reported alike; of equal overlaps of a document and an item the first in the text is
reported. Extra columns are ignored by ``overlaps`` and kept by ``clean``. An empty table gives an empty result. Texts of
any length are whole.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, cut, give_back, new_path, offsets, read_bytes, values, write_bytes
from .tokens import mix, words

#: Fixed masks: 1 lets a word through.
MASKS = ("1111", "10111", "11011", "11101")
#: Words of the shortest item that may have a substitution.
SHORTEST = 5
LEAST = 13
AGREEMENT = 0.8
#: Words of a block of the benchmark, about; its index takes some 150 bytes for each.
BLOCK_WORDS = 1 << 18
#: Bytes of text that a task looks up at once, with few and with many blocks.
FEW, TEXT_BYTES, MORE_BYTES = 2, 4 << 20, 32 << 20
#: Rows of hits or of compared words that are held at once.
STEP = 1 << 20
_BITS = 22


def seed_hashes(hashes: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of each place's words through the mask, never 0; salt tells masks apart."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), salt + 1, np.uint64)
    for i, x in enumerate(mask if n > 0 else ""):
        if x == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(out) | np.uint64(1)


def seeds(hashes: np.ndarray, begins: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, seed, seed of the place before) of each place whose words lie in one text; 0: no place before."""
    h = seed_hashes(hashes, mask, salt)
    real = np.ones(len(h) + 1, bool)
    for back in range(1, len(mask)):
        at = begins[1:] - back
        real[at[(at >= 0) & (at < len(h))]] = False
    real[-1] = False
    at = np.flatnonzero(real)
    first = np.zeros(len(real), bool)
    first[begins[begins < len(real)]] = True
    before = np.where(real[at - 1] & ~first[at], h[at - 1], np.uint64(0)) if len(h) else np.zeros(0, np.uint64)
    return at, h[at], before


class Index:
    """Seeds of one mask over some items."""

    def __init__(self, mask: str, salt: int, hashes: np.ndarray, begins: np.ndarray, wanted: np.ndarray):
        self.mask, self.salt = mask, salt
        place, h, before = seeds(hashes, begins, mask, salt)
        own = wanted[np.searchsorted(begins, place, "right") - 1]
        place, h, before = place[own], h[own], before[own]
        self.seeds, number = np.unique(h, return_inverse=True)
        self.earlier, earlier = np.unique(before, return_inverse=True)
        pair = number * len(self.earlier) + earlier
        order = np.argsort(pair, kind="stable")
        self.place, self.pair = place[order], pair[order]
        self.at = np.searchsorted(self.pair, np.arange(len(self.seeds) + 1) * len(self.earlier))

    @cached_property
    def filter(self) -> np.ndarray:
        """Which leading bits some seed has; made after loading."""
        out = np.zeros(1 << _BITS, bool)
        out[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        return out

    def hits(self, place: np.ndarray, h: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the texts, place in the items) of the seeds that meet and don't continue a meeting, some at a time."""
        near = np.flatnonzero(self.filter[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        number = np.searchsorted(self.seeds, h[near])
        found = number < len(self.seeds)
        found[found] = self.seeds[number[found]] == h[near][found]
        near, number = near[found], number[found]
        if not len(near):
            return
        earlier = np.minimum(np.searchsorted(self.earlier, before[near]), len(self.earlier) - 1)
        pair = np.where((self.earlier[earlier] == before[near]) & (before[near] != 0), number * len(self.earlier) + earlier, -1)
        low, high = self.at[number], self.at[number + 1]
        a = np.where(pair < 0, high, np.searchsorted(self.pair, pair, "left"))  # [a, b) continues
        b = np.where(pair < 0, high, np.searchsorted(self.pair, pair, "right"))
        starts, n = np.concatenate([low, b]), np.concatenate([a - low, high - b])
        near = np.tile(place[near], 2)
        real = np.flatnonzero(n)
        starts, n, near = starts[real], n[real], near[real]
        group = np.cumsum(n) // STEP
        for some in np.split(np.arange(len(n)), np.flatnonzero(np.diff(group)) + 1):
            rows = np.repeat(starts[some] - (np.cumsum(n[some]) - n[some]), n[some]) + np.arange(int(n[some].sum()))
            yield np.repeat(near[some], n[some]), self.place[rows]


class Block:
    """Some benchmark items, ready for lookup. column: their texts."""

    def __init__(self, ids: pa.Array, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        self.ids = ids
        self.hashes, self.begins = words(values(column), offsets(column))
        size = np.diff(self.begins)
        shapes = [(m, s, size >= SHORTEST) for s, m in enumerate(MASKS)] + [("1" * n, 100 + n, size == n) for n in range(1, SHORTEST)]
        self.indexes = [Index(m, s, self.hashes, self.begins, wanted) for m, s, wanted in shapes if wanted.any()]

    def item(self, n: int) -> np.ndarray:
        return self.hashes[self.begins[n] : self.begins[n + 1]]

    def alignments(self, hashes: np.ndarray, begins: np.ndarray, made: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (text, item, place of the item's first word in the text), in this order. made: keeps the texts' seeds from block to block."""
        far = int(np.diff(self.begins).max(initial=0))
        width, many = int(np.diff(begins).max(initial=0)) + far + 1, len(self.ids)
        if width * many * len(begins) >= 1 << 63:
            raise OverflowError("too many texts at once")
        codes = [np.zeros(0, np.int64)]
        for index in self.indexes:
            if index.salt not in made:
                made[index.salt] = seeds(hashes, begins, index.mask, index.salt)
            for place, other in index.hits(*made[index.salt]):
                doc, n = np.searchsorted(begins, place, "right") - 1, np.searchsorted(self.begins, other, "right") - 1
                shift = place - begins[doc] - (other - self.begins[n])
                codes.append(np.unique((doc * many + n) * width + shift + far))
        code = np.unique(np.concatenate(codes))
        both, shift = code // width, code % width - far
        return both // max(many, 1), both % max(many, 1), shift


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(first place in the item, one past the last, equal words) of the longest stretch with 80 % of its words equal, the
    first of equal ones, when item[i] lies on text[shift + i]; it begins and ends with an equal word."""
    a, b = max(0, -shift), min(len(item), len(text) - shift)
    same = text[shift + a : shift + b] == item[a:b]
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    ahead = np.maximum.accumulate(score[::-1])[::-1]  # the best score from a place on never grows
    size = np.searchsorted(-ahead, -score, "right") - 1 - np.arange(len(score))
    start = int(np.argmax(size))
    real = np.flatnonzero(same[start : start + int(size[start])])
    if not len(real):
        return a, a, 0
    return a + start + int(real[0]), a + start + int(real[-1]) + 1, len(real)


def enough(size: int | np.ndarray, least: int) -> np.ndarray:
    """Equal words that an overlap with an item of so many words must have."""
    return np.minimum(least, np.ceil(AGREEMENT * np.asarray(size) - 1e-9)).astype(np.int64)


def found_in(hashes: np.ndarray, begins: np.ndarray, block: Block, least: int, made: dict, once: bool = False) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, item, first place in the text, words, equal words) of every verified alignment. once: one for each text."""
    doc, item, shift = block.alignments(hashes, begins, made)
    need = enough(np.diff(block.begins), least)
    a, b = np.maximum(0, -shift), np.minimum(np.diff(block.begins)[item], np.diff(begins)[doc] - shift)
    group = np.cumsum(b - a) // STEP
    done: dict[tuple[int, int], bool] = {}
    for some in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(group)) + 1):
        if not len(some):
            continue
        size = (b - a)[some]
        along = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        here = np.repeat((begins[doc] + shift + a)[some], size) + along
        there = np.repeat((block.begins[item] + a)[some], size) + along
        equal = np.concatenate([[0], np.cumsum(hashes[here] == block.hashes[there])])
        ends = np.cumsum(size)
        for i in some[equal[ends] - equal[ends - size] >= need[item[some]]].tolist():
            d, n = int(doc[i]), int(item[i])
            key = (d, -1 if once else n)
            if done.get(key):
                continue
            own = block.item(n)
            start, end, same = overlap(hashes[begins[d] : begins[d + 1]], own, int(shift[i]))
            if same >= need[n]:
                done[key] = once or same == len(own)  # nothing that comes later can be better
                yield d, n, int(shift[i]) + start, end - start, same


def blocks(benchmark: DataFrame) -> list[str]:
    """Files with the Blocks of the benchmark. The driver gets their names alone."""
    rows = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    folder = new_path(benchmark.sparkSession, "benchmark")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", 6 * BLOCK_WORDS):
                target = f"{folder}/{uuid.uuid4().hex}.seeds"
                write_bytes(target, pickle.dumps(Block(part.column("item_id"), part.column("text")), 5))
                yield pa.RecordBatch.from_arrays([pa.array([target])], names=["path"])
        give_back()

    dealt = rows.repartition(int(1 + size // (6 * BLOCK_WORDS)))
    return [r["path"] for r in cut(dealt.mapInArrow(run, "path string"), "benchmark-blocks").collect()]


_worker: dict[str, Block] = {}


def load(path: str, keep: bool) -> Block:
    if path in _worker:
        return _worker[path]
    if not keep or len(_worker) >= FEW:
        _worker.clear()
    block = pickle.loads(read_bytes(path))
    if keep:
        _worker[path] = block
    return block


def looked_up(batches: Iterator[pa.RecordBatch], paths: list[str], least: int, once: bool = False) -> Iterator[tuple[pa.RecordBatch, Iterator]]:
    """Each part of the batches with (block, hit) of all its verified alignments."""
    few = len(paths) <= FEW
    for batch in batches:
        for part in chunks(batch, "text", TEXT_BYTES if few else MORE_BYTES):
            texts = part.column("text")
            texts = texts.fill_null("") if texts.null_count else texts
            hashes, begins = words(values(texts), offsets(texts))
            made: dict = {}
            yield part, ((block, hit) for block in (load(p, few) for p in paths) for hit in found_in(hashes, begins, block, least, made, once))
    give_back()


def overlaps(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, n_equal): the longest verified overlap of each document row and item row."""
    names = ["doc_id", "item_id", "start_word", "n_words", "n_equal"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start_word long, n_words long, n_equal long"
    paths = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(part: pa.RecordBatch, block: Block, best: dict[tuple[int, int], tuple[int, int, int]]) -> pa.RecordBatch:
            doc, item = zip(*best, strict=True)
            equal, start, size = zip(*best.values(), strict=True)
            return pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc)), block.ids.take(pa.array(item)), *(pa.array(x, pa.int64()) for x in ([-s for s in start], size, equal))], names=names)

        for part, found in looked_up(batches, paths, least):
            last, best = None, {}
            for block, (d, n, start, size, equal) in found:
                if best and block is not last:
                    yield rows(part, last, best)
                    best = {}
                last = block
                best[d, n] = max(best.get((d, n), (0, 0, 0)), (equal, -start, size))
            if best:
                yield rows(part, last, best)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def clean(docs: DataFrame, benchmark: DataFrame, *, least: int = LEAST) -> DataFrame:
    """docs without the rows that hold a verified overlap; nothing is shuffled."""
    paths = blocks(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in looked_up(batches, paths, least, once=True):
            keep = np.ones(part.num_rows, bool)
            for _, (d, *_) in found:
                keep[d] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
