"""Token ids in binary shards, compressed by Re-Pair grammars.

Texts are dealt out by ranges of doc_id and sorted, so shards hold ascending documents. Each text is encoded with the
tokenizers library, an end id is appended, and every shard is compressed by Re-Pair: the frequent pairs of neighbouring
ids are counted, the most frequent ones that don't compete for an id are replaced by new nonterminals, and so on until no
pair is frequent. Pairs never cross a document, so each document is a run of symbols of its own. A shard stores the
rules, how many ids each rule expands to, the symbols, and where each document begins among the symbols and among the
ids: any document, or any range of ids within it, is decoded without the rest.

File layout, little-endian: magic ``RPG2``; 8 longs (documents, ids, symbols, rules, first nonterminal, bytes of a
symbol, 0, 0); doc ids (long), symbol starts (long, one more than documents), id starts (same); rules (2 x uint32 each);
expansion lengths (uint32 each); symbols (uint16 or uint32, as the largest needs); one byte for each document: 1 if its
id is null.

Shards are files of the shared folder under names that no other task attempt uses; the manifest lists those of committed
tasks, and from it each shard's first position in the whole id stream is summed.

doc_id must be an integer column, since files hold 64-bit ids; others are refused with a TypeError. Nulls: a null text is
an empty one and has the end id alone; null ids come first and stay null. Rows that repeat a doc_id are neighbours, in
the order of their texts' hashes. An empty table gives no shard and no row. Texts of any length are whole; one that is
longer than a shard is a shard of its own. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import chunks, cut, give_back, new_path, read_bytes, small_batches, write_bytes
from .tiles import Library, Tiles

MAGIC = b"RPG2"
#: Ids of a shard, about; bounds a task's memory.
SHARD_IDS = 2_000_000
#: Bytes of text for each task that writes shards.
TASK_BYTES = 20 << 20
MAX_PARTS = 100_000
#: Bytes of text that are looked up at once.
BLOCK_BYTES = 2 << 20
#: How often a pair must occur in a shard to get a rule, which takes 12 bytes there.
LEAST = 32
MANIFEST = "part int, place int, path string, n_docs long, n_ids long"
_SLOT_BITS = 20

_worker: dict[str, Tiles] = {}


def worker_tiles(path: str) -> Tiles:
    """One encoder with its tables for each Python worker, kept from task to task."""
    if path not in _worker:
        _worker.clear()
        _worker[path] = Tiles(Library(path))
    return _worker[path]


def slots(codes: np.ndarray) -> np.ndarray:
    """Place of each pair code in a table of 2 ** _SLOT_BITS."""
    out = codes * np.uint64(0x9E3779B97F4A7C15)
    out >>= np.uint64(64 - _SLOT_BITS)
    return out.view(np.int64)


def choose(often: np.ndarray) -> np.ndarray:
    """Of pair codes, the most frequent first: those whose left and right ids no earlier one has on the other side, so that
    no two replacements overlap, and whose slots differ. The others get their turn in a later round."""
    lefts, rights, taken, chosen = set(), set(), set(), []
    for code, slot in zip(often.tolist(), slots(often).tolist(), strict=True):
        a, b = code >> 32, code & 0xFFFFFFFF
        # a pair of one id overlaps itself, so no other pair may have that id in this round
        if a in rights or b in lefts or slot in taken or a == b and (a in lefts or b in rights):
            continue
        lefts.add(a)
        rights.add(b)
        if a == b:
            rights.add(a)
            lefts.add(b)
        taken.add(slot)
        chosen.append(code)
    return np.array(sorted(chosen), np.uint64)


def compress(ids: np.ndarray, starts: np.ndarray, base: int, *, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over documents that begin at starts (one more: the end): (symbols, starts among the symbols, rules).

    Rule r makes symbol base + r. A round counts pairs, chooses frequent ones and replaces them from left to right in a
    linked list. Only places whose pair was frequent before or holds a new symbol are looked at again: a pair of older
    symbols never becomes more frequent, so every count that matters is exact. Rounds end when no pair is frequent.
    """
    n, none = len(ids), np.uint32(0xFFFFFFFF)
    token, after, before = ids.astype(np.uint32), np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[starts[1:][starts[1:] > 0] - 1] = -1
    before[starts[:-1][starts[:-1] < n]] = -1
    rules, size = [np.zeros((0, 2), np.int64)], base
    at = np.flatnonzero(after >= 0).astype(np.int32)
    while len(at):
        code = token[at].astype(np.uint64)
        code <<= np.uint64(32)
        code |= token[after[at]]
        runs = np.sort(code)
        begin = np.concatenate([[0], np.flatnonzero(runs[1:] != runs[:-1]) + 1])
        counts = np.diff(begin, append=len(runs))
        often = np.flatnonzero(counts >= least)
        if not len(often):
            break
        often = runs[begin[often[np.argsort(-counts[often], kind="stable")]]]
        del runs, begin, counts  # each is as long as the shard
        made = choose(often)
        slot = slots(code)
        warm, number = np.zeros(1 << _SLOT_BITS, bool), np.zeros(1 << _SLOT_BITS, np.int32)
        warm[slots(often)] = True
        number[slots(made)] = np.arange(len(made))
        near = np.flatnonzero(warm[slot])  # every place of a frequent pair, and a few others
        at, code, own = at[near], code[near], number[slot[near]]
        del slot, near
        hit = made[own] == code
        p, own = at[hit], own[hit]
        del code
        q = after[p]
        if len(p) > 1 and (chained := q[:-1] == p[1:]).any():  # runs of one id: every second place, from the left
            along = np.arange(len(p))
            lead = np.concatenate([[True], ~chained])
            taken = (along - np.maximum.accumulate(np.where(lead, along, 0))) % 2 == 0
            p, q, own = p[taken], q[taken], own[taken]
        end = after[q]
        token[p], token[q], after[p] = (size + own).astype(np.uint32), none, end
        before[end[end >= 0]] = p[end >= 0]
        start = before[p]
        again = np.zeros(n, bool)
        again[at[~hit]] = again[p] = again[start[start >= 0]] = True
        again[q] = False
        at = np.flatnonzero(again).astype(np.int32)
        at = at[after[at] >= 0]
        rules.append(np.stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)], 1).astype(np.int64))
        size += len(made)
    alive = token != none
    return token[alive], np.concatenate([[0], np.cumsum(alive)])[starts], np.concatenate(rules)


def batches_of(rules: np.ndarray, base: int) -> Iterator[tuple[int, int]]:
    """Ranges of rules none of which refers to another of its range."""
    largest, at = np.maximum.accumulate(rules.max(1)) if len(rules) else np.zeros(0, np.int64), 0
    while at < len(rules):
        end = int(np.searchsorted(largest, base + at, "left"))
        yield at, end
        at = end


def lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each rule expands to. A rule's parts are ids or earlier rules."""
    out = np.ones(len(rules) + 1, np.int64)  # the last stands for plain ids
    part = np.where(rules >= base, rules - base, len(rules))
    for a, b in batches_of(rules, base):
        out[a:b] = out[part[a:b]].sum(1)
    return out[:-1]


class Expansions:
    """What every symbol stands for, laid out one after another."""

    def __init__(self, rules: np.ndarray, base: int):
        self.size = np.concatenate([np.ones(base, np.int64), lengths(rules, base)])
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.ids = np.empty(int(self.size.sum()), np.uint32)
        self.ids[:base] = np.arange(base)
        for a, b in batches_of(rules, base):
            self.ids[self.start[base + a] : self.start[base + b - 1] + self.size[base + b - 1]] = self(rules[a:b].ravel())

    def __call__(self, symbols: np.ndarray) -> np.ndarray:
        size = self.size[symbols]
        if not len(size):
            return np.zeros(0, np.uint32)
        shift = self.start[symbols]
        shift[1:] -= np.cumsum(size[:-1])
        return self.ids[np.repeat(shift, size) + np.arange(int(size.sum()))]


def pack(doc_ids: list[int | None], ids: np.ndarray, starts: np.ndarray, base: int) -> bytes:
    """A shard; starts: where each document begins among the ids, and where the last ends."""
    symbols, at, rules = compress(ids, starts, base)
    null = np.array([x is None for x in doc_ids], np.uint8)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    head = np.array([len(doc_ids), len(ids), len(symbols), len(rules), base, width, 0, 0], "<i8")
    own = np.array([0 if x is None else x for x in doc_ids], "<i8")
    parts = [head, own, at.astype("<i8"), starts.astype("<i8"), rules.astype("<u4"), lengths(rules, base).astype("<u4"), symbols.astype(f"<u{width}"), null]
    return MAGIC + b"".join(x.tobytes() for x in parts)


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard")
        docs, _, symbols, rules, self.base, width = np.frombuffer(data, "<i8", 6, 4).tolist()
        at = 4 + 64

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        ids, self.starts, self.id_starts = take("<i8", docs), take("<i8", docs + 1), take("<i8", docs + 1)
        self.rules = take("<u4", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        self.doc_ids = [None if null else i for i, null in zip(ids.tolist(), take("<u1", docs).tolist(), strict=True)]
        self.expand = Expansions(self.rules, self.base)

    def document(self, n: int) -> np.ndarray:
        return self.expand(self.symbols[self.starts[n] : self.starts[n + 1]])

    def slice(self, n: int, start: int, end: int) -> np.ndarray:
        """Ids start:end of document n; only the symbols that reach into the range are expanded."""
        own = self.symbols[self.starts[n] : self.starts[n + 1]].astype(np.int64)
        size = np.ones(len(own), np.int64)
        size[own >= self.base] = self.lengths[own[own >= self.base] - self.base]
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, end, "left")) + 1
        first = int(ends[a - 1]) if a else 0
        return self.expand(own[a:b])[start - first : end - first]


def write(docs: DataFrame, path: str, folder: str, *, end_id: int = 0) -> DataFrame:
    """Write docs(doc_id, text) as shards in ascending doc_id order; returns the manifest, whose (part, place) is the order of the shards."""
    if docs.schema["doc_id"].dataType.typeName() not in ("long", "integer", "short", "byte"):
        raise TypeError("doc_id must be an integer column")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the hash splits rows that share an id; equal rows may lie in any order
    order = (F.asc_nulls_first("doc_id"), F.xxhash64("text").asc())
    ordered = rows.repartitionByRange(max(1, min(MAX_PARTS, size // TASK_BYTES)), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tiles = worker_tiles(path)
        base = max(tiles.library.n_ids, end_id + 1)
        place, n, doc_ids, ids, end = 0, 0, [], [], np.array([end_id], "<u4").tobytes()

        def close():
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            target = f"{folder}/{uuid.uuid4().hex}.rpg"
            write_bytes(target, pack(doc_ids, np.frombuffer(b"".join(ids), "<u4"), starts, base))
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([place], pa.int32()), pa.array([target]), pa.array([len(ids)]), pa.array([int(starts[-1])])], names=["part", "place", "path", "n_docs", "n_ids"])

        for batch in batches:
            for part in chunks(batch, "text", BLOCK_BYTES):
                for doc, own in zip(part.column("doc_id").to_pylist(), tiles(part.column("text")), strict=True):
                    doc_ids.append(doc)
                    ids.append(own + end)
                    n += len(own) // 4 + 1
                    if n >= SHARD_IDS:
                        yield close()
                        place, n, doc_ids, ids = place + 1, 0, [], []
        if ids:
            yield close()
        doc_ids, ids = [], []
        give_back()

    return ordered.mapInArrow(run, MANIFEST)


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document of the shards; start: the ids of all documents before it."""
    # sums before each part (write() makes at most MAX_PARTS), and before each shard within its part
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    shards = manifest.select("part", "path", F.col("n_ids").alias("n"), "place").withColumn("own", before(Window.partitionBy("part").orderBy("place")))
    work = shards.join(parts, "part").select("path", (F.col("base") + F.col("own")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(read_bytes(row["path"]))
                for a in range(0, len(shard.doc_ids), 500):
                    b = min(a + 500, len(shard.doc_ids))
                    ids = shard.expand(shard.symbols[shard.starts[a] : shard.starts[b]]).astype("<u4", copy=False)
                    cuts = shard.id_starts[a : b + 1] - shard.id_starts[a]
                    texts = [ids[i:j].tobytes() for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[a:b], pa.int64()), pa.array(row["first"] + shard.id_starts[a:b]), pa.array(texts, pa.binary())], names=["doc_id", "start", "ids"])

    return work.repartition(max(1, min(100_000, manifest.count()))).mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, path: str, *, end_id: int = 0) -> DataFrame:
    """Write the shards and read them back: (doc_id, start, n_tokens, ids_crc32)."""
    with small_batches(spark):
        manifest = cut(write(docs, path, new_path(spark, "token-ids"), end_id=end_id), "token-ids-manifest")
    return read(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


