"""SimHash near-duplicate groups by pigeonring filtering.

A fingerprint is cut into ``segments`` consecutive runs of bits, seen as a ring. If two fingerprints differ in at most t
bits, some start exists from which every chain of l consecutive segments differs in at most l * t / segments bits
(rounded down): were it not so, the chains that break their budget would cover the ring and add up to more than t. The
first ``chain`` segments of such a start therefore hold a fixed number of equal segments in one of few patterns, and each
(start, pattern) gives one blocking key: the bits of the equal segments. Fingerprints that share a key are candidates of
that start; the budgets of all longer chains prune them before the full Hamming check.

Equal fingerprints are one class from the start, so copies cost one row. Keys are counted first; the fingerprints of a
key with up to ``bucket`` of them are compared in one task, which emits a spanning forest and not pairs. The fingerprints
of larger keys are linked exactly without comparing them: each one marks the points within floor(t / 2) bits of it and
looks up the points within ceil(t / 2) bits; every point keeps one marker, and whoever finds the point is linked to it.
Such links are true (floor + ceil = t), and any linked pair meets in a point, so components are whole; the rows are
linear in the number of fingerprints, however dense the group.

Nulls: a null text is an empty one (fingerprint zero, linked like any other); a row with a null id gets the component of
its class, whose id is the smallest non-null one. Repeated rows fall into one class. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .shared import cut, give_back

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = 8 << 20
SEED = 42


def word_blocks(data: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text; those of very long ones in blocks that repeat the last `overlap` words."""
    if len(data) <= LONG:
        yield data.split()
        return
    block: list[bytes] = []
    for m in WORD.finditer(data):
        block.append(m[0])
        if len(block) > 1 << 17:
            yield block
            block = block[len(block) - overlap :]
    yield block


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash of the word shingles of a text, A-Z lower-cased."""
    import xxhash

    hashed, total, ones = xxhash.xxh64_intdigest, 0, np.zeros(64, np.int64)
    for w in word_blocks((text or "").encode().lower(), shingle - 1):
        if len(w) >= shingle:
            h = [hashed(b" ".join(s), seed) for s in zip(*(w[i:] for i in range(shingle)), strict=False)]
        elif w and not total:
            h = [hashed(b" ".join(w), seed)]
        else:
            continue
        total += len(h)
        ones += np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0]) if total else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of docs(doc_id, text); fp holds the bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def ring(segments: int) -> list[int]:
    """Bit masks of the segments, as even as 64 bits allow."""
    edges = [64 * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def patterns(segments: int, chain: int, distance: int) -> list[tuple[int, ...]]:
    """Places in a chain whose segments must be equal: the smallest sets that leave every prefix within its budget."""
    budget = [n * distance // segments for n in range(chain + 1)]
    sets = combinations(range(chain), chain - budget[chain])
    return [s for s in sets if all(n - sum(i < n for i in s) <= budget[n] for n in range(1, chain + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pairs_within(lists: pa.RecordBatch, masks: list[int], distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each row's fingerprints that pass the chain budgets of the row's start and then the Hamming check."""
    column = lists.column("fps")
    at = column.offsets.to_numpy()
    flat, sizes, starts = column.values.to_numpy(zero_copy_only=False).view(np.uint64), np.diff(at), lists.column("start").to_numpy(zero_copy_only=False)
    m, left, right = len(masks), [], []

    def check(a: np.ndarray, b: np.ndarray, s: int) -> None:
        used = np.zeros(len(a), np.int64)
        for n in range(1, m + 1):
            used += np.bitwise_count((a ^ b) & np.uint64(masks[(s + n - 1) % m]))
            ok = used <= n * distance // m
            a, b, used = a[ok], b[ok], used[ok]
        ok = np.bitwise_count(a ^ b) <= distance
        left.append(a[ok])
        right.append(b[ok])

    for k, s in {(int(k), int(s)) for k, s in zip(sizes, starts, strict=True)}:
        rows = np.flatnonzero((sizes == k) & (starts == s))
        if k > 256:  # some of a list against what follows them
            for row in rows:
                x = flat[at[row] : at[row] + k]
                for i in range(0, k, 64):
                    j, n = np.triu_indices(min(64, k - i), 1, k - i)
                    check(x[i + j], x[i + n], s)
            continue
        i, j = np.triu_indices(k, 1)
        for some in np.array_split(rows, max(1, len(rows) * len(i) >> 18)):
            grid = flat[at[some][:, None] + np.arange(k)]
            check(grid[:, i].ravel(), grid[:, j].ravel(), s)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]).view(np.int64), np.concatenate([none, *right]).view(np.int64)


def stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    found = forest(zip(a.tolist(), b.tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.int64())], names=["a", "b"])


def ball(radius: int) -> np.ndarray:
    """All 64-bit words with at most `radius` bits set."""
    words = [0, *(sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(64), r))]
    return np.array(words, np.uint64)


def dense_links(fps: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within distance, in rows linear in the number of fingerprints."""

    def points(radius: int):
        masks = ball(radius)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some in np.array_split(batch.column("fp").to_numpy(), max(1, batch.num_rows * len(masks) >> 20)):
                    point = (some.view(np.uint64)[:, None] ^ masks).ravel().view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(point), pa.array(np.repeat(some, len(masks)))], names=["point", "fp"])

        return fps.select("fp").mapInArrow(run, "point long, fp long")

    marked = points(distance // 2).groupBy("point").agg(F.min("fp").alias("a"))
    return points(distance - distance // 2).join(marked, "point").where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def links(classes: DataFrame, distance: int, segments: int, chain: int, bucket: int) -> DataFrame:
    """Links (a, b) among the distinct fingerprints of classes(fp)."""
    masks = ring(segments)
    shapes = [(s, reduce(int.__or__, (masks[(s + i) % segments] for i in p))) for s in range(segments) for p in patterns(segments, chain, distance)]
    key = [F.struct(F.xxhash64(F.lit(n), F.col("fp").bitwiseAND(F.lit(signed(mask)))).alias("key"), F.lit(s).alias("start")) for n, (s, mask) in enumerate(shapes)]
    keyed = classes.select("fp", F.explode(F.array(*key)).alias("k")).select("fp", "k.*")
    counts = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-keys")
    lists = keyed.join(counts.where(F.col("n") <= bucket).select("key"), "key").groupBy("key").agg(F.collect_list("fp").alias("fps"), F.min("start").alias("start")).select("fps", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield stars(*pairs_within(batch, masks, distance))

    found = lists.mapInArrow(run, "a long, b long")
    large = counts.where(F.col("n") > bucket).select("key")
    if large.isEmpty():
        return found
    return found.union(dense_links(keyed.join(large, "key").select("fp").distinct(), distance))


def groups(docs: DataFrame, *, shingle: int = 3, distance: int = 3, segments: int = 10, chain: int = 6, bucket: int = 512) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs(doc_id, text)."""
    prints = cut(fingerprints(docs, shingle), "simhash")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    roots = components(links(classes, distance, segments, chain, bucket))
    top = F.coalesce("component", "fp").alias("root")
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", top)
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = cut(rooted.join(ids, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(known, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
