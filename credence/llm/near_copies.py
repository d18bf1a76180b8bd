"""Near-copy removal: SimHash candidates by pigeonring filtering, verified on word shingles.

Equal texts are one kind, which the smallest id stands for. Every kind gets fingerprints of its distinct words, one for
each salt, since a few edits change few of them; texts whose shingles of five words are 80 % the same nearly always lie
within ``distance`` bits in one of two fingerprints (measured in the tests and the README). A kind goes if a kind before it,
in the order of smallest ids, lies within that distance in some salt and has a Jaccard similarity of ``similarity`` or more,
computed on the whole texts. So no two linked kinds stay, and of each group of links the first stays.

*Candidates.* Of any two fingerprints within the distance, some start of the ring of segments has every chain of l segments
within l * distance / segments bits (see simhash); its first segment is equal and is the blocking key. A kind has one row for
each salt and start, however large the table. The kinds of a key are compared in one task, which goes through them by the
segment after: two that are near differ there in few bits, so only values that close meet. Keys of more than ``LISTED *
bucket`` rows get longer by that segment, with a row for each value that a seeker may meet. Keys that are as crowded all the
same are dealt out in parts: all seekers meet the first ``bucket`` targets, and only those that find no candidate among these
meet the others. In a crowd of near copies that is linear in its size. No task holds more than twice ``LISTED * bucket`` rows.

A pair that meets under several salts and starts counts at the first of them, so every pair is made once.

Every kind has a sketch, a bitmap of its shingles: a bit tells whether an odd number of them falls on it, and it has as many
bits as the text has shingles, or up to twice as many. Two texts differ in at least as many shingles as their sketches in
bits (the longer one folded to the size of the other), so near kinds whose sketches or sizes differ too much can't be similar,
and are no candidates; nothing is lost by that. Sketches grow with the text, so that they tell long texts apart as well.

*Verification.* A list gives each kind its closest candidate, and if that one is not clearly close by its sketch, up to 16,
with a mark whether there may be others. First each kind is compared with the closest of its candidates, then the few that
are not similar to it with all of them. Who has a mark and is not similar to any goes on: round after round such kinds look
their candidates up anew and are compared with the closest 16, 256, 4096 ..., until one is similar or none is left. Texts
meet by joins of single rows; no group is gathered.

Nulls: a null text is an empty one; rows with a null id stay. Texts with fewer than five words are one shingle of all of
them; texts without words are alike. Of rows that repeat id and text, the first by the JSON of their other columns stays.
Extra columns pass through, whatever their names. An empty table gives an empty result. Texts of any length are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop, fresh, give_back, offsets, values
from .simhash import SEED, ring, word_blocks
from .suffix_dedup import free
from .tokens import mix, shingles

SALTS = 2
#: Least bits of a text's sketch; word hashes that a task keeps.
BITS, WORDS = 64, 300_000
#: What a list holds of each kind; buckets to a list, whose kinds are compared by a further segment.
OWN, LISTED = ["id", "k", "fps", "size", "bits"], 16


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """A hash of each word of a text, A-Z lower-cased. known: keeps the hashes of words that were seen."""
    import xxhash

    parts = [np.zeros(0, np.uint64)]
    for block in word_blocks((text or "").encode().lower(), 0):
        for w in set(block):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w, SEED)
        parts.append(np.fromiter(map(known.__getitem__, block), np.uint64, len(block)))
    return np.concatenate(parts)


def prints(hashes: np.ndarray, salts: int) -> np.ndarray:
    """SimHashes of the distinct words of a text."""
    plain, out = np.unique(hashes), np.zeros(salts, np.uint64)
    for salt in range(salts if len(plain) else 0):
        own = mix(plain + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if salt else plain
        ones = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[salt] = np.packbits(2 * ones > len(plain), bitorder="little").view("<u8")[0]
    return out


def sketch(hashes: np.ndarray, words: int) -> tuple[int, np.ndarray]:
    """Number of distinct shingles of a text, and a bitmap that tells on which bits an odd number of them falls."""
    own = np.unique(shingles(hashes, min(words, len(hashes)))) if len(hashes) else np.zeros(1, np.uint64)
    width = max(BITS, 1 << (len(own) - 1).bit_length())
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return len(own), np.packbits(odd.astype(bool))


def text_prints(docs: DataFrame, salts: int, words: int) -> DataFrame:
    """(doc_id, k, c, fps, size, bits) of every row of docs(doc_id, text): two hashes of the text, its fingerprints and its sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            fps, sizes, bitmaps = [], [], []
            for t in batch.column("text"):
                hashes = word_hashes(t.as_py(), known)
                fps.append(prints(hashes, salts).tobytes())
                size, bits = sketch(hashes, words)
                sizes.append(size)
                bitmaps.append(bits.tobytes())
                if len(known) > WORDS:
                    known.clear()
            columns = [*(batch.column(x) for x in ("doc_id", "k", "c")), pa.array(fps, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bitmaps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k", "c", "fps", "size", "bits"])
        give_back()

    rows = docs.select("doc_id", text_key().alias("k"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("c"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k long, c long, fps binary, size long, bits binary")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit("")))


#: What a row of a list is for.
TARGET, SEEKER = 1, 2


def plain(column: pa.Array) -> np.ndarray:
    """The numbers of a binary column, a row for each value; all have as many."""
    at = offsets(column)
    return values(column)[at[0] : at[-1]].copy().view(np.uint64).reshape(len(column), -1)


def spread_rows(batches: Iterator[pa.RecordBatch], salts: int, segments: int, own: list[str]) -> Iterator[pa.RecordBatch]:
    masks = ring(segments)
    for batch in batches:
        if not batch.num_rows:
            continue
        fps = plain(batch.column("fps"))
        for start in range(salts * segments):
            key = mix(mix(fps[:, start // segments] & np.uint64(masks[start % segments])) + np.uint64(start))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.full(len(fps), start, np.int32)), *(batch.column(x) for x in own)], names=["key", "start", *own])


def spread(kinds: DataFrame, salts: int, segments: int, kind: str, own: list[str] = OWN) -> DataFrame:
    """(key, start, *own) of kinds(fps, *own): a row for each salt and segment of the ring, numbered by start."""
    types = dict(id=kind, k="long", fps="binary", size="long", bits="binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return spread_rows(batches, salts, segments, own)

    return kinds.select(*dict.fromkeys(["fps", *own])).mapInArrow(run, ", ".join(["key long", "start int", *(f"{x} {types[x]}" for x in own)]))


def longer_rows(batches: Iterator[pa.RecordBatch], distance: int, segments: int) -> Iterator[pa.RecordBatch]:
    masks, most = ring(segments), 2 * distance // segments
    for batch in batches:
        if not batch.num_rows:
            continue
        key, fps, start = batch.column("key").to_numpy().view(np.uint64), plain(batch.column("fps")), batch.column("start").to_numpy()
        role = batch.column("role").to_numpy()
        for n in np.unique(start).tolist():
            mask = masks[(n + 1) % segments]
            bits = [b for b in range(64) if mask >> b & 1]
            for some in (x for size in range(min(most, len(bits)) + 1) for x in combinations(bits, size)):
                rows = np.flatnonzero((start == n) & (role & (SEEKER if some else SEEKER | TARGET) > 0))
                near = fps[rows, n // segments] & np.uint64(mask) ^ np.uint64(sum(1 << b for b in some))
                here = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(mix(mix(key[rows] + np.uint64(1)) + mix(near)).view(np.int64)), *(here.column(x) for x in ("start", *OWN)), pa.array(role[rows] & (SEEKER if some else SEEKER | TARGET))], names=["key", "start", *OWN, "role"])


def longer_columns(kind: str) -> str:
    return f"key long, start int, id {kind}, k long, fps binary, size long, bits binary, role int"


def longer(keyed: DataFrame, distance: int, segments: int, kind: str) -> DataFrame:
    """Rows of keyed(key, start, *OWN, role) under keys with the next segment: targets under their own, seekers under each that may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return longer_rows(batches, distance, segments)

    return keyed.select("key", "start", *OWN, "role").mapInArrow(run, longer_columns(kind))


def spread_longer(kinds: DataFrame, role: int, salts: int, distance: int, segments: int, kind: str) -> DataFrame:
    """longer() of the rows that spread() makes, in one Python worker: each of two in a row would keep its memory when idle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = spread_rows(batches, salts, segments, OWN)
        yield from longer_rows((x.append_column("role", pa.array(np.full(x.num_rows, role, np.int32))) for x in keyed), distance, segments)
        give_back()

    return kinds.select(*OWN).mapInArrow(run, longer_columns(kind))


class Crowd:
    """The kinds of a list, by (id, k)."""

    def __init__(self, rows: pa.RecordBatch, segments: int, distance: int, similarity: float):
        self.ids, self.ks, self.masks, self.distance, self.similarity = rows.column("id"), rows.column("k"), [np.uint64(x) for x in ring(segments)], distance, similarity
        self.k, self.sizes, self.prints = self.ks.to_numpy(), rows.column("size").to_numpy(), plain(rows.column("fps"))
        self.salt, self.start = divmod(rows.column("start")[0].as_py(), segments)
        self.fps = self.prints[:, self.salt].copy()
        self.at, self.bytes = offsets(rows.column("bits")), values(rows.column("bits"))
        self.width = np.diff(self.at)
        role = rows.column("role").to_numpy()
        self.seekers, self.targets = np.flatnonzero(role & SEEKER), np.flatnonzero(role & TARGET)

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(seekers, targets) that may be near: in long lists, by the bits of the segment after the key's."""
        if len(self.seekers) * len(self.targets) <= PAIRS:
            yield self.seekers, self.targets
            return
        points, at = np.unique(self.fps & self.masks[(self.start + 1) % len(self.masks)], return_inverse=True)
        for n in np.unique(at[self.seekers]).tolist():
            close = np.bitwise_count(points ^ points[n]) <= 2 * self.distance // len(self.masks)
            yield self.seekers[at[self.seekers] == n], self.targets[close[at[self.targets]]]

    def chains(self, differ: np.ndarray, start: int) -> np.ndarray:
        """Which of the differences keep the budget of every chain from a start on."""
        m, ok, chain = len(self.masks), np.arange(len(differ)), np.uint64(0)
        for n in range(1, m + 1):
            chain |= self.masks[(start + n - 1) % m]
            keep = np.bitwise_count(differ & chain) <= n * self.distance // m
            ok, differ = ok[keep], differ[keep]
        return ok

    def near(self, some: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """(seeker, target before it, how far apart) of the candidates among these, each pair at its first salt and start."""
        j = j[j < some.max()] if len(some) else j
        x, y = np.nonzero(np.bitwise_count(self.fps[some][:, None] ^ self.fps[j]) <= self.distance)
        i, j = some[x], j[y]
        ok = self.chains(self.fps[i] ^ self.fps[j], self.start)
        i, j = i[ok], j[ok]
        small, large = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        ok = (i > j) & (self.k[i] != self.k[j]) & (small >= self.similarity * large - 1e-6)
        for salt in range(self.salt):
            ok &= np.bitwise_count(self.prints[i, salt] ^ self.prints[j, salt]) > self.distance
        i, j = i[ok], j[ok]
        for start in range(self.start):
            ok = np.ones(len(i), bool)
            ok[self.chains(self.fps[i] ^ self.fps[j], start)] = False
            i, j = i[ok], j[ok]
        apart, sizes = self.apart(i, j), self.sizes[i] + self.sizes[j]
        # similar: |A xor B| <= (1 - s) / (1 + s) * (|A| + |B|)
        ok = apart * (1 + self.similarity) <= (1 - self.similarity) * sizes + 1e-6
        return i[ok], j[ok], apart[ok] / sizes[ok]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Bits in which sketches differ, the longer one folded to the size of the other."""
        out, width = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(width).tolist():
            pairs = np.flatnonzero(width == w)
            for some in np.array_split(pairs, len(pairs) * w // (STEP * 64) + 1):
                rows, at = np.unique(np.concatenate([i[some], j[some]]), return_inverse=True)
                folded = np.zeros((len(rows), w), np.uint8)
                for own in np.unique(self.width[rows]).tolist():
                    those = np.flatnonzero(self.width[rows] == own)
                    whole = self.bytes[self.at[rows[those]][:, None] + np.arange(own)]
                    folded[those] = np.bitwise_xor.reduce(whole.reshape(len(those), own // w, w), axis=1)
                folded = folded.view(np.uint64)
                out[some] = np.bitwise_count(folded[at[: len(some)]] ^ folded[at[len(some) :]]).sum(1, dtype=np.int64)
        return out

    def candidates(self, most: int, bucket: int, first: bool) -> Iterator[tuple[np.ndarray, ...]]:
        """(seeker, target, how far apart, whether there may be others): of each seeker its closest `most` candidates here.
        first: seekers go through the targets by `bucket`, until one is clearly close, which is enough, or `most` are found."""
        sure = (1 - self.similarity) / (1 + self.similarity) / 2
        for seekers, targets in self.meetings():
            parts = np.array_split(targets, -(-len(targets) // bucket)) if first and len(targets) else [targets]
            for n, j in enumerate(parts):
                found = [np.zeros(0, np.int64)]
                for some in np.array_split(seekers, max(1, len(seekers) * len(j) >> 20)):
                    x, y, gap = self.near(some, j)
                    order = np.lexsort((y, gap, x))
                    x, y, gap = x[order], y[order], gap[order]
                    begin = np.flatnonzero(np.diff(x, prepend=-1))
                    size = np.diff(np.append(begin, len(x)))
                    wanted = np.where(gap[begin] <= sure, 1, most) if first else np.full(len(begin), most)
                    keep = np.arange(len(x)) - np.repeat(begin, size) < np.repeat(wanted, size)
                    enough = size >= wanted
                    others = np.repeat((size > wanted) | enough & (n + 1 < len(parts)), size)
                    if len(x):
                        yield x[keep], y[keep], gap[keep], others[keep]
                    found.append(x[begin[enough]])
                seekers = np.setdiff1d(seekers, np.concatenate(found), assume_unique=True)


#: Sketches that are compared at once; pairs of fingerprints that a list compares without the next segment.
STEP, PAIRS = 1 << 17, 1 << 23


def compared(rows: DataFrame, distance: int, segments: int, similarity: float, kind: str, bucket: int, most: int, first: bool = True) -> DataFrame:
    """(id, k, j_id, j_k, gap, others): of each seeker of the lists (rows of equal key and part), up to `most` candidates of its
    list, and whether it may have others there."""

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(x.num_rows for x in held) > 1:
            crowd = Crowd(pa.Table.from_batches(held).combine_chunks().to_batches()[0], segments, distance, similarity)
            if some := list(crowd.candidates(most, bucket, first)):
                i, j, gap, others = (pa.array(np.concatenate(x)) for x in zip(*some, strict=True))
                yield pa.RecordBatch.from_arrays([*(x.take(at) for at in (i, j) for x in (crowd.ids, crowd.ks)), gap, others], names=["id", "k", "j_id", "j_k", "gap", "others"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            key, part = batch.column("key").to_numpy(), batch.column("part").to_numpy()
            edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if b > a:
                    if (now := (key[a], part[a])) != last:
                        yield from answer(held)
                        held, last = [], now
                    held.append(batch.slice(a, b - a))
        yield from answer(held)
        give_back()

    rows = rows.select("key", "part", "start", *OWN, "role").repartition("key", "part").sortWithinPartitions("key", "part", "id", "k")
    return rows.mapInArrow(run, f"id {kind}, k long, j_id {kind}, j_k long, gap double, others boolean")


class Candidates:
    """Which kinds(id, k, fps, size, bits) are near each other, key by key. No part of a key holds more than twice
    `LISTED * bucket` rows."""

    def __init__(self, kinds: DataFrame, n: int, salts: int, distance: int, segments: int, similarity: float, bucket: int, kind: str):
        self.kinds, self.n, self.salts, self.distance, self.segments, self.bucket, self.kind = kinds, n, salts, distance, segments, bucket, kind
        self.how, self.most_rows = (distance, segments, similarity, kind, bucket), bucket * LISTED
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.tables.append(cut(df, name))
        return self.tables[-1]

    def keyed(self, kinds: DataFrame, role: int) -> DataFrame:
        return spread(kinds, self.salts, self.segments, self.kind).withColumn("role", F.lit(role))

    def crowded(self, keys: DataFrame) -> DataFrame | None:
        """The keys that more rows share than a list takes, if any."""
        if self.n <= self.most_rows:
            return None
        out = self.keep(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > self.most_rows).select("key"), "near-crowded")
        return None if out.isEmpty() else out

    def dealt(self, seekers: DataFrame, targets: DataFrame) -> DataFrame:
        """Rows of lists in which all seekers and targets of a key meet, in as many parts as it takes."""
        parts = [F.col(x) for x in ("seeker_parts", "target_parts")]
        counts = [F.ceil(F.count(F.when(F.col("role") == bit, 1)) / self.most_rows).cast("int").alias(x) for bit, x in ((SEEKER, "seeker_parts"), (TARGET, "target_parts"))]
        seekers, targets = seekers.withColumn("role", F.lit(SEEKER)), targets.withColumn("role", F.lit(TARGET))
        if self.n <= self.most_rows:
            return seekers.union(targets.select(*seekers.columns)).withColumn("part", F.lit(0))
        sizes = seekers.select("key", "role").union(targets.select("key", "role")).groupBy("key").agg(*counts)
        sizes = self.keep(sizes.where((parts[0] > 1) | (parts[1] > 1)), "near-parts")
        seekers, targets = (x.join(sizes, "key", "left").withColumns({c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("seeker_parts", "target_parts")}) for x in (seekers, targets))
        own = [F.pmod(F.xxhash64("k"), x).cast("int") for x in parts]
        every = [F.explode(F.sequence(F.lit(0), x - 1)) for x in parts]
        seekers = seekers.withColumn("other", every[1]).withColumn("part", own[0] * parts[1] + F.col("other"))
        targets = targets.withColumn("other", every[0]).withColumn("part", F.col("other") * parts[1] + own[1])
        return seekers.union(targets.select(*seekers.columns))

    def first(self) -> DataFrame:
        """(id, k, j_id, j_k, gap, others): of each kind that has candidates, some of them; all, if none of its rows has others."""
        keyed, alone = self.keyed(self.kinds, TARGET | SEEKER), F.lit(0).alias("part")
        crowded = self.crowded(spread(self.kinds, self.salts, self.segments, self.kind, []))
        if crowded is None:
            return compared(keyed.select("*", alone), *self.how, ROUND)
        found = compared(keyed.join(crowded, "key", "left_anti").select("*", alone), *self.how, ROUND)
        busy = self.keep(longer(keyed.join(crowded, "key", "left_semi"), self.distance, self.segments, self.kind), "near-busy")
        crowded = self.crowded(busy)
        if crowded is None:
            return found.union(compared(busy.select("*", alone), *self.how, ROUND))
        found = found.union(compared(busy.join(crowded, "key", "left_anti").select("*", alone), *self.how, ROUND))
        busy = busy.join(crowded, "key", "left_semi")
        seekers, targets = (busy.where(F.col("role").bitwiseAND(bit) > 0) for bit in (SEEKER, TARGET))
        # the first of a key are met by all others of it; in a dense crowd that leaves few
        heads = targets.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id", "k"))).where(F.col("n") <= self.bucket).drop("n")
        found = self.keep(found.union(compared(self.dealt(seekers, heads), *self.how, ROUND)), "near-found")
        rest = seekers.join(found.select("id", "k").distinct(), ["id", "k"], "left_anti").select(*seekers.columns)
        return found.withColumn("others", F.lit(True)).union(compared(self.dealt(rest, targets), *self.how, ROUND))

    def more(self, left: DataFrame, most: int) -> DataFrame:
        """(id, k, j_id, j_k, gap): of each kind of left(id, k), its closest `most` candidates and some others."""
        how = (self.salts, self.distance, self.segments, self.kind)
        seekers = self.keep(spread_longer(self.kinds.join(left, ["id", "k"], "left_semi"), SEEKER, *how), "near-seekers")
        asked = self.keep(seekers.select("key").distinct(), "near-asked")
        targets = spread_longer(self.kinds, TARGET, *how).join(asked, "key", "left_semi")
        return compared(self.dealt(seekers, targets), *self.how, most, False).drop("others")

    def drop(self) -> None:
        for x in self.tables:
            drop(x)
        self.tables = []


def shingle_set(text: str, n: int) -> set[bytes]:
    """The n-word shingles of a text, A-Z lower-cased; fewer words are one shingle."""
    w = text.encode().lower().split()
    return {b" ".join(s) for s in zip(*(w[i:] for i in range(n)), strict=False)} or {b" ".join(w)}


def jaccard(a: str, b: str, n: int) -> float:
    x, y = shingle_set(a, n), shingle_set(b, n)
    return len(x & y) / len(x | y)


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, words: int, kind: str) -> DataFrame:
    """(id, k) of the pairs(id, k, j_id, j_k) whose texts are similar."""
    wanted = pairs.select("id", "k").union(pairs.select("j_id", "j_k")).distinct()
    texts = docs.select(F.col("doc_id").alias("id"), text_key().alias("k"), F.coalesce("text", F.lit("")).alias("text")).join(wanted, ["id", "k"])
    texts = cut(texts, "near-texts")  # both sides of each join are then shuffled by themselves, so that a text with very many copies can be split
    both = pairs.join(texts, ["id", "k"]).join(texts.select(F.col("id").alias("j_id"), F.col("k").alias("j_k"), F.col("text").alias("other")), ["j_id", "j_k"]).select("id", "k", "j_k", "text", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, set()
        for batch in batches:
            keep = []
            for j, text, other in zip(*(batch.column(c) for c in ("j_k", "text", "other")), strict=True):
                if j != held:  # rows of one text follow each other
                    held, own = j, shingle_set(other.as_py(), words)
                x = shingle_set(text.as_py(), words)
                same = len(x & own)
                keep.append(same >= similarity * (len(x) + len(own) - same) - 1e-9)
            yield batch.select(["id", "k"]).filter(pa.array(keep, pa.bool_()))
        give_back()

    out = cut(both.mapInArrow(run, f"id {kind}, k long").distinct(), "near-similar")
    drop(texts)
    return out


def similar_kinds(docs: DataFrame, kinds: DataFrame, similarity: float, words: int, distance: int, segments: int, salts: int, bucket: int) -> list[DataFrame]:
    """Tables of (id, k) of the kinds(id, k, fps, size, bits) that are similar to a candidate before them."""
    kind, spark = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession
    candidates = Candidates(kinds, kinds.count(), salts, distance, segments, similarity, bucket, kind)
    met = cut(candidates.first(), "near-met")
    candidates.drop()
    free(spark)
    first = met.groupBy("id", "k").agg(F.min(F.struct("gap", "j_id", "j_k")).alias("j"), F.max("others").alias("others"))
    pairs = cut(first.select("id", "k", "j.j_id", "j.j_k", "others"), "near-pairs")
    gone = [verified(docs, pairs.drop("others"), similarity, words, kind)]
    unlike = cut(pairs.join(gone[0], ["id", "k"], "left_anti"), "near-unlike")
    if not unlike.isEmpty():
        own = ["id", "k", "j_id", "j_k"]
        rest = cut(met.select(own).join(unlike.select("id", "k"), ["id", "k"], "left_semi").join(unlike.select(own), own, "left_anti"), "near-rest")
        gone.append(verified(docs, rest, similarity, words, kind))
        drop(rest)
    left = cut(reduce(lambda x, y: x.join(y, ["id", "k"], "left_anti"), gone[1:], unlike.where("others").select("id", "k")), "near-left")
    before, most = 0, ROUND
    while not left.isEmpty():
        ranked = candidates.more(left, most).withColumn("n", F.row_number().over(Window.partitionBy("id", "k").orderBy("gap", "j_id", "j_k")))
        found = cut(ranked.where(F.col("n") <= most), "near-pairs")
        del ranked
        candidates.drop()
        new = verified(docs, found.where(F.col("n") > before).drop("n", "gap"), similarity, words, kind)
        gone.append(new)
        after = cut(found.where(F.col("n") == most).select("id", "k").join(new, ["id", "k"], "left_anti"), "near-left")
        drop(left)
        drop(found)
        left, before, most = after, most, most * ROUND
    for x in (met, pairs, unlike, left):
        drop(x)
    free(spark)
    return gone


#: How many candidates a list gives a kind, how many the kinds that are left meet in a round, and how many times more in the next.
ROUND = 16


def surplus(docs: DataFrame, *, similarity: float = 0.8, words: int = 5, distance: int = 7, segments: int = 8, salts: int = SALTS, bucket: int = 4096) -> DataFrame:
    """(doc_id, k) of documents that an earlier one stands for; k is the text's hash."""
    whole = docs.where("doc_id IS NOT NULL")
    known = cut(text_prints(whole, salts, words), "near-prints")
    same = [F.min(x).alias(x) for x in ("fps", "size", "bits")]
    kinds = cut(known.groupBy("k", "c").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last_id"), *same), "near-kinds")
    copies = known.join(kinds.where("id < last_id").select("k", "c", "id"), ["k", "c"]).where("doc_id <> id").select("doc_id", "k").distinct()
    copies = cut(copies, "near-copies")
    drop(known)
    gone = similar_kinds(whole, kinds.select(*OWN), similarity, words, distance, segments, salts, bucket)
    out = cut(reduce(DataFrame.union, [copies, *gone]), "near-surplus")
    for x in (kinds, copies, *gone):
        drop(x)
    return out


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs without surplus documents; of rows that repeat id and text one stays."""
    i, k = fresh(docs.columns, "i_"), fresh(docs.columns, "k_")
    match = (F.col("`doc_id`") == F.col(i)) & (F.xxhash64(F.coalesce(F.col("`text`"), F.lit(""))) == F.col(k))
    left = docs.join(surplus(docs, **how).select(F.col("doc_id").alias(i), F.col("k").alias(k)), match, "left_anti")
    twice = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(i), text_key().alias(k)).groupBy(i, k).agg(F.count("*").alias("n")).where("n > 1").select(i, k)
    twice = cut(twice, "near-repeats")
    if twice.isEmpty():
        return left
    row, others = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    once = left.join(twice, match).select(i, k, row.alias("row"), F.to_json(others).alias("by")).groupBy(i, k).agg(F.min_by("row", F.coalesce("by", F.lit(""))).alias("row"))
    return left.join(twice, match, "left_anti").union(once.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
