"""Removal of long repeated byte strings by bucket-pointer refinement of sampled suffixes.

A suffix array groups the suffixes that begin alike; here only those groups are wanted whose members agree on ``length``
bytes. Suffixes are put into initial buckets by q-grams, and a bucket is then refined by the bucket identifiers of later
(and earlier) offsets, over and over, until its members agree on all bytes or are alone.

*Sampling.* Of the grams in a string of ``length`` bytes, the one of the smallest hash (the leftmost of equal ones) is its
anchor. Equal strings have equal anchors at equal distances, so each string is found from its anchor, of which there are
about 2 in ``length - q``. An anchor at p stands for the strings that start at p - r for an interval of distances r.

*Refinement.* A node is an anchor with an interval of distances. What all strings of a node share, its core, is its
bucket identifier; the union of its strings is its hull. A node alone in its bucket holds no repeated string and is
dropped; nodes of equal hulls hold repeated strings only and are decided; of them one goes on as a partner if others of
the bucket are undecided. The rest is split, each part getting a longer core: the identifiers of the parts refine those
of the whole. Three levels lead from whole intervals to single strings, whatever the number of copies.

Buckets are never gathered: a level counts rows by identifier, aggregated before the shuffle. Only undecided anchors, which
lie at the ends of repeats, carry their few hundred bytes around; texts are joined twice by their own key, once to read
those bytes and once to remove the spans. Identifiers are 128-bit hashes of the bytes.

Strings are judged on the input: every byte in a string that starts anywhere else too is removed, copies inside one
document included; matches never cross documents. Nulls: a null text is an empty one, a null id is kept. Repeated rows are
copies of each other. doc_id must be a number of at most 64 bits; ``length`` lies from 32 to 32,767. Texts shorter than
``length`` are kept whole. An empty table gives an empty result. Texts of any
length are handled in blocks. Extra columns are dropped by ``removed`` and kept by ``clean``.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import CHUNK_BYTES, chunks, cut, drop, give_back, offsets, values

Q = 32
FAN = 8
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q = 32 bytes at each place."""
    n = len(data) - Q + 1
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)).copy()
    words *= _K[0]
    words ^= words >> np.uint64(29)
    out = words[:n] * _K[0]
    for i in (1, 2, 3):
        out += words[8 * i : 8 * i + n] * _K[i]
    out ^= out >> np.uint64(32)
    out *= _K[1]
    return out ^ (out >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(x)] = x
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, least distance, greatest distance, gram hash) of each anchor in texts that begin at starts (one more: the end)."""
    width, found = length - Q + 1, []
    for at in range(int(starts[0]), int(starts[-1]) - length + 1, CHUNK_BYTES):
        block = data[at : min(at + CHUNK_BYTES + length - 1, int(starts[-1]))]
        hashed = grams(block)
        best = sliding_least((hashed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=np.uint64), width) & np.uint64(0xFFFFFFFF)
        best = best.astype(np.int64)
        s = np.arange(len(best)) + at
        end = starts[np.searchsorted(starts, s, "right")] if len(starts) > 2 else np.full(len(s), starts[-1])
        ok = s + length <= end
        new = ok.copy()
        new[1:] &= (best[1:] != best[:-1]) | ~ok[:-1]
        last = ok.copy()
        last[:-1] &= (best[1:] != best[:-1]) | ~ok[1:]
        p = best[new]
        found.append((p + at, p - np.flatnonzero(last), p - np.flatnonzero(new), hashed[p].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    p, low, high, g = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(p) > 1 and (same := p[1:] == p[:-1]).any():  # an anchor whose strings two blocks have met
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        p, g, low, high = p[first], g[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
    return p, low, high, g


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, k and data: the text's bytes; (doc_id, k) tells texts apart even where ids are null or repeat."""
    text = F.coalesce(F.col("`text`"), F.lit(""))
    return docs.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.cast("binary").alias("data"))


def initial(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, k, p, lo, hi, g, u) of every anchor: place, distances, bucket (gram) and hull identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashed = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part in chunks(batch, "data"):
                column = part.column("data")
                starts, data = offsets(column), values(column)
                p, low, high, g = anchors(data, starts, length)
                if not len(p):
                    continue
                view = memoryview(data)
                u = np.fromiter((hashed(view[a - h : a - lo + length], lo << 16 | h) for a, lo, h in zip(p.tolist(), low.tolist(), high.tolist(), strict=True)), np.uint64, len(p))
                doc = np.searchsorted(starts, p, "right") - 1
                ids, k = part.column("doc_id").take(pa.array(doc)), part.column("k").take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([ids, k, pa.array(p - starts[doc]), pa.array(low.astype(np.int16)), pa.array(high.astype(np.int16)), pa.array(g), pa.array(u.view(np.int64))], names=["doc_id", "k", "p", "lo", "hi", "g", "u"])
        give_back()

    return texts.mapInArrow(run, "doc_id long, k long, p long, lo smallint, hi smallint, g long, u long")


def contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The hull's bytes of each wanted(doc_id, k, p, lo, hi, need)."""
    by_doc = wanted.groupBy("doc_id", "k").agg(F.collect_list(F.struct("p", "lo", "hi", "need")).alias("at")).withColumnsRenamed({"doc_id": "d", "k": "kk"})
    work = texts.join(by_doc, texts["doc_id"].eqNullSafe(by_doc["d"]) & (texts["k"] == by_doc["kk"])).select("doc_id", "k", "data", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "data"):
                rows = [(d, k, x["p"], x["lo"], x["hi"], x["need"], data[x["p"] - x["hi"] : x["p"] - x["lo"] + length]) for d, k, data, at in zip(*(c.to_pylist() for c in part.columns), strict=True) for x in at]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "k", "p", "lo", "hi", "need", "hull"])

    # rows that repeat id and text are copies of each other: their anchors have equal hulls, so one of them is enough
    return work.mapInArrow(run, "doc_id long, k long, p long, lo smallint, hi smallint, need boolean, hull binary").dropDuplicates(["doc_id", "k", "p", "lo", "hi"])


def nodes(work: DataFrame, length: int, width: int) -> DataFrame:
    """Split every range of distances of work(..., hull, ranges) into parts of `width`: a row for each with its core and hull identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        core, hull = xxhash.xxh3_128_intdigest, xxhash.xxh3_64_intdigest
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.bool_(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16())
        names = ["doc_id", "k", "p", "lo", "hi", "need", "a", "b", "i1", "i2", "u", "r0", "r1"]
        for batch in batches:
            rows = []
            for doc, k, p, low, high, data, ranges in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "p", "lo", "hi", "hull", "ranges")), strict=True):
                for r in ranges:
                    for r0 in range(r["r0"], r["r1"] + 1, width):
                        r1 = min(r0 + width - 1, r["r1"])
                        a, b = max(low, r0), min(high, r1)
                        if a > b:
                            continue
                        x = core(data[high - r0 : high - r1 + length], r0)
                        y = hull(data[high - b : high - a + length], a << 16 | b)
                        rows.append((doc, k, p, low, high, r["need"], a, b, (x >> 64) - (1 << 63), (x & (1 << 64) - 1) - (1 << 63), y - (1 << 63), r0, r1))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        give_back()

    return work.mapInArrow(run, "doc_id long, k long, p long, lo smallint, hi smallint, need boolean, a smallint, b smallint, i1 long, i2 long, u long, r0 smallint, r1 smallint")


def spans(texts: DataFrame, length: int) -> DataFrame:
    """(doc_id, k, spans): the byte intervals of each text that hold a repeated string, unmerged."""
    spark = texts.sparkSession
    rows = cut(initial(texts, length), "suffix-anchors")
    classes = rows.groupBy("g", "u").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k", "p", "lo", "hi")).alias("one"))
    buckets = classes.groupBy("g").agg(F.sum("n").alias("of"), F.count("*").alias("kinds"), F.max(F.col("n") == 1).alias("open")).where("of > 1")
    alive = cut(classes.join(buckets, "g"), "suffix-classes")
    decided = cut(rows.join(alive.where("n > 1").select("g", "u"), ["g", "u"]).select("doc_id", "k", *_interval("lo", "hi", length)), "suffix-decided")
    parts = [decided]
    wanted = alive.where("kinds > 1 AND open").select("one.*", (F.col("n") == 1).alias("need"))
    held = cut(contexts(texts, wanted, length), "suffix-contexts")
    drop(rows)
    drop(alive)
    free(spark)
    wide = length - Q + 1
    work = held.withColumn("ranges", F.array(F.struct(F.lit(0).alias("r0"), F.lit(wide - 1).alias("r1"), "need"))).drop("need")
    state = None
    while wide > 1:
        wide = -(-wide // FAN)
        level = cut(nodes(work, length, wide), "suffix-nodes")
        by = ["i1", "i2", "u", "a", "b"]
        classes = level.groupBy(*by).agg(F.count("*").alias("n"), F.max("need").alias("need"), F.min(F.struct("doc_id", "k", "p", "lo", "hi", "r0", "r1")).alias("one"))
        buckets = classes.groupBy("i1", "i2").agg(F.count("*").alias("kinds"), F.max((F.col("n") == 1) & F.col("need")).alias("open"))
        known = cut(classes.join(buckets, ["i1", "i2"]), "suffix-classes")
        parts.append(cut(level.where("need").join(known.where("n > 1").select(*by), by).select("doc_id", "k", *_interval("a", "b", length)), "suffix-decided"))
        if wide > 1:
            again = known.where("kinds > 1 AND open").select("one.*", ((F.col("n") == 1) & F.col("need")).alias("need"))
            ranges = again.groupBy("doc_id", "k", "p", "lo", "hi").agg(F.collect_list(F.struct("r0", "r1", "need")).alias("ranges"))
            after = cut(_same(held.drop("need"), ranges, ["k", "p", "lo", "hi"]), "suffix-work")
            work = after
            if state is not None:
                drop(state)
            state = after
        drop(level)
        drop(known)
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    out = cut(found.groupBy("doc_id", "k").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "suffix-spans")  # a set: rows that repeat a text add nothing
    for x in [*parts, held, *([state] if state is not None else [])]:
        drop(x)
    free(spark)
    return out


def _interval(lo: str, hi: str, length: int):
    return (F.col("p") - F.col(hi)).cast("long").alias("start"), (F.col("p") - F.col(lo) + length).cast("long").alias("end")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by keys and by doc_id, where a null equals a null."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in ["doc_id", *keys]})
    on = left["doc_id"].eqNullSafe(other["__doc_id"])
    for c in keys:
        on = on & (left[c] == other[f"__{c}"])
    return left.join(other, on, how).drop(*(f"__{c}" for c in ["doc_id", *keys]))


def free(spark) -> None:
    """Let Spark's cleaner delete shuffle files that no plan refers to any more, as it does every half hour by itself."""
    gc.collect()
    spark._jvm.System.gc()


def merge(found: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal intervals of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["end"]) for x in found or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def removed(docs: DataFrame, length: int = 400) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, text) of every row of docs(doc_id, text); spans: maximal removed intervals, kept: the
    other bytes, text: these without characters that an interval cuts through."""
    if not Q <= length < 1 << 15:
        raise ValueError(f"length must be from {Q} to {(1 << 15) - 1}")
    texts = keyed(docs)
    work = _same(texts, spans(texts, length), ["k"], "left").select("doc_id", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "data"):
                data = part.column("data").to_pylist()
                gone = [merge(x) for x in part.column("spans").to_pylist()]
                pieces = [[{"start": a, "end": b} for a, b in x] for x in gone]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                rest = list(map(kept, data, gone))
                columns = [part.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array(pieces, kind), pa.array(rest, pa.binary()), pa.array([x.decode(errors="ignore") for x in rest])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept", "text"])

    return work.mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary, text string")


def clean(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs with the repeated strings cut out of text, all columns kept. Characters that a removed interval cuts through go whole."""
    name = "`text`"
    body = docs.withColumns({"__doc": F.struct(*[F.col(f"`{c}`") for c in docs.columns])}).select("__doc", F.col("`doc_id`").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(name), F.lit(""))).alias("k"))
    work = _same(body, spans(keyed(docs), length), ["k"], "left").select("__doc", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("__doc")
            columns = {rows.type.field(i).name: rows.field(i) for i in range(rows.type.num_fields)}
            texts = columns["text"].to_pylist()
            for i, found in enumerate(batch.column("spans").to_pylist()):
                if found:
                    texts[i] = kept(texts[i].encode(), merge(found)).decode(errors="ignore")
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return work.mapInArrow(run, docs.schema)
