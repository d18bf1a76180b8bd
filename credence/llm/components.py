"""Connected components of a distributed edge list, by alternating large and small stars.

Each round points the larger neighbours of every node at its smallest one, then the smaller ones likewise; the edge list
shrinks to one star for each component in a number of rounds that grows with the logarithm of the longest path. Minima
are aggregated before the shuffle, so a node with very many links costs no task more than its share. Every round is
written to the shared folder, and only counts and a checksum reach the driver.

Edges with a null end, loops and repeated edges add nothing; an empty list gives an empty result; other columns are ignored.
Ends are long, so ties between components do not arise: the smallest number names one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop


def forest(pairs: Iterator[tuple[int, int]]) -> dict[int, int]:
    """Union-find: every node of the pairs that isn't the smallest of its set -> that smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    return {x: root(x) for x in up if root(x) != x}


def contract(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of each partition, replaced by its own stars: at most one row for each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stars = forest((a, b) for batch in batches for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True))
        if stars:
            yield pa.RecordBatch.from_arrays([pa.array(stars.keys(), pa.int64()), pa.array(stars.values(), pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): every node of the edges (a, b: long) that isn't its component's smallest, and that smallest."""
    now = cut(contract(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        drop(now)
        now = after
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        new = (row["n"], row["s"])
        if new == state or row["n"] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = new
    raise RuntimeError(f"components have not settled in {max_rounds} rounds")
