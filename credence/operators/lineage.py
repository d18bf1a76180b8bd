"""Closure over dependency edges: what rests on a source or a claim."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import State
from ..schema import TRANSITIONS
from ..tables import cut, drop


#: Tables of visited claims that a level may have to read before they are made into one.
_TABLES = 8


def reach(edges: DataFrame, seeds: DataFrame, max_levels: int = 10_000) -> DataFrame:
    """(claim_id, via, level) of everything that depends on seeds(claim_id), directly or not, without the seeds.

    edges(from_id depends on to_id). One join for each level; via is the smallest claim of the level before that leads
    here. Cycles end because visited claims are left out; only whether a level is empty reaches the driver. A chain of
    more than max_levels levels is an error.
    """
    e = cut(edges.where("kind = 'depends_on'").select("from_id", "to_id").distinct(), "closure-edges")
    front = cut(seeds.select("claim_id", F.lit(None).cast("string").alias("via"), F.lit(0).alias("level")).distinct(), "closure")
    tables = [front]
    for level in range(1, max_levels + 2):
        seen = reduce(DataFrame.union, tables).select("claim_id")
        step = e.join(front.select("claim_id"), e["to_id"] == F.col("claim_id")).groupBy("from_id").agg(F.min("to_id").alias("via"))
        step = cut(step.join(seen, step["from_id"] == seen["claim_id"], "left_anti").select(F.col("from_id").alias("claim_id"), "via", F.lit(level).alias("level")), "closure")
        if step.isEmpty():
            drop(step)
            break
        if level > max_levels:
            raise RuntimeError(f"dependents go on beyond {max_levels} levels")
        if len(tables) == _TABLES:
            whole = cut(reduce(DataFrame.union, tables), "closure")
            for x in tables:
                drop(x)
            tables = [whole]
        tables.append(step)
        front = step
    drop(e)
    return reduce(DataFrame.union, tables).where("level > 0")


def citing(state: State, source: str) -> DataFrame:
    """Claims with evidence from a source, given by id or URI."""
    return state.evidence.where(F.col("source_id") == fn.source_ref(F.lit(source))).select("claim_id").distinct()


def downstream(state: State, source: str) -> tuple[DataFrame, DataFrame]:
    """(direct, transitive): claims that cite the source, and those that rest on them."""
    direct = citing(state, source)
    return direct, reach(state.edges, direct)


def transitions(spark) -> DataFrame:
    """(from, to): the legal changes of status."""
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "`from` string, `to` string")


def flaggable(state: State, claims: DataFrame) -> DataFrame:
    """Of claims(claim_id, ...): those that may change to needs_review, with their status as `from`."""
    able = [s for s, to in TRANSITIONS.items() if "needs_review" in to]
    return claims.join(state.claims.select("claim_id", F.col("epistemic_status").alias("from")), "claim_id").where(F.col("from").isin(*able))


def cascade(state: State, seeds: DataFrame, reason: str) -> DataFrame:
    """(claim_id, from, reason, level) of dependents to flag; the walk goes on through those that can't be flagged."""
    found = flaggable(state, reach(state.edges, seeds))
    return found.select("claim_id", "from", F.concat(F.lit(f"{reason} (upstream "), F.substring("via", 1, 12), F.lit(")")).alias("reason"), "level")
