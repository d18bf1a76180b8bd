"""As-of queries on both time axes, and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import State


def as_of_system(log: DataFrame, date: Column) -> DataFrame:
    """What was believed on a date: the log until then, folded. The cutoff reaches the scan."""
    return State(log, date).believed.select("claim_id", "subj", "pred", "obj", "epistemic_status", "confidence_score").orderBy("subj", "pred", "claim_id")


def as_of_world(state: State, date: Column) -> DataFrame:
    """What is now believed to have been true on a date; intervals are half open."""
    inside = (F.col("t_valid").isNull() | (F.col("t_valid") <= date)) & (F.col("t_invalid").isNull() | (F.col("t_invalid") > date))
    return state.believed.where(inside).select("claim_id", "subj", "pred", "obj", "epistemic_status", "t_valid", "t_invalid").orderBy("subj", "pred", "claim_id")


def as_of(log: DataFrame, system: Column, world: Column) -> DataFrame:
    """Both axes at once: what was believed on one date to be true on another."""
    return as_of_world(State(log, system), world)


def by_status(state: State, status: str) -> DataFrame:
    return state.claims.where(F.col("epistemic_status") == status).select("claim_id", "subj", "pred", "obj", "epistemic_status", "confidence_score", "review_reason").orderBy("subj", "pred", "claim_id")


def get_claim(state: State, claim_id: str) -> DataFrame:
    return state.claims.where(F.col("claim_id") == claim_id)


def revision_log(state: State, claim_id: str) -> DataFrame:
    return state.revisions.where(F.col("claim_id") == claim_id).select("seq", "event", "detail", "t_created", "agent_run").orderBy("seq")


def conflict_neighbours(state: State) -> DataFrame:
    """(claim_id, other): the conflict edges, seen from both ends."""
    e = state.edges.where("kind = 'conflicts_with'")
    return e.select(F.col("from_id").alias("claim_id"), F.col("to_id").alias("other")).union(e.select("to_id", "from_id")).distinct()


def show(state: State, claim_id: str | None = None) -> DataFrame:
    """A claim, or every claim, with its evidence and their sources, its conflicts and its revisions nested."""
    claims, evidence, revisions, near = state.claims, state.evidence, state.revisions, conflict_neighbours(state)
    if claim_id is not None:
        claims, evidence, revisions, near = (x.where(F.col("claim_id") == claim_id) for x in (claims, evidence, revisions, near))
    cited = evidence.join(state.sources.select("source_id", "uri", "title", "authority", "discredited"), "source_id", "left")
    nested = lambda df, name, *c: df.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct(*c))).alias(name))
    out = claims.join(nested(cited, "evidence", "evidence_id", "source_id", "quote", "locator", "uri", "title", "authority", "discredited"), "claim_id", "left")
    out = out.join(near.groupBy("claim_id").agg(F.sort_array(F.collect_set("other")).alias("conflicts_with")), "claim_id", "left")
    return out.join(nested(revisions, "revisions", "seq", "event", "detail", "t_created", "agent_run"), "claim_id", "left")
