"""Counts and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import State
from ..schema import STATUSES
from .guard import lint, review_queue


def status_counts(state: State) -> DataFrame:
    """(status, rank, n) in the order of the ladder; statuses without a claim are left out."""
    rank = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("epistemic_status"))
    return state.claims.groupBy("epistemic_status").agg(F.count("*").alias("n")).select(F.col("epistemic_status").alias("status"), rank.alias("rank"), "n").orderBy("rank")


def totals(state: State) -> DataFrame:
    """One row: claims, sources, discredited sources, threads and open threads."""
    parts = [
        state.claims.select(F.lit("claims").alias("k"), F.lit(1).cast("long").alias("n")),
        state.sources.select(F.lit("sources"), F.lit(1).cast("long")), state.sources.where("discredited").select(F.lit("discredited"), F.lit(1).cast("long")),
        state.threads.select(F.lit("threads"), F.lit(1).cast("long")), state.threads.where("status = 'open'").select(F.lit("open_threads"), F.lit(1).cast("long")),
    ]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    names = ["claims", "sources", "discredited", "threads", "open_threads"]
    return rows.groupBy().agg(*[F.coalesce(F.sum(F.when(F.col("k") == k, F.col("n"))), F.lit(0).cast("long")).alias(k) for k in names])


def believed(state: State) -> DataFrame:
    """Current beliefs, the surest first, with the text of a report line."""
    line = F.concat(F.lit("["), F.rpad("epistemic_status", 11, " "), F.lit(" "), fn.score_text(F.col("confidence_score")), F.lit("] "), F.concat_ws(" - ", "subj", "pred", "obj"))
    return state.believed.select("claim_id", "epistemic_status", "confidence_score", line.alias("line")).orderBy(F.desc_nulls_last("confidence_score"), "claim_id")


def health(state: State) -> DataFrame:
    """(kind, n): findings by severity, and the length of the review queue."""
    found = lint(state).groupBy(F.col("severity").alias("kind")).agg(F.count("*").alias("n"))
    return found.union(review_queue(state).groupBy(F.lit("review").alias("kind")).agg(F.count("*").alias("n")))
