"""Integrity rules, the review queue and promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import State
from ..schema import AUTHORITY, BANDS, BELIEVED, CONFIRM, HIGH_CONFIDENCE, PROMOTE, RETIRED
from .conflicts import detect, linked_conflicts


def authoritative(state: State) -> DataFrame:
    """(claim_id, n_sources, n_authoritative): distinct registered sources of each cited claim, and those that are credited and of enough authority."""
    able = (F.coalesce("authority", F.lit(0.0)) >= AUTHORITY) & ~F.col("discredited")
    cited = state.cited.join(state.sources.select("source_id", able.alias("able")), "source_id")
    return cited.groupBy("claim_id").agg(F.count("*").alias("n_sources"), F.sum(F.col("able").cast("long")).alias("n_authoritative"))


def promotion(state: State) -> DataFrame:
    """Eligibility of every claim."""
    n, score = F.coalesce("n_authoritative", F.lit(0).cast("long")), F.coalesce("confidence_score", F.lit(0.0))
    return state.claims.join(authoritative(state), "claim_id", "left").select(
        "claim_id", F.col("epistemic_status").alias("status"), n.alias("distinct_authoritative_sources"), score.alias("confidence_score"),
        F.coalesce(F.size("rebuttal"), F.lit(0)).alias("stated_rebuttal_conditions"), ((n >= 2) & (score >= PROMOTE)).alias("eligible_corroborated"), ((n >= 2) & (score >= CONFIRM)).alias("eligible_confirmed"), "confidence_method",
    )


def finding(df: DataFrame, rule: str, severity: str, message: Column, a: str = "claim_id", b: str | None = None) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(a).alias("claim_a"), (F.col(b) if b else F.lit(None).cast("string")).alias("claim_b"), message.alias("message"))


def _short(c: str) -> Column:
    return F.substring(c, 1, 12)


def unlinked(state: State) -> DataFrame:
    """Contradictions without an edge are errors where the predicate allows one object, and hints elsewhere."""
    pairs = detect(state).where("NOT already_linked")
    said = F.concat(F.col("subject"), F.lit(" / "), F.col("predicate"), F.lit(": "), F.col("object_a"), F.lit(" against "), F.col("object_b"))
    hard = finding(pairs.where("functional"), "silent-resolution", "error", said, "claim_a", "claim_b")
    return hard.union(finding(pairs.where("NOT functional"), "multivalued-collision", "warning", said, "claim_a", "claim_b"))


def non_falsifiable(state: State) -> DataFrame:
    rows = state.claims.where((F.coalesce(F.size("rebuttal"), F.lit(0)) <= 0) & ~F.coalesce(F.col("epistemic_status").isin(*RETIRED), F.lit(False)))
    return finding(rows, "non-falsifiable", "error", F.concat_ws(" ", "subj", "pred", "obj"))


def overconfidence(state: State) -> DataFrame:
    rows = state.claims.where("confidence_score IS NOT NULL AND confidence_method = 'self_report'")
    return finding(rows, "overconfidence", "warning", F.concat(F.lit("only self-reported: "), F.col("confidence_score").cast("string")))


def band_rank(c: Column) -> Column:
    """1 for the least likely band; null if it is none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, BANDS)), c), F.lit(0).cast("long"))


def uncertainty(state: State) -> DataFrame:
    """Claims without grounds of their own that are more likely than their weakest premise."""
    own = state.claims.where((F.size("depends_on") > 0) & (F.coalesce(F.size("grounds"), F.lit(0)) <= 0)).select("claim_id", band_rank(F.col("likelihood_band")).alias("rank"), F.explode("depends_on").alias("parent"))
    parents = state.claims.select(F.col("claim_id").alias("parent"), band_rank(F.col("likelihood_band")).alias("parent_rank"))
    weakest = own.join(parents, "parent").groupBy("claim_id").agg(F.first("rank").alias("rank"), F.min("parent_rank").alias("weakest")).where("rank > weakest")
    return finding(weakest, "uncertainty-propagation", "warning", F.lit("more likely than its weakest premise"))


def orphan_source(state: State) -> DataFrame:
    bad = state.cited.join(state.sources.where("discredited").select("source_id"), "source_id", "left_semi").select("claim_id")
    return finding(state.believed.join(bad, "claim_id", "left_semi"), "orphaned-cascade", "error", F.lit("believed, but cites a discredited source"))


def orphan_parent(state: State) -> DataFrame:
    retired = state.claims.where(F.col("epistemic_status").isin(*RETIRED)).select(F.col("claim_id").alias("parent"))
    own = state.believed.select("claim_id", F.explode("depends_on").alias("parent"))
    return finding(own.join(retired, "parent", "left_semi").select("claim_id").distinct(), "orphaned-cascade", "error", F.lit("believed, but depends on a retired claim"))


RULES = [unlinked, non_falsifiable, overconfidence, uncertainty, orphan_source, orphan_parent]


def lint(state: State) -> DataFrame:
    """(rule, severity, claim_a, claim_b, message) of all rules."""
    out = RULES[0](state)
    for rule in RULES[1:]:
        out = out.union(rule(state))
    return out


def item(df: DataFrame, trigger: str, detail: Column, a: Column, b: Column | None = None, thread: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select(F.lit(trigger).alias("trigger"), a.alias("claim_a"), (none if b is None else b).alias("claim_b"), (none if thread is None else thread).alias("thread_id"), detail.alias("detail"))


def needs_review(state: State) -> DataFrame:
    return item(state.claims.where("needs_review"), "needs_review", F.col("review_reason"), F.col("claim_id"))


def low_corroboration(state: State) -> DataFrame:
    """Believed with high confidence on fewer than two authoritative sources."""
    n = F.coalesce("n_authoritative", F.lit(0).cast("long"))
    rows = state.believed.where(F.col("confidence_score") >= HIGH_CONFIDENCE).join(authoritative(state), "claim_id", "left").where(n < 2)
    return item(rows, "high_confidence_low_corroboration", F.concat(F.lit("authoritative sources: "), n.cast("string")), F.col("claim_id"))


def misinformation(state: State) -> DataFrame:
    return item(state.threads.where("conflict_type = 'misinformation' AND status = 'open'"), "suspected_misinformation", F.col("note"), F.lit(None).cast("string"), thread=F.col("thread_id"))


def authority_contradiction(state: State) -> DataFrame:
    pairs = linked_conflicts(state).where("functional")
    said = F.concat(F.col("subject"), F.lit(" "), F.col("predicate"), F.lit(": "), F.col("object_a"), F.lit(" against "), F.col("object_b"))
    return item(pairs, "authority_contradiction", said, F.col("claim_a"), F.col("claim_b"))


def review_queue(state: State) -> DataFrame:
    """(trigger, claim_a, claim_b, thread_id, detail) of everything that waits for a curator."""
    return needs_review(state).union(low_corroboration(state)).union(misinformation(state)).union(authority_contradiction(state))


def believed_share(state: State) -> DataFrame:
    """(status, n) of the statuses that count as belief."""
    return state.claims.where(F.col("epistemic_status").isin(*BELIEVED)).groupBy(F.col("epistemic_status").alias("status")).agg(F.count("*").alias("n"))
