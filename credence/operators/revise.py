"""Commands: each returns the rows to append to the log, made from one fold of the state before it.

The caller appends them with sources.append; nothing here writes. Commands that name a claim or source take its id.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import State
from ..schema import CONFLICT_TYPES, METHODS, STATUSES, TRANSITIONS
from ..sources import event_rows, stamp
from . import guard, lineage


class Command:
    """Commands against one topic's log. run: the agent run that events are attributed to."""

    def __init__(self, log: DataFrame, topic: str, run: str | None = None):
        self.spark, self.state, self.topic, self.run = log.sparkSession, State(log), topic, run
        self.next_seq = (log.agg(F.max("seq")).first()[0] or 0) + 1

    def rows(self, *events: tuple[str, dict]) -> DataFrame:
        return event_rows(self.spark, list(events), self.topic, self.next_seq, self.run)

    def claim(self, claim_id: str) -> dict:
        found = self.state.claims.where(F.col("claim_id") == claim_id).take(1)
        if not found:
            raise ValueError(f"no claim {claim_id}")
        return found[0].asDict()

    def legal(self, claim: dict, to: str) -> bool:
        return to in TRANSITIONS.get(claim["epistemic_status"], [])

    def flags(self, found: DataFrame, after: int) -> DataFrame:
        """status_changed rows for (claim_id, from, reason, level), numbered behind `after` events by level and id."""
        template = self.rows(("seed_marker", {}))
        # sorted by ranges, so these numbers ascend over the partitions; gaps don't matter to seq
        ordered = found.orderBy("level", "claim_id").withColumn("n", F.monotonically_increasing_id())
        rows = ordered.select((F.col("n") + F.lit(self.next_seq + after)).alias("seq"), "claim_id", "from", F.lit("needs_review").alias("to"), "reason")
        rows = rows.withColumns({"event": F.lit("status_changed"), "agent_run": F.lit(self.run).cast("string")})
        return template.limit(0).unionByName(stamp(rows, self.topic), allowMissingColumns=True)

    def add_source(self, uri: str, **more) -> DataFrame:
        """retrieved_at is now unless it is given."""
        more = more | {"retrieved_at": more.get("retrieved_at") or datetime.now(UTC).isoformat(timespec="microseconds")}
        sid = self.spark.range(1).select(fn.source_id(F.lit(uri))).first()[0]
        return self.rows(("source_registered", {"source_id": sid, "uri": uri, **more}))

    def change_status(self, claim_id: str, to: str, reason: str | None = None) -> DataFrame:
        """An unknown or illegal status is an error; no change is no event."""
        claim = self.claim(claim_id)
        if to not in STATUSES:
            raise ValueError(f"unknown status {to}")
        if claim["epistemic_status"] == to:
            return self.rows()
        if not self.legal(claim, to):
            raise ValueError(f"{claim['epistemic_status']} can't become {to}")
        return self.rows(("status_changed", {"claim_id": claim_id, "from": claim["epistemic_status"], "to": to, "reason": reason}))

    def recalibrate(self, claim_id: str, score: float, method: str) -> DataFrame:
        if method not in METHODS or not 0 <= score <= 1:
            raise ValueError("a known method and a score in 0..1 are needed")
        return self.rows(("confidence_recalibrated", {"claim_id": claim_id, "old_score": self.claim(claim_id)["confidence_score"], "new_score": score, "method": method}))

    def promote(self, claim_id: str, to: str | None = None, reason: str | None = None) -> DataFrame:
        """To the status given, or to the highest one that its authoritative sources and its score carry."""
        self.claim(claim_id)
        able = guard.promotion(self.state).where(F.col("claim_id") == claim_id).first()
        best = "confirmed" if able["eligible_confirmed"] else "corroborated" if able["eligible_corroborated"] else None
        if to is None and best is None:
            raise ValueError(f"{claim_id} is not eligible for promotion")
        return self.change_status(claim_id, to or best, reason or "promotion")

    def trigger_rebuttal(self, claim_id: str, condition: str, evidence: str | None = None) -> DataFrame:
        self.claim(claim_id)
        return self.rows(("rebuttal_triggered", {"claim_id": claim_id, "condition": condition, "evidence": evidence}))

    def link(self, one: str, other: str, conflict_type: str = "factual", note: str | None = None) -> DataFrame:
        """A conflict edge and an open thread; both ends become disputed where that is legal."""
        if conflict_type not in CONFLICT_TYPES:
            raise ValueError(f"unknown conflict type {conflict_type}")
        a, b = sorted((one, other))
        name = f"{a[4:12]}_{b[4:12]}"
        events = [("conflict_linked", {"edge_id": f"edg_cfl_{name}", "thread_id": f"thr_{name}", "claim_a": a, "claim_b": b, "conflict_type": conflict_type, "note": note})]
        for row in self.state.claims.where(F.col("claim_id").isin(a, b)).select("claim_id", "epistemic_status").orderBy("claim_id").collect():
            if self.legal(row.asDict(), "disputed"):
                events.append(("status_changed", {"claim_id": row["claim_id"], "from": row["epistemic_status"], "to": "disputed", "reason": f"conflict thr_{name}"}))
        return self.rows(*events)

    def resolve_thread(self, thread_id: str, status: str, note: str | None = None) -> DataFrame:
        return self.rows(("resolution_updated", {"thread_id": thread_id, "status": status, "note": note}))

    def discredit(self, source: str, reason: str) -> DataFrame:
        """The source's mark, then flags for claims that cite it, then for what rests on any of those, flagged or not."""
        sid = self.spark.range(1).select(fn.source_ref(F.lit(source))).first()[0]
        direct = lineage.citing(self.state, sid)
        own = lineage.flaggable(self.state, direct).select("claim_id", "from", F.lit(f"cites discredited source {sid[:12]}").alias("reason"), F.lit(0).alias("level"))
        rest = lineage.cascade(self.state, direct, f"depends on claim citing discredited source {sid[:12]}")
        return self.rows(("source_discredited", {"source_id": sid, "reason": reason})).unionByName(self.flags(own.union(rest), 1))

    def recredit(self, source: str) -> DataFrame:
        sid = self.spark.range(1).select(fn.source_ref(F.lit(source))).first()[0]
        return self.rows(("source_recredited", {"source_id": sid}))

    def retire(self, claim_id: str, event: tuple[str, dict], what: str) -> DataFrame:
        self.claim(claim_id)
        seeds = self.spark.createDataFrame([(claim_id,)], "claim_id string")
        return self.rows(event).unionByName(self.flags(lineage.cascade(self.state, seeds, f"depends on {what} claim {claim_id[:12]}"), 1))

    def invalidate(self, claim_id: str, cause: str, new_status: str = "retracted") -> DataFrame:
        if new_status not in STATUSES:
            raise ValueError(f"unknown status {new_status}")
        return self.retire(claim_id, ("claim_invalidated", {"claim_id": claim_id, "cause": cause, "new_status": new_status, "invalidated_by": self.run}), "invalidated")

    def retract(self, claim_id: str, reason: str, retracted_by: str | None = None) -> DataFrame:
        return self.retire(claim_id, ("claim_retracted", {"claim_id": claim_id, "reason": reason, "retracted_by": retracted_by}), "retracted")

    def supersede(self, old: str, new: str) -> DataFrame:
        """Evidence stays with the old claim."""
        self.claim(new)
        return self.retire(old, ("claim_superseded", {"old_claim_id": old, "new_claim_id": new}), "superseded")

