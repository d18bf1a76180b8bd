"""The ordered fold: a log becomes seven tables, each by one grouped aggregation.

All writes of the log are "the first wins", "the last wins" or "an update of what exists". The last update after an object's
creation is the last update at all, if that one is later than the creation; so no window is needed, rows are aggregated
before the shuffle, and an object with very many events costs no task more than its share.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..schema import BELIEVED, RETIRED
from ..tables import cut

_CLAIM_EVENTS = ["claim_created", "status_changed", "confidence_recalibrated", "claim_invalidated", "claim_superseded", "claim_retracted", "rebuttal_triggered"]
_EXPIRING = ["claim_invalidated", "claim_superseded", "claim_retracted"]


def first_by(kind: Column, *columns: Column) -> Column:
    """The columns of the earliest row of a kind, as a struct with its seq."""
    return F.min_by(F.when(kind, F.struct(*columns, F.col("seq").alias("seq"))), F.when(kind, F.col("seq")))


def last_by(kind: Column, *columns: Column) -> Column:
    """The columns of the latest row of a kind, as a struct with its seq."""
    return F.max_by(F.when(kind, F.struct(*columns, F.col("seq").alias("seq"))), F.when(kind, F.col("seq")))


class State:
    """The tables of a log, each computed when it is used. as_of: only events recorded until then count."""

    def __init__(self, log: DataFrame, as_of: Column | None = None):
        self.log = log if as_of is None else log.where(F.col("t_created") <= as_of)

    def shared(self) -> State:
        """A state of the same log whose tables are folded once and written to the shared folder, for many rules over them.

        Of the evidence, which the rules don't read whole, the pairs that it cites are written.
        """
        other = State(self.log)
        for name in ("claims", "sources", "cited", "edges", "threads"):
            setattr(other, name, cut(getattr(self, name), f"state-{name}"))
        return other

    def only(self, *events: str) -> DataFrame:
        return self.log.where(F.col("event").isin(*events))

    @cached_property
    def runs(self) -> DataFrame:
        """Agent runs; the last start wins."""
        rows = self.only("agent_run_started").groupBy("run_id").agg(F.max_by(F.struct("role", "model", "task", F.col("t_created").alias("started_at")), "seq").alias("r"))
        return rows.select("run_id", "r.*")

    @cached_property
    def sources(self) -> DataFrame:
        """Sources; the first registration wins, the last credit event after it decides."""
        registered, credit = F.col("event") == "source_registered", F.col("event").isin("source_discredited", "source_recredited")
        rows = self.only("source_registered", "source_discredited", "source_recredited").groupBy("source_id").agg(
            first_by(registered, *map(F.col, ("uri", "title", "origin", "authority", "credibility", "retrieved_at"))).alias("r"),
            last_by(credit, *map(F.col, ("event", "reason", "t_created"))).alias("c"),
        )
        bad = F.coalesce((F.col("c.event") == "source_discredited") & (F.col("c.seq") > F.col("r.seq")), F.lit(False))
        return rows.where("r IS NOT NULL").select(
            "source_id", "r.uri", "r.title", "r.origin", "r.authority", "r.credibility", "r.retrieved_at",
            bad.alias("discredited"), F.when(bad, F.col("c.reason")).alias("discredit_reason"), F.when(bad, F.col("c.t_created")).alias("discredited_at"),
        )

    @cached_property
    def claims(self) -> DataFrame:
        """Claims with their current status, flags and times."""
        event = F.col("event")
        rows = self.only(*_CLAIM_EVENTS).withColumn("claim_id", F.coalesce("claim_id", "old_claim_id"))
        created = event == "claim_created"
        hard = event.isin("status_changed", *_EXPIRING)
        status = F.when(event == "claim_superseded", "superseded").when(event == "claim_retracted", "retracted").when(event == "status_changed", F.col("to")).otherwise(F.coalesce("new_status", F.lit("retracted")))
        payload = [
            F.col("topic"), F.col("assertion.s").alias("subj"), F.col("assertion.p").alias("pred"), F.col("assertion.o").alias("obj"), F.col("assertion.nl").alias("nl"),
            *map(F.col, ("warrant", "backing", "rebuttal_conditions", "epistemic_status", "likelihood_band", "analytic_confidence", "confidence_score", "confidence_method", "method", "t_valid", "t_invalid", "t_created", "depends_on", "grounds", "agent_run")),
        ]
        g = rows.groupBy("claim_id").agg(
            first_by(created, *payload).alias("c"),
            last_by(hard, status.alias("status")).alias("h"),
            F.max(F.when(event == "rebuttal_triggered", F.col("seq"))).alias("reb"),
            last_by(event.isin("status_changed", "rebuttal_triggered"), event.alias("event"), F.col("to").alias("to"), F.coalesce("reason", "condition").alias("why")).alias("f"),
            last_by(event.isin(*_EXPIRING), F.col("t_created").alias("at")).alias("x"),
            last_by(event == "claim_superseded", F.col("new_claim_id").alias("by")).alias("s"),
            last_by(event == "claim_retracted", F.col("retracted_by").alias("by")).alias("r"),
            last_by(event == "confidence_recalibrated", F.col("new_score").alias("score"), F.col("method").alias("method")).alias("n"),
        )
        after = lambda c: F.coalesce(F.col(f"{c}.seq") > F.col("c.seq"), F.lit(False))
        base = F.when(after("h"), F.col("h.status")).otherwise(F.col("c.epistemic_status"))
        last_hard = F.when(after("h"), F.col("h.seq")).otherwise(F.col("c.seq"))
        reviewed = (F.col("reb") > last_hard) & ~F.coalesce(base.isin(*RETIRED), F.lit(False))
        rebutted = F.col("f.event") == "rebuttal_triggered"
        flag = after("f") & F.coalesce(rebutted | (F.col("f.to") == "needs_review"), F.lit(False))
        why = F.when(rebutted, F.concat(F.lit("rebuttal condition met: "), F.coalesce("f.why", F.lit("None")))).otherwise(F.col("f.why"))
        return g.where("c IS NOT NULL").select(
            "claim_id", "c.topic", "c.subj", "c.pred", "c.obj", "c.nl", "c.warrant", "c.backing", F.col("c.rebuttal_conditions").alias("rebuttal"),
            F.when(F.coalesce(reviewed, F.lit(False)), "needs_review").otherwise(base).alias("epistemic_status"), "c.likelihood_band", "c.analytic_confidence",
            F.when(after("n"), F.col("n.score")).otherwise(F.col("c.confidence_score")).alias("confidence_score"),
            F.when(after("n"), F.col("n.method")).otherwise(F.col("c.confidence_method")).alias("confidence_method"), "c.method", "c.t_valid", "c.t_invalid", "c.t_created",
            F.when(after("x"), F.col("x.at")).alias("t_expired"), F.when(after("s"), F.col("s.by")).alias("superseded_by"), F.when(after("r"), F.col("r.by")).alias("retracted_by"),
            flag.alias("needs_review"), F.when(flag, why).alias("review_reason"), "c.depends_on", "c.grounds", F.col("c.agent_run").alias("created_by_run"), F.col("c.seq").alias("created_seq"),
        )

    @cached_property
    def believed(self) -> DataFrame:
        return self.claims.where(F.col("epistemic_status").isin(*BELIEVED))

    @cached_property
    def evidence(self) -> DataFrame:
        """Evidence; the first row of an id wins."""
        return self._first_evidence("claim_id", "source_id", "quote", "locator").select("evidence_id", "r.*")

    @cached_property
    def cited(self) -> DataFrame:
        """(claim_id, source_id): the distinct pairs of the evidence table, without its other columns."""
        return self._first_evidence("claim_id", "source_id").select("r.*").distinct()

    def _first_evidence(self, *columns: str) -> DataFrame:
        """(evidence_id, r): the columns of the first row of an id. The hash is a key only because numbers sort faster than texts."""
        return self.only("evidence_added").groupBy(F.xxhash64("evidence_id"), "evidence_id").agg(F.min_by(F.struct(*columns), "seq").alias("r"))

    @cached_property
    def edges(self) -> DataFrame:
        """Typed edges; the first of a (kind, from, to) wins. Ids are text made of shortened ids and may repeat, so they are no key."""
        log = self.log
        dep = log.where(F.col("event") == "claim_created").select("seq", "t_created", F.col("claim_id").alias("from_id"), F.explode("depends_on").alias("to_id"))
        dep = dep.select("seq", F.lit("depends_on").alias("kind"), "from_id", "to_id", F.lit(None).cast("string").alias("meta"), "t_created", fn.dependency_edge_id(F.col("from_id"), F.col("to_id")).alias("edge_id"))
        sup = log.where(F.col("event") == "claim_superseded").select("seq", F.lit("supersedes").alias("kind"), F.col("new_claim_id").alias("from_id"), F.col("old_claim_id").alias("to_id"), F.lit(None).cast("string").alias("meta"), "t_created", fn.supersession_edge_id(F.col("new_claim_id"), F.col("old_claim_id")).alias("edge_id"))
        con = log.where(F.col("event") == "conflict_linked").select("seq", F.lit("conflicts_with").alias("kind"), F.col("claim_a").alias("from_id"), F.col("claim_b").alias("to_id"), F.to_json(F.struct(F.col("conflict_type").alias("type"))).alias("meta"), "t_created", "edge_id")
        rows = dep.unionByName(sup).unionByName(con).groupBy("kind", "from_id", "to_id").agg(F.min_by(F.struct("edge_id", "meta", F.col("t_created").alias("created_at")), "seq").alias("r"))
        return rows.select("r.edge_id", "kind", "from_id", "to_id", "r.meta", "r.created_at")

    @cached_property
    def threads(self) -> DataFrame:
        """Conflict threads; open until the last update after they were linked."""
        linked, updated = F.col("event") == "conflict_linked", F.col("event") == "resolution_updated"
        rows = self.only("conflict_linked", "resolution_updated").groupBy("thread_id").agg(
            first_by(linked, *map(F.col, ("claim_a", "claim_b", "conflict_type", "note", "t_created"))).alias("r"), last_by(updated, F.col("status"), F.col("note")).alias("u")
        )
        late = F.coalesce(F.col("u.seq") > F.col("r.seq"), F.lit(False))
        return rows.where("r IS NOT NULL").select(
            "thread_id", "r.claim_a", "r.claim_b", "r.conflict_type", F.when(late, F.col("u.status")).otherwise(F.lit("open")).alias("status"),
            F.when(late, F.col("u.note")).otherwise(F.col("r.note")).alias("note"), F.col("r.t_created").alias("created_at"),
        )

    @cached_property
    def revisions(self) -> DataFrame:
        """Audit rows in the order of seq, written even where an update found no claim. detail is JSON of the event's own fields."""
        event = F.col("event")
        detail = (
            F.when(event == "status_changed", F.to_json(F.struct("from", "to", "reason")))
            .when(event == "confidence_recalibrated", F.to_json(F.struct("old_score", "new_score", "method")))
            .when(event == "claim_invalidated", F.to_json(F.struct("cause", "new_status", "invalidated_by")))
            .when(event == "claim_superseded", F.to_json(F.struct("old_claim_id", "new_claim_id")))
            .when(event == "claim_retracted", F.to_json(F.struct("reason", "retracted_by")))
            .otherwise(F.to_json(F.struct("condition", "evidence")))
        )
        return self.only(*_CLAIM_EVENTS[1:]).select("seq", F.coalesce("claim_id", "old_claim_id").alias("claim_id"), "event", detail.alias("detail"), "t_created", "agent_run")
