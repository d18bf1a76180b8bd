"""Event schema and controlled vocabularies."""

from __future__ import annotations

# The vocabularies of the event format.
STATUSES = ["hypothesized", "probable", "corroborated", "confirmed", "disputed", "needs_review", "superseded", "retracted"]
BELIEVED = ["probable", "corroborated", "confirmed"]
LIVE = ["hypothesized", "probable", "corroborated", "confirmed", "disputed", "needs_review"]
RETIRED = ["retracted", "superseded"]
BANDS = ["almost_no_chance", "very_unlikely", "unlikely", "roughly_even", "likely", "very_likely", "almost_certain"]
ANALYTIC = ["high", "mod", "low"]
METHODS = ["self_report", "self_consistency", "multi_agent_agreement", "source_corroboration", "human"]
CONFLICT_TYPES = ["no_conflict", "complementary", "conflicting_opinions", "outdated", "misinformation", "factual"]
FUNCTIONAL = ["was_born_in", "died_in", "date_of_birth", "date_of_death", "capital_of", "headquartered_in", "ceo_is", "founded_in", "population_of", "height_of", "is_a"]
EVENTS = [
    "seed_marker", "agent_run_started", "source_registered", "source_discredited", "source_recredited", "claim_created", "evidence_added", "status_changed",
    "confidence_recalibrated", "conflict_linked", "resolution_updated", "claim_invalidated", "claim_superseded", "claim_retracted", "rebuttal_triggered",
]
# From -> legal next statuses.
TRANSITIONS = {
    "hypothesized": ["probable", "corroborated", "confirmed", "disputed", "needs_review", "retracted"],
    "probable": ["corroborated", "confirmed", "disputed", "needs_review", "retracted", "superseded"],
    "corroborated": ["confirmed", "disputed", "needs_review", "retracted", "superseded", "probable"],
    "confirmed": ["disputed", "needs_review", "retracted", "superseded"],
    "disputed": ["corroborated", "confirmed", "needs_review", "retracted", "superseded", "probable"],
    "needs_review": ["probable", "corroborated", "confirmed", "disputed", "retracted", "superseded"],
    "superseded": [],
    "retracted": ["hypothesized"],
}
# Near-miss spellings of enum values, by field.
ALIASES = {
    "analytic_confidence": {"moderate": "mod", "medium": "mod", "m": "mod", "hi": "high", "lo": "low"},
    "likelihood_band": {"even": "roughly_even", "50/50": "roughly_even", "certain": "almost_certain", "impossible": "almost_no_chance"},
}
# Thresholds.
AUTHORITY, PROMOTE, CONFIRM = 0.5, 0.7, 0.9
SUBJECT_SIMILARITY, PREDICATE_SIMILARITY, OBJECT_SIMILARITY = 0.6, 0.5, 0.8
HIGH_CONFIDENCE = 0.8
VERSION = 1

#: What the JSON lines hold: the union of all payloads, declared so that nothing is inferred.
LINE = (
    "v INT, event STRING, topic STRING, t_created STRING, agent_run STRING, event_id STRING, note STRING, run_id STRING, role STRING, model STRING, task STRING, "
    "source_id STRING, uri STRING, title STRING, origin STRING, authority DOUBLE, credibility STRING, retrieved_at STRING, reason STRING, claim_id STRING, "
    "assertion STRUCT<s: STRING, p: STRING, o: STRING, nl: STRING>, warrant STRING, backing ARRAY<STRING>, rebuttal_conditions ARRAY<STRING>, grounds ARRAY<STRING>, "
    "epistemic_status STRING, likelihood_band STRING, analytic_confidence STRING, confidence_score DOUBLE, confidence_method STRING, method STRING, t_valid STRING, t_invalid STRING, "
    "depends_on ARRAY<STRING>, evidence_id STRING, quote STRING, locator STRING, `from` STRING, `to` STRING, old_score DOUBLE, new_score DOUBLE, edge_id STRING, thread_id STRING, "
    "claim_a STRING, claim_b STRING, conflict_type STRING, status STRING, cause STRING, new_status STRING, invalidated_by STRING, old_claim_id STRING, new_claim_id STRING, "
    "retracted_by STRING, condition STRING, evidence STRING"
)
#: A log: the same with its place in the order of replay, and times as timestamps.
LOG = "seq BIGINT, " + LINE.replace("t_created STRING", "t_created TIMESTAMP").replace("t_valid STRING", "t_valid TIMESTAMP").replace("t_invalid STRING", "t_invalid TIMESTAMP")
#: A candidate batch document.
BATCH = (
    "agent_run STRUCT<run_id: STRING, role: STRING, model: STRING, task: STRING>, "
    "sources ARRAY<STRUCT<alias: STRING, uri: STRING, title: STRING, origin: STRING, authority: STRING, credibility: STRING, retrieved_at: STRING>>, "
    "claims ARRAY<STRUCT<alias: STRING, assertion: STRUCT<s: STRING, p: STRING, o: STRING, nl: STRING>, warrant: STRING, rebuttal_conditions: ARRAY<STRING>, grounds: ARRAY<STRING>, "
    "backing: ARRAY<STRING>, epistemic_status: STRING, likelihood_band: STRING, analytic_confidence: STRING, confidence_score: STRING, confidence_method: STRING, method: STRING, "
    "t_valid: STRING, t_invalid: STRING, depends_on: ARRAY<STRING>, evidence: ARRAY<STRUCT<source: STRING, quote: STRING, locator: STRING>>>>"
)
