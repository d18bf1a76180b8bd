"""DuckDB SQL for the registered queries, written against the tables and not against the log."""

from __future__ import annotations

from .queries import CUTOFF, SOURCE, WORLD
from .schema import ALIASES, BANDS, CONFLICT_TYPES, METHODS, STATUSES, TRANSITIONS


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_ID = "'clm_' || substr(sha256('parts|' || lower(p_name) || '|{p}|' || lower({o})), 1, 16)"
_IS_A, _BRAND = _ID.format(p="is_a", o="p_type"), _ID.format(p="has_brand", o="p_brand")
_SOURCE = "'src_' || substr(sha256('supplier://' || {k}), 1, 16)"

PARTS = f"""
WITH made AS (
  SELECT 2 * p_partkey AS seq, {_IS_A} AS claim_id, p_name AS subj, 'is_a' AS pred, p_type AS obj, p_size, CAST(NULL AS VARCHAR) AS parent FROM part
  UNION ALL SELECT 2 * p_partkey + 1, {_BRAND}, p_name, 'has_brand', p_brand, p_size, {_IS_A} FROM part),
claims AS (
  SELECT seq, claim_id, subj, pred, obj, parent, p_size, ({_list(STATUSES)})[p_size % 8 + 1] AS status, ({_list(BANDS)})[p_size % 7 + 1] AS band, p_size % 7 AS rank, p_size / 50 AS score, ({_list(METHODS)})[p_size % 5 + 1] AS method
  FROM made QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY seq) = 1),
sources AS (
  SELECT {_SOURCE.format(k='s_suppkey')} AS source_id, 'supplier://' || s_suppkey AS uri, s_name AS title, (s_acctbal + 1000) / 11000 AS authority, s_suppkey % 7 = 0 AND s_suppkey % 14 <> 0 AS discredited FROM supplier),
evidence AS (
  SELECT DISTINCT 'evd_' || substr(sha256(claim_id || '|' || source_id || '|' || locator), 1, 16) AS evidence_id, claim_id, source_id, locator FROM (
    SELECT {_IS_A} AS claim_id, {_SOURCE.format(k='l_suppkey')} AS source_id, l_orderkey || '.' || l_linenumber AS locator FROM lineitem JOIN part ON l_partkey = p_partkey)),
ends AS (SELECT subj, arg_min(claim_id, seq) AS x, arg_max(claim_id, seq) AS y FROM claims WHERE pred = 'is_a' GROUP BY subj HAVING arg_min(claim_id, seq) <> arg_max(claim_id, seq)),
links AS (SELECT subj, least(x, y) AS claim_a, greatest(x, y) AS claim_b, substr(least(x, y), 5, 8) || '_' || substr(greatest(x, y), 5, 8) AS name, ({_list(CONFLICT_TYPES)})[length(subj) % 6 + 1] AS kind FROM ends),
threads AS (SELECT 'thr_' || name AS thread_id, claim_a, claim_b, kind AS conflict_type, CASE WHEN subj LIKE 'r%' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN subj LIKE 'r%' THEN 'closed ' || subj ELSE subj END AS note FROM links),
auth AS (SELECT claim_id, count(*) AS n_sources, CAST(sum(CASE WHEN coalesce(authority, 0) >= 0.5 AND NOT discredited THEN 1 ELSE 0 END) AS BIGINT) AS n_authoritative
  FROM (SELECT DISTINCT claim_id, source_id FROM evidence) JOIN sources USING (source_id) GROUP BY claim_id),
live AS (SELECT * FROM claims WHERE status NOT IN ('superseded', 'retracted')),
pairs AS (
  SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, a.subj AS subject, a.pred AS predicate, a.obj AS object_a, b.obj AS object_b, a.pred = 'is_a' AS functional,
    EXISTS (SELECT 1 FROM links l WHERE l.claim_a = least(a.claim_id, b.claim_id) AND l.claim_b = greatest(a.claim_id, b.claim_id)) AS already_linked
  FROM live a JOIN live b ON a.subj = b.subj AND a.pred = b.pred AND a.seq < b.seq AND a.obj <> b.obj)
"""

_EVENTS = """
WITH RECURSIVE ev AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn, event_id, ts, props, value / 500 AS score,
    CASE WHEN event_type = 'signup' THEN 'create' WHEN event_type = 'click' THEN 'rebut' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'score' WHEN event_type IN ('view', 'purchase') THEN 'set'
      WHEN event_id % 3 = 0 THEN 'retract' WHEN event_id % 3 = 1 THEN 'invalidate' ELSE 'supersede' END AS kind,
    CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'probable' END WHEN event_type = 'purchase' THEN 'corroborated' END AS next, event_type
  FROM events {where}),
st AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, false AS made, CAST(NULL AS VARCHAR) AS status, false AS flag, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS TIMESTAMP) AS gone, CAST(NULL AS VARCHAR) AS sup, CAST(NULL AS VARCHAR) AS ret, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS how
  FROM (SELECT DISTINCT user_id FROM ev)
  UNION ALL
  SELECT e.user_id, e.rn, made OR kind = 'create',
    CASE WHEN NOT made THEN CASE WHEN kind = 'create' THEN 'hypothesized' END WHEN kind = 'set' THEN next WHEN kind = 'retract' THEN 'retracted' WHEN kind = 'invalidate' THEN 'disputed' WHEN kind = 'supersede' THEN 'superseded'
      WHEN kind = 'rebut' AND status NOT IN ('retracted', 'superseded') THEN 'needs_review' ELSE status END,
    CASE WHEN NOT made THEN false WHEN kind = 'set' THEN next = 'needs_review' WHEN kind = 'rebut' THEN true ELSE flag END,
    CASE WHEN NOT made THEN NULL WHEN kind = 'set' THEN CASE WHEN next = 'needs_review' THEN event_type END WHEN kind = 'rebut' THEN 'rebuttal condition met: ' || props ELSE why END,
    CASE WHEN made AND kind IN ('retract', 'invalidate', 'supersede') THEN ts ELSE gone END,
    CASE WHEN made AND kind = 'supersede' THEN 'clm_' || (e.user_id + 1) ELSE sup END, CASE WHEN made AND kind = 'retract' THEN 'auditor' ELSE ret END,
    CASE WHEN NOT made THEN CASE WHEN kind = 'create' THEN e.score END WHEN kind = 'score' THEN e.score ELSE st.score END, CASE WHEN NOT made THEN CASE WHEN kind = 'create' THEN 'self_report' END WHEN kind = 'score' THEN 'human' ELSE how END
  FROM st JOIN ev e ON e.user_id = st.user_id AND e.rn = st.rn + 1),
final AS (SELECT * FROM st WHERE made QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rn DESC) = 1)
"""
EVENTS, EVENTS_CUT = _EVENTS.format(where=""), _EVENTS.format(where=f"WHERE ts <= TIMESTAMP '{CUTOFF}'")

_REGISTRY = "'src_' || substr(sha256(lower('registry://' || {n})), 1, 16)"
HIERARCHY = f"""
WITH RECURSIVE claims AS (
  SELECT 'clm_region_' || r_regionkey AS claim_id, r_regionkey AS k, CAST(NULL AS VARCHAR) AS parent FROM region UNION ALL SELECT 'clm_nation_' || n_nationkey, n_nationkey, 'clm_region_' || n_regionkey FROM nation
  UNION ALL SELECT 'clm_customer_' || c_custkey, c_custkey, 'clm_nation_' || c_nationkey FROM customer UNION ALL SELECT 'clm_supplier_' || s_suppkey, s_suppkey, 'clm_nation_' || s_nationkey FROM supplier
  UNION ALL SELECT 'clm_order_' || o_orderkey, o_orderkey, 'clm_customer_' || o_custkey FROM orders),
direct AS (SELECT 'clm_region_' || r_regionkey AS claim_id FROM region WHERE 'registry://' || r_name = '{SOURCE}' UNION SELECT 'clm_nation_' || n_nationkey FROM nation WHERE 'registry://' || n_name = '{SOURCE}'),
walk AS (SELECT claim_id, CAST(NULL AS VARCHAR) AS via, 0 AS level FROM direct UNION SELECT c.claim_id, c.parent, w.level + 1 FROM walk w JOIN claims c ON c.parent = w.claim_id)
"""




def _after(seeds: str, note: str, reason: str, changed: str) -> str:
    """Claims of the hierarchy after a command. seeds: claims whose dependents are flagged; changed: rows (claim_id, status, flag,
    why, superseded_by, retracted_by) of the claims that the command itself changes; flags come after it."""
    able = "s NOT IN ('needs_review', 'superseded', 'retracted')"
    return f"""
WITH RECURSIVE claims AS (
  SELECT claim_id, parent, ({_list(STATUSES)})[k % 8 + 1] AS s FROM ({HIERARCHY[HIERARCHY.index("SELECT"):HIERARCHY.index("),")]})),
seeds AS ({seeds}),
walk AS (SELECT claim_id, CAST(NULL AS VARCHAR) AS via, 0 AS level FROM seeds UNION SELECT c.claim_id, c.parent, w.level + 1 FROM walk w JOIN claims c ON c.parent = w.claim_id),
found AS (SELECT claim_id, min(level) AS level, arg_min(via, level) AS via FROM walk GROUP BY claim_id),
flags AS (SELECT claim_id, CASE WHEN level = 0 THEN {note} ELSE {reason} || ' (upstream ' || substr(via, 1, 12) || ')' END AS why FROM found JOIN claims USING (claim_id)
  WHERE {able} AND (level > 0 OR {note} IS NOT NULL)),
changed AS ({changed})
SELECT c.claim_id, CASE WHEN f.why IS NOT NULL THEN 'needs_review' ELSE coalesce(x.status, c.s) END AS epistemic_status, f.why IS NOT NULL OR coalesce(x.flag, false) AS needs_review,
  coalesce(f.why, x.why) AS review_reason, x.superseded_by, x.retracted_by
FROM claims c LEFT JOIN flags f USING (claim_id) LEFT JOIN changed x USING (claim_id)"""


def _own(claim: str, status: str, flag: str = "false", why: str = "NULL", by: str = "NULL", who: str = "NULL") -> str:
    return f"SELECT '{claim}' AS claim_id, '{status}' AS status, {flag} AS flag, CAST({why} AS VARCHAR) AS why, CAST({by} AS VARCHAR) AS superseded_by, CAST({who} AS VARCHAR) AS retracted_by"


_NOBODY = _own("none", "none") + " WHERE false"
_SID = f"substr('src_' || substr(sha256(lower('{SOURCE}')), 1, 16), 1, 12)"
_DIRECT = HIERARCHY[HIERARCHY.index("direct AS (") + len("direct AS (") : HIERARCHY.index("walk AS (")].strip().rstrip(",").rstrip(")")
_EFFECTS = {
    "discredit_effects": _after(_DIRECT, f"'cites discredited source ' || {_SID}", f"'depends on claim citing discredited source ' || {_SID}", _NOBODY),
    "retract_effects": _after("SELECT 'clm_nation_4' AS claim_id", "NULL", "'depends on retracted claim clm_nation_4'", _own("clm_nation_4", "retracted", who="'me'")),
    "supersede_effects": _after("SELECT 'clm_region_1' AS claim_id", "NULL", "'depends on superseded claim clm_region_1'", _own("clm_region_1", "superseded", by="'clm_region_2'")),
    "invalidate_effects": _after("SELECT 'clm_region_3' AS claim_id", "NULL", "'depends on invalidated claim clm_region_3'", _own("clm_region_3", "disputed")),
    "status_effects": _after("SELECT 'none' AS claim_id", "NULL", "NULL", _own("clm_nation_9", "confirmed")),
    "rebuttal_effects": _after("SELECT 'none' AS claim_id", "NULL", "NULL", _own("clm_nation_9", "needs_review", "true", "'rebuttal condition met: it moved'")),
}


def _tokens(x: str) -> str:
    """Token set of an ASCII expression that is normalised already."""
    return f"list_distinct(list_concat(list_filter(regexp_split_to_array({x}, '[^a-z0-9_]+'), lambda t: t <> ''), list_transform(range(1, length({x}) + 1), lambda i: substr(' ' || {x} || ' ', i, 3))))"


_NAMES = f"SELECT DISTINCT lower(p_name) AS n, {_tokens('lower(p_name)')} AS t FROM part"
_SIM = "CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / len(list_distinct(list_concat(a.t, b.t)))"


_NULL = "CAST(NULL AS VARCHAR)"
_LINT = {
    "unlinked": "SELECT claim_a, claim_b, CASE WHEN functional THEN 'error' ELSE 'warning' END AS severity FROM pairs WHERE NOT already_linked",
    "non_falsifiable": f"SELECT claim_id AS claim_a, {_NULL} AS claim_b, 'error' AS severity FROM claims WHERE p_size % 10 = 0 AND status NOT IN ('retracted', 'superseded')",
    "overconfidence": f"SELECT claim_id AS claim_a, {_NULL} AS claim_b, 'warning' AS severity FROM claims WHERE method = 'self_report'",
    "uncertainty": f"SELECT c.claim_id AS claim_a, {_NULL} AS claim_b, 'warning' AS severity FROM claims c JOIN claims p ON c.parent = p.claim_id WHERE c.p_size % 3 = 0 AND c.rank > p.rank",
    "orphan_source": f"SELECT claim_id AS claim_a, {_NULL} AS claim_b, 'error' AS severity FROM claims WHERE status IN ('probable', 'corroborated', 'confirmed') AND claim_id IN (SELECT claim_id FROM evidence JOIN sources USING (source_id) WHERE discredited)",
    "orphan_parent": f"SELECT c.claim_id AS claim_a, {_NULL} AS claim_b, 'error' AS severity FROM claims c JOIN claims p ON c.parent = p.claim_id WHERE c.status IN ('probable', 'corroborated', 'confirmed') AND p.status IN ('retracted', 'superseded')",
}
_QUEUE = {
    "low_corroboration": f"SELECT claim_id AS claim_a, {_NULL} AS claim_b, {_NULL} AS thread_id FROM claims LEFT JOIN auth USING (claim_id) WHERE score >= 0.8 AND status IN ('probable', 'corroborated', 'confirmed') AND coalesce(n_authoritative, 0) < 2",
    "misinformation": f"SELECT {_NULL} AS claim_a, {_NULL} AS claim_b, thread_id FROM threads WHERE conflict_type = 'misinformation' AND status = 'open'",
    "authority_contradiction": f"SELECT claim_a, claim_b, {_NULL} AS thread_id FROM pairs WHERE functional AND already_linked",
}

_COERCE = {f: "CASE lower(trim(x)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in known.items()) + " ELSE x END" for f, known in ALIASES.items()}
_VALUES = _list(["Medium", " hi", "LO", "high", "50/50", "Certain", "likely", "odd"])

ORACLES: dict[str, str] = {
    "fold_claims": EVENTS + "SELECT 'clm_' || user_id AS claim_id, status AS epistemic_status, flag AS needs_review, why AS review_reason, gone AS t_expired, sup AS superseded_by, ret AS retracted_by, score AS confidence_score, how AS confidence_method FROM final",
    "fold_part_claims": PARTS + "SELECT claim_id, subj, pred, obj, status AS epistemic_status, score AS confidence_score, band AS likelihood_band, seq AS created_seq, CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS n_rebuttal FROM claims",
    "fold_sources": PARTS + "SELECT source_id, uri, title, authority, discredited, CASE WHEN discredited THEN 'audit' END AS discredit_reason FROM sources",
    "fold_evidence": PARTS + "SELECT evidence_id, claim_id, source_id, locator FROM evidence",
    "fold_edges": PARTS + "SELECT DISTINCT 'edg_dep_' || substr(claim_id, 5) || '_' || substr(parent, 5, 10) AS edge_id, 'depends_on' AS kind, claim_id AS from_id, parent AS to_id, CAST(NULL AS VARCHAR) AS meta FROM made WHERE parent IS NOT NULL UNION ALL SELECT 'edg_cfl_' || name, 'conflicts_with', claim_a, claim_b, '{\"type\":\"' || kind || '\"}' FROM links",
    "fold_threads": PARTS + "SELECT thread_id, claim_a, claim_b, conflict_type, status, note FROM threads",
    "fold_runs": "SELECT 'run_' || n_regionkey AS run_id, arg_max(n_name, n_nationkey) AS role FROM nation GROUP BY n_regionkey",
    "revisions": "SELECT event_id AS seq, 'clm_' || user_id AS claim_id, CASE WHEN event_type = 'click' THEN 'rebuttal_triggered' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'confidence_recalibrated' WHEN event_type IN ('view', 'purchase') THEN 'status_changed' WHEN event_id % 3 = 0 THEN 'claim_retracted' WHEN event_id % 3 = 1 THEN 'claim_invalidated' ELSE 'claim_superseded' END AS event, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'probable' END WHEN event_type = 'purchase' AND event_id % 4 <> 0 THEN 'corroborated' END AS to_status FROM events WHERE event_type <> 'signup'",
    "as_of_system": EVENTS_CUT + "SELECT 'clm_' || user_id AS claim_id, 'clm_' || user_id AS subj, 'is_a' AS pred, 'user' AS obj, status AS epistemic_status, score AS confidence_score FROM final WHERE status IN ('probable', 'corroborated', 'confirmed')",
    "as_of_world": f"SELECT 'clm_' || o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'probable' END AS epistemic_status, CAST(o_orderdate AS DATE) AS valid_on, CAST(e AS DATE) AS invalid_on FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate <= TIMESTAMP '{WORLD}' AND (e IS NULL OR e > TIMESTAMP '{WORLD}')",
    "as_of_both": f"SELECT 'clm_' || o_orderkey AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'confirmed' ELSE 'probable' END AS epistemic_status FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND o_orderdate <= TIMESTAMP '1998-04-01' AND (e IS NULL OR e > TIMESTAMP '{WORLD}')",
    "by_status": PARTS + "SELECT claim_id, subj, pred, obj, score AS confidence_score FROM claims WHERE status = 'disputed'",
    "revision_log": "SELECT event_id AS seq, CASE WHEN event_type = 'click' THEN 'rebuttal_triggered' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'confidence_recalibrated' WHEN event_type IN ('view', 'purchase') THEN 'status_changed' WHEN event_id % 3 = 0 THEN 'claim_retracted' WHEN event_id % 3 = 1 THEN 'claim_invalidated' ELSE 'claim_superseded' END AS event, ts AS t_created FROM events WHERE event_type <> 'signup' AND user_id = 7",
    "get_claim": EVENTS + "SELECT 'clm_' || user_id AS claim_id, status AS epistemic_status, score AS confidence_score FROM final WHERE user_id = 7",
    "show_claim": PARTS + "SELECT c.claim_id, coalesce(e.n, 0) AS n_evidence, (SELECT count(DISTINCT CASE WHEN l.claim_a = c.claim_id THEN l.claim_b ELSE l.claim_a END) FROM links l WHERE c.claim_id IN (l.claim_a, l.claim_b)) AS n_conflicts, CAST(0 AS BIGINT) AS n_revisions, e.f AS first_evidence FROM claims c LEFT JOIN (SELECT claim_id, count(*) AS n, min(evidence_id) AS f FROM evidence GROUP BY 1) e USING (claim_id)",
    "conflict_neighbours": PARTS + "SELECT claim_a AS claim_id, claim_b AS other FROM links UNION SELECT claim_b, claim_a FROM links",
    "status_counts": PARTS + f"SELECT status, CAST(list_position({_list(STATUSES)}, status) AS BIGINT) AS rank, count(*) AS n FROM claims GROUP BY status",
    "corpus_totals": PARTS + "SELECT (SELECT count(*) FROM claims) AS claims, (SELECT count(*) FROM sources) AS sources, (SELECT count(*) FROM sources WHERE discredited) AS discredited, (SELECT count(*) FROM threads) AS threads, (SELECT count(*) FROM threads WHERE status = 'open') AS open_threads",
    "report_believed": PARTS + "SELECT claim_id, status AS epistemic_status, score AS confidence_score, '[' || rpad(status, 11, ' ') || ' ' || format('{:.2f}', score) || '] ' || subj || ' - ' || pred || ' - ' || obj AS line FROM claims WHERE status IN ('probable', 'corroborated', 'confirmed')",
    "report_health": PARTS + "SELECT severity AS kind, count(*) AS n FROM (" + " UNION ALL ".join(_LINT.values()) + ") GROUP BY 1 UNION ALL SELECT 'review', count(*) FROM (" + " UNION ALL ".join(_QUEUE.values()) + ")",
    "promotion_check": PARTS + "SELECT claim_id, status, coalesce(n_authoritative, 0) AS distinct_authoritative_sources, score AS confidence_score, CAST(CASE WHEN p_size % 10 = 0 THEN 0 ELSE 1 END AS BIGINT) AS stated_rebuttal_conditions, coalesce(n_authoritative, 0) >= 2 AND score >= 0.7 AS eligible_corroborated, coalesce(n_authoritative, 0) >= 2 AND score >= 0.9 AS eligible_confirmed, method AS confidence_method FROM claims LEFT JOIN auth USING (claim_id)",
    "authoritative_sources": PARTS + "SELECT claim_id, n_sources, n_authoritative FROM auth",
    "detect_conflicts": PARTS + "SELECT claim_a, claim_b, subject, predicate, object_a, object_b, functional, CASE WHEN functional THEN 'conflict' ELSE 'suggestion' END AS severity, already_linked FROM pairs",
    "fuzzy_candidates": PARTS + f""", names AS ({_NAMES}), near AS (SELECT a.n AS x, b.n AS y FROM names a JOIN names b ON a.n <> b.n WHERE {_SIM} >= 0.6),
      src AS (SELECT claim_id, list(DISTINCT source_id) AS s FROM evidence GROUP BY 1),
      objs AS (SELECT DISTINCT lower(obj) AS n, {_tokens('lower(obj)')} AS t FROM claims), osim AS (SELECT a.n AS x, b.n AS y FROM objs a JOIN objs b ON true WHERE a.n = b.n OR {_SIM} >= 0.8)
      SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, CASE WHEN o.x IS NOT NULL THEN 'same_object' WHEN a.pred = 'is_a' THEN 'diff_object_functional' ELSE 'diff_object_multivalued' END AS severity,
        CASE WHEN sa.s IS NULL OR sb.s IS NULL THEN 'unknown' WHEN list_has_any(sa.s, sb.s) THEN 'shared' ELSE 'independent' END AS source_relation, false AS already_linked, coalesce(len(sa.s), 0) AS n_a, coalesce(len(sb.s), 0) AS n_b
      FROM live a JOIN near ON lower(a.subj) = near.x JOIN live b ON lower(b.subj) = near.y AND a.pred = b.pred AND a.seq < b.seq LEFT JOIN osim o ON o.x = lower(a.obj) AND o.y = lower(b.obj) LEFT JOIN src sa ON sa.claim_id = a.claim_id LEFT JOIN src sb ON sb.claim_id = b.claim_id""",
    "jaccard_pairs": f"WITH names AS ({_NAMES}) SELECT a.n AS a, b.n AS b, round({_SIM}, 6) AS sim FROM names a JOIN names b ON a.n < b.n WHERE {_SIM} >= 0.3",
    "token_sets": f"SELECT DISTINCT p_name AS name, array_to_string(list_sort({_tokens('lower(p_name)')}), '|') AS tokens FROM part",
    "cosine_pairs": "SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
    # the only character of the tables whose case folding is not its lower case is the sharp s
    "normalize_text": "SELECT doc_id, length(n) AS n_chars, length(n) - length(replace(n, ' ', '')) AS n_spaces FROM (SELECT doc_id, trim(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', ' ', 'g')) AS n FROM documents)",
    "ids": "SELECT *, 'evd_' || substr(sha256(claim_id || '|' || source_id || '|' || c_custkey), 1, 16) AS evidence_id, 'edg_dep_' || substr(claim_id, 5) || '_' || substr(claim_id, 5, 10) AS edge_id FROM (SELECT c_custkey, 'src_' || substr(sha256(lower(c_name)), 1, 16) AS source_id, 'clm_' || substr(sha256('t|' || lower(c_name) || '|in segment|' || lower(c_mktsegment)), 1, 16) AS claim_id FROM customer)",
    "downstream_direct": HIERARCHY + "SELECT claim_id FROM direct",
    "downstream_transitive": HIERARCHY + "SELECT claim_id, min(via) AS via, level FROM walk WHERE level > 0 GROUP BY claim_id, level",
    "cascade_flags": HIERARCHY + f"SELECT w.claim_id, s AS \"from\", 'audit (upstream ' || substr(via, 1, 12) || ')' AS reason, level FROM walk w JOIN (SELECT claim_id, ({_list(STATUSES)})[k % 8 + 1] AS s FROM claims) USING (claim_id) WHERE level > 0 AND s NOT IN ('needs_review', 'superseded', 'retracted')",
    "transition_legality": "SELECT f AS from_status, t AS to_status, count(*) AS n, [f, t] IN (" + ", ".join(f"['{a}', '{b}']" for a, to in TRANSITIONS.items() for b in to) + ") AS legal FROM (SELECT lag(t) OVER (PARTITION BY user_id ORDER BY event_id) AS f, t FROM (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'corroborated' WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'probable' END AS t FROM events WHERE event_type = 'view' OR event_type = 'purchase' AND event_id % 4 <> 0)) WHERE f IS NOT NULL GROUP BY f, t",
    "enum_coercion": f"SELECT c_custkey, {_COERCE['analytic_confidence']} AS confidence, {_COERCE['likelihood_band']} AS band FROM (SELECT c_custkey, ({_VALUES})[c_custkey % 8 + 1] AS x FROM customer)",
    "ingest_validate": "WITH k AS (SELECT c_custkey AS k, c_acctbal FROM customer), f AS (SELECT CASE WHEN k % 11 = 0 THEN 'assertion' END AS field FROM k UNION ALL SELECT CASE WHEN k % 7 = 0 THEN 'warrant' END FROM k UNION ALL SELECT CASE WHEN k % 5 = 0 THEN 'rebuttal_conditions' END FROM k UNION ALL SELECT CASE WHEN k % 13 = 0 THEN 'epistemic_status' END FROM k UNION ALL SELECT CASE WHEN c_acctbal / 10000 NOT BETWEEN 0 AND 1 THEN 'confidence_score' END FROM k UNION ALL SELECT CASE WHEN k % 17 = 0 THEN 't_valid' END FROM k UNION ALL SELECT CASE WHEN k % 3 = 0 THEN 'depends_on' END FROM k) SELECT field, count(*) AS n FROM f WHERE field IS NOT NULL GROUP BY field",
    "ingest_batch": """
WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, 'clm_' || substr(sha256('customers|' || lower(c_name) || '|in_segment|' || lower(c_mktsegment)), 1, 16) AS claim_id, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f FROM customer),
s AS (SELECT DISTINCT n, 'src_' || substr(sha256('registry://nation/' || n), 1, 16) AS source_id FROM c)
SELECT 'agent_run_started' AS event, 'run_' || n AS agent_run, CAST(NULL AS VARCHAR) AS claim_id, CAST(NULL AS VARCHAR) AS source_id, CAST(NULL AS VARCHAR) AS uri, CAST(NULL AS VARCHAR) AS evidence_id, CAST(NULL AS VARCHAR) AS parent FROM s
UNION ALL SELECT 'source_registered', 'run_' || n, NULL, source_id, 'registry://nation/' || n, NULL, NULL FROM s
UNION ALL SELECT 'source_registered', 'run_' || n, NULL, 'src_' || substr(sha256('registry://old'), 1, 16), 'registry://old', NULL, NULL FROM s
UNION ALL SELECT 'claim_created', 'run_' || c.n, c.claim_id, NULL, NULL, NULL, CASE WHEN c.k <> c.f THEN p.claim_id END FROM c JOIN c p ON p.k = c.f WHERE c.k % 2 = 1
UNION ALL SELECT 'evidence_added', 'run_' || c.n, c.claim_id, s.source_id, NULL, 'evd_' || substr(sha256(c.claim_id || '|' || s.source_id || '|' || c.k), 1, 16), NULL FROM c JOIN s USING (n)""",
    "ingest_source_rules": "SELECT m AS message, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'uri: required' END AS m FROM supplier UNION ALL SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'authority: a number is required' END FROM supplier) WHERE m IS NOT NULL GROUP BY 1",
    "link_effects": "SELECT 'thr_nation_2_nation_3' AS thread_id, 'misinformation' AS conflict_type, 'closed' AS status, 'done' AS note, claim_id, 'disputed' AS epistemic_status FROM (VALUES ('clm_nation_2'), ('clm_nation_3')) t(claim_id)",
    "fold_supersedes": "SELECT DISTINCT 'edg_sup_' || (user_id + 1) || '_' || substr(CAST(user_id AS VARCHAR), 1, 8) AS edge_id, 'clm_' || (user_id + 1) AS from_id, 'clm_' || user_id AS to_id FROM events WHERE event_type NOT IN ('signup', 'click', 'purchase', 'view') AND event_id % 3 = 2",
    "log_from_files": EVENTS + "SELECT 'clm_' || user_id AS claim_id, status AS epistemic_status, flag AS needs_review, why AS review_reason, gone AS t_expired, sup AS superseded_by, ret AS retracted_by, score AS confidence_score, how AS confidence_method FROM final",
    "top_conflicts": PARTS + "SELECT claim_a, claim_b, functional, already_linked FROM pairs ORDER BY already_linked, functional DESC, claim_a, claim_b LIMIT 50",
    "fuzzy_scores": PARTS + f""", names AS ({_NAMES}), near AS (SELECT a.n AS x, b.n AS y, {_SIM} AS sim FROM names a JOIN names b ON a.n <> b.n WHERE {_SIM} >= 0.6),
      objs AS (SELECT DISTINCT lower(obj) AS n, {_tokens('lower(obj)')} AS t FROM claims), osim AS (SELECT a.n AS x, b.n AS y, CASE WHEN a.n = b.n THEN 1.0 ELSE {_SIM} END AS sim FROM objs a JOIN objs b ON true)
      SELECT a.claim_id AS claim_a, b.claim_id AS claim_b, round_even(near.sim, 3) AS subj_sim, CAST(1.0 AS DOUBLE) AS pred_sim, round_even(CAST(o.sim AS DOUBLE), 3) AS obj_sim, CASE WHEN o.sim >= 0.8 THEN 'same_object' ELSE 'diff_object' END AS relation
      FROM live a JOIN near ON lower(a.subj) = near.x JOIN live b ON lower(b.subj) = near.y AND a.pred = b.pred AND a.seq < b.seq JOIN osim o ON o.x = lower(a.obj) AND o.y = lower(b.obj)""",
    "vector_pairs": "SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, least(1, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3",
    "ingest_dedup": f"SELECT DISTINCT {_ID.format(p='is_a', o='p_brand')} AS claim_id FROM part",
    "log_scan_guard": "SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'claim_created' WHEN event_type = 'click' THEN 'rebuttal_triggered' WHEN event_type = 'purchase' AND event_id % 4 = 0 THEN 'confidence_recalibrated' WHEN event_type IN ('view', 'purchase') THEN 'status_changed' WHEN event_id % 3 = 0 THEN 'claim_retracted' WHEN event_id % 3 = 1 THEN 'claim_invalidated' ELSE 'claim_superseded' END AS event, 'clm_' || user_id AS claim_id, ts AS t_created, CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'needs_review' ELSE 'probable' END WHEN event_type = 'purchase' THEN 'corroborated' END AS \"to\", value / 500 AS new_score FROM events",
    "queue_needs_review": EVENTS + "SELECT 'clm_' || user_id AS claim_a, why AS detail FROM final WHERE flag",
} | {f"lint_{k}": PARTS + v for k, v in _LINT.items()} | {f"queue_{k}": PARTS + v for k, v in _QUEUE.items()} | _EFFECTS
