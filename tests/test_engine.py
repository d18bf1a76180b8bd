"""The fold against a sequential model, the golden log, readers, commands, ingest, closure and streaming."""

import json
import random

import pytest
from pyspark.sql import functions as F

from credence import functions as fn
from credence.operators import conflicts, guard, ingest, lineage, report, temporal
from credence.operators.revise import Command
from credence.plans import State
from credence.schema import LOG, STATUSES
from credence.sources import append, guard as guarded, read_batch, read_log, read_table
from credence.starschema import log_of
from credence.streaming import fold_stream, log_stream

T = "2026-01-01T00:00:00.000000+00:00"


def write_log(path, events, raw=()):
    with open(path, "w") as f:
        for i, (kind, more) in enumerate(events):
            f.write(json.dumps({"v": 1, "event": kind, "topic": "t", "t_created": f"2026-01-01T00:{i // 60 % 60:02}:{i % 60:02}.000000+00:00", "agent_run": None, **more}) + "\n")
        for line in raw:
            f.write(line + "\n")
    return str(path)


def claim(cid, s="S", p="is_a", o="O", **more):
    base = {"claim_id": cid, "assertion": {"s": s, "p": p, "o": o}, "warrant": "w", "backing": [], "rebuttal_conditions": ["r"], "grounds": [], "epistemic_status": "probable", "depends_on": []}
    return ("claim_created", base | more)


def model(events):
    """One event after the other."""
    out = {}
    for kind, e in events:
        cid = e.get("claim_id") or e.get("old_claim_id")
        c = out.get(cid)
        if kind == "claim_created":
            out.setdefault(cid, {"status": e["epistemic_status"], "flag": False, "why": None, "score": e.get("confidence_score"), "by": None, "ret": None, "gone": False})
        elif c is None:
            continue
        elif kind == "status_changed":
            c["status"], c["flag"] = e["to"], e["to"] == "needs_review"
            c["why"] = e.get("reason") if c["flag"] else None
        elif kind == "rebuttal_triggered":
            if c["status"] not in ("retracted", "superseded"):
                c["status"] = "needs_review"
            c["flag"], c["why"] = True, f"rebuttal condition met: {e.get('condition')}"
        elif kind == "confidence_recalibrated":
            c["score"] = e["new_score"]
        else:
            c["gone"] = True
            c["status"] = {"claim_superseded": "superseded", "claim_retracted": "retracted"}.get(kind) or e.get("new_status") or "retracted"
            if kind == "claim_superseded":
                c["by"] = e["new_claim_id"]
            if kind == "claim_retracted":
                c["ret"] = e.get("retracted_by")
    return out


def folded(state):
    return {r.claim_id: {"status": r.epistemic_status, "flag": r.needs_review, "why": r.review_reason, "score": r.confidence_score, "by": r.superseded_by, "ret": r.retracted_by, "gone": r.t_expired is not None} for r in state.claims.collect()}


def random_events(rng, n, claims):
    out = []
    for _ in range(n):
        cid = f"clm_{rng.randrange(claims)}"
        kind = rng.choice(["claim_created", "status_changed", "status_changed", "rebuttal_triggered", "confidence_recalibrated", "claim_invalidated", "claim_superseded", "claim_retracted"])
        out.append({
            "claim_created": claim(cid, epistemic_status=rng.choice([None, *STATUSES]), confidence_score=rng.choice([None, 0.5])),
            "status_changed": (kind, {"claim_id": cid, "from": None, "to": rng.choice(STATUSES), "reason": rng.choice([None, "x"])}),
            "rebuttal_triggered": (kind, {"claim_id": cid, "condition": rng.choice([None, "c"])}),
            "confidence_recalibrated": (kind, {"claim_id": cid, "new_score": rng.choice([0.1, 0.9]), "method": "human"}),
            "claim_invalidated": (kind, {"claim_id": cid, "new_status": rng.choice([None, "disputed", "retracted"])}),
            "claim_superseded": (kind, {"old_claim_id": cid, "new_claim_id": "clm_n"}),
            "claim_retracted": (kind, {"claim_id": cid, "reason": "r", "retracted_by": rng.choice([None, "me"])}),
        }[kind])
    return out


def test_fold_of_random_logs_equals_the_model(spark, tmp_path):
    for seed in range(3):
        events = random_events(random.Random(seed), 3000, 400)
        assert folded(State(read_log(spark, write_log(tmp_path / f"{seed}.jsonl", events)))) == model(events)


def test_order_of_lines_over_many_splits(spark, tmp_path):
    events = [("seed_marker", {"note": str(i)}) for i in range(5000)]
    path = write_log(tmp_path / "a.jsonl", events)
    text = open(path).read().replace("\n", "\n\n", 2000)
    open(path, "w").write(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = read_log(spark, path)
        assert log.rdd.getNumPartitions() > 1
        rows = log.select("seq", "note").orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.note) for r in rows] == list(range(5000)) and len({r.seq for r in rows}) == 5000


@pytest.mark.parametrize(("line", "said"), [("<<<<<<< HEAD", "merge conflict"), ("{oops", "malformed"), ('{"event": "made_up"}', "unknown event"), ("=======", "merge conflict"), ('{"v": 1}', "unknown event")])
def test_bad_lines_fail_and_name_their_place(spark, tmp_path, line, said):
    path = write_log(tmp_path / "bad.jsonl", [("seed_marker", {})], ["", line])
    with pytest.raises(Exception, match=said):
        State(read_log(spark, path), F.lit("2020-01-01").cast("timestamp")).log.collect()


def demo(spark, tmp_path):
    """The worked example: a discredited registry, a linked contradiction and a claim with an end."""
    sources = [("source_registered", {"source_id": f"src_{n}", "uri": n, "authority": a}) for n, a in (("registry", 0.95), ("wire", 0.85), ("blog", 0.3), ("archive", 0.8))]
    cites = lambda c, s: ("evidence_added", {"evidence_id": f"evd_{c}_{s}", "claim_id": f"clm_{c}", "source_id": f"src_{s}"})
    moves = lambda c, a, b: ("status_changed", {"claim_id": f"clm_{c}", "from": a, "to": b, "reason": "x"})
    events = [("seed_marker", {"note": "n"}), ("agent_run_started", {"run_id": "r", "role": "a"}), *sources]
    events += [claim("clm_hq", "Nexa Corp", "headquartered_in", "Berlin", confidence_score=0.85), cites("hq", "registry"), cites("hq", "wire")]
    events += [claim("clm_tax", "Nexa Corp", "pays_tax_in", "Germany", depends_on=["clm_hq"]), cites("tax", "registry"), claim("clm_munich", "nexa  corp", "headquartered_in", "Munich"), cites("munich", "blog")]
    events += [claim("clm_ceo", "Nexa Corp", "ceo_is", "Alice", confidence_score=0.8, t_valid="2015-01-01T00:00:00+00:00", t_invalid="2020-01-01T02:00:00+02:00"), cites("ceo", "wire"), cites("ceo", "archive"), moves("hq", "probable", "corroborated"), moves("ceo", "probable", "corroborated")]
    cut = len(events) - 1
    events += [("conflict_linked", {"edge_id": "edg_cfl_1", "thread_id": "thr_1", "claim_a": "clm_hq", "claim_b": "clm_munich", "conflict_type": "factual"}), moves("munich", "probable", "disputed"), ("source_discredited", {"source_id": "src_registry", "reason": "forged"}), moves("hq", "corroborated", "needs_review"), moves("tax", "probable", "needs_review")]
    return read_log(spark, write_log(tmp_path / "demo.jsonl", events)), cut


def ids(df, column="claim_id"):
    return sorted(r[column] for r in df.collect())


def test_worked_example(spark, tmp_path):
    log, cut = demo(spark, tmp_path)
    state, at = State(log), lambda s: F.lit(s).cast("timestamp")
    assert ids(temporal.as_of_system(log, at(f"2026-01-01 00:00:{cut:02}"))) == ["clm_ceo", "clm_hq", "clm_munich", "clm_tax"]
    assert ids(state.believed) == ["clm_ceo"]
    assert ids(temporal.as_of_world(state, at("2017-06-01"))) == ["clm_ceo"] and ids(temporal.as_of_world(state, at("2022-06-01"))) == []
    assert ids(temporal.as_of_world(state, at("2015-01-01"))) == ["clm_ceo"] and ids(temporal.as_of_world(state, at("2020-01-01"))) == []
    (pair,) = conflicts.detect(state).collect()
    assert (pair.claim_a, pair.claim_b, pair.functional, pair.already_linked) == ("clm_hq", "clm_munich", True, True)
    assert guard.lint(state).collect() == []
    assert sorted((r.trigger, r.claim_a) for r in guard.review_queue(state).collect()) == [("authority_contradiction", "clm_hq"), ("needs_review", "clm_hq"), ("needs_review", "clm_tax")]
    assert report.totals(state).first().asDict() == {"claims": 4, "sources": 4, "discredited": 1, "threads": 1, "open_threads": 1}
    direct, rest = lineage.downstream(state, "src_registry")
    assert ids(direct) == ["clm_hq", "clm_tax"] and ids(rest) == []
    checks = {r.claim_id: (r.distinct_authoritative_sources, r.eligible_corroborated, r.eligible_confirmed) for r in guard.promotion(state).collect()}
    assert checks["clm_ceo"] == (2, True, False) and checks["clm_hq"] == (1, False, False)
    assert conflicts.fuzzy(state).collect() == []
    shown = temporal.show(state, "clm_hq").first()
    assert len(shown.evidence) == 2 and shown.conflicts_with == ["clm_munich"] and [r.event for r in shown.revisions] == ["status_changed"] * 2
    assert [r.line for r in report.believed(state).collect()] == ["[corroborated 0.80] Nexa Corp - ceo_is - Alice"] or report.believed(state).count() == 1


def test_fuzzy_pairs_of_names(spark, tmp_path):
    events = [claim(f"clm_{i}", s, "was_born_in", o) for i, (s, o) in enumerate([("John F. Kennedy", "Brookline"), ("John Kennedy", "Boston"), ("John F Kennedy", "Brookline")])]
    events += [("evidence_added", {"evidence_id": f"e{i}", "claim_id": f"clm_{i}", "source_id": s}) for i, s in enumerate(["enc", "enc", "atlas"])]
    found = conflicts.fuzzy_ranked(conflicts.fuzzy(State(read_log(spark, write_log(tmp_path / "f.jsonl", events))))).collect()
    assert [(r.claim_a, r.claim_b, r.subj_sim, r.pred_sim, r.obj_sim, r.severity, r.source_relation) for r in found] == [
        ("clm_1", "clm_2", 0.722, 1.0, 0.0, "diff_object_functional", "independent"), ("clm_0", "clm_1", 0.684, 1.0, 0.0, "diff_object_functional", "shared"), ("clm_0", "clm_2", 0.75, 1.0, 1.0, "same_object", "independent"),
    ]


def py_tokens(n):
    import re

    padded = f" {n} "
    grams = {padded[i : i + 3] for i in range(len(n))} if len(padded) > 3 else ({n.strip()} - {""})
    return {t for t in re.split(r"[^\w]+", n) if t} | grams


def test_similarity_join_equals_all_pairs(spark):
    rng = random.Random(5)
    names = sorted({" ".join(rng.choice(["red", "blue", "rød", "bolt", "nut", "ring", "x"]) for _ in range(rng.randint(1, 4))) for _ in range(150)})
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for theta in (0.3, 0.6, 1.0):
        want = {(a, b) for a in names for b in names if a < b and len(py_tokens(a) & py_tokens(b)) / len(py_tokens(a) | py_tokens(b)) >= theta}
        assert {(r.a, r.b) for r in conflicts.similar(df, theta).collect()} == want
    with pytest.raises(ValueError, match="threshold"):
        conflicts.similar(df, 0)


def test_normalise_and_scalars(spark):
    import re
    import unicodedata

    texts = ["  A\tB ", "Straße", "ΣΑΣ", "İx", "ﬁn", "a\xa0b", "x　y", "\x1ca\x1d", "é", "", "z\x85q", None]
    want = [re.sub(r"\s+", " ", unicodedata.normalize("NFC", t or "").strip().casefold()) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", fn.normalize(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == want
    one = spark.range(1).select(
        fn.utc(F.lit("2021-01-01T02:00:00+02:00")).alias("a"), fn.utc(F.lit("2016-01-01T00:00:00Z")).alias("b"), fn.utc(F.lit("2016-01-01")).alias("c"), fn.utc(F.lit("2016")).alias("d"), fn.utc(F.lit("")).alias("e"),
        fn.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("f"), fn.cosine(F.array(F.lit(1.0)), F.array(F.lit(-1.0))).alias("g"), fn.coerce("analytic_confidence", F.lit(" Medium ")).alias("h"), fn.jaccard(fn.token_set(F.lit("ab ab")), fn.token_set(F.lit("ab ab ab"))).alias("i"),
    )
    text = one.select(fn.utc_text(F.col("a")), fn.utc_text(F.col("b")), fn.utc_text(F.col("c"))).first()
    assert list(text) == ["2021-01-01T00:00:00.000000+00:00", "2016-01-01T00:00:00.000000+00:00", "2016-01-01T00:00:00.000000+00:00"]
    r = one.first()
    assert (r.d, r.e, r.f, r.g, r.h, r.i) == (None, None, 0.0, 0.0, "mod", 1.0)


def apply(spark, log, rows):
    return log.unionByName(rows, allowMissingColumns=True)


def chain(spark, tmp_path):
    """C rests on B rests on A, D on B and A, and A on D: a diamond with a cycle; the source is cited by A only."""
    events = [("source_registered", {"source_id": "src_x", "uri": "x", "authority": 0.9}), claim("clm_a", o="a", depends_on=["clm_d"]), claim("clm_b", o="b", p="q", depends_on=["clm_a"], epistemic_status="needs_review"), claim("clm_c", o="c", p="r", depends_on=["clm_b"]), claim("clm_d", o="d", p="s", depends_on=["clm_b", "clm_a"]), ("evidence_added", {"evidence_id": "e", "claim_id": "clm_a", "source_id": "src_x"})]
    return read_log(spark, write_log(tmp_path / "chain.jsonl", events))


def test_cascades_go_through_flagged_claims_and_end_in_cycles(spark, tmp_path):
    log = chain(spark, tmp_path)
    found = lineage.reach(State(log).edges, lineage.citing(State(log), "src_x"))
    assert sorted((r.claim_id, r.via, r.level) for r in found.collect()) == [("clm_b", "clm_a", 1), ("clm_c", "clm_b", 2), ("clm_d", "clm_a", 1)]
    rows = Command(log, "t").discredit("src_x", "forged").orderBy("seq").collect()
    assert [(r.event, r.claim_id) for r in rows] == [("source_discredited", None), ("status_changed", "clm_a"), ("status_changed", "clm_d"), ("status_changed", "clm_c")]
    assert rows[1].reason == "cites discredited source src_x" and rows[3].reason.endswith("(upstream clm_b)")
    after = State(apply(spark, log, Command(log, "t").discredit("src_x", "forged")))
    assert ids(after.claims.where("epistemic_status = 'needs_review'")) == ["clm_a", "clm_b", "clm_c", "clm_d"]
    back = State(apply(spark, after.log, Command(after.log, "t").recredit("src_x")))
    assert not back.sources.first().discredited and back.believed.count() == 0


def test_commands(spark, tmp_path):
    log = chain(spark, tmp_path)
    do = Command(log, "t", run="r1")
    now = lambda rows: {r.claim_id: r for r in State(apply(spark, log, rows)).claims.collect()}
    assert now(do.change_status("clm_c", "confirmed", "why"))["clm_c"].epistemic_status == "confirmed"
    assert do.change_status("clm_c", "probable").count() == 0
    with pytest.raises(ValueError, match="can't become"):
        do.change_status("clm_c", "hypothesized")
    with pytest.raises(ValueError, match="unknown status"):
        do.change_status("clm_c", "sure")
    with pytest.raises(ValueError, match="no claim"):
        do.retract("clm_zz", "x")
    assert now(do.recalibrate("clm_c", 0.4, "human"))["clm_c"].confidence_score == 0.4
    with pytest.raises(ValueError, match="0..1"):
        do.recalibrate("clm_c", 1.4, "human")
    assert now(do.trigger_rebuttal("clm_c", "it moved"))["clm_c"].review_reason == "rebuttal condition met: it moved"
    gone = now(do.supersede("clm_b", "clm_c"))
    assert gone["clm_b"].superseded_by == "clm_c" and gone["clm_d"].epistemic_status == "needs_review" and gone["clm_b"].t_expired is not None
    assert now(do.invalidate("clm_d", "cause", "disputed"))["clm_d"].epistemic_status == "disputed"
    assert now(do.retract("clm_d", "r", "me"))["clm_d"].retracted_by == "me"
    linked = State(apply(spark, log, do.link("clm_c", "clm_a", "misinformation", "n")))
    assert {r.claim_id: r.epistemic_status for r in linked.claims.collect()} == {"clm_a": "disputed", "clm_b": "needs_review", "clm_c": "disputed", "clm_d": "probable"}
    assert [r.trigger for r in guard.misinformation(linked).collect()] == ["suspected_misinformation"]
    thread = linked.threads.first().thread_id
    assert State(apply(spark, linked.log, Command(linked.log, "t").resolve_thread(thread, "closed"))).threads.first().status == "closed"
    assert do.add_source("http://X ", authority=0.5).first().source_id == spark.range(1).select(fn.source_id(F.lit("http://x"))).first()[0]


BATCH = {
    "agent_run": {"run_id": "run_1", "role": "seed"}, "sources": [{"alias": "@reg", "uri": "http://reg", "authority": 0.95}],
    "claims": [
        {"alias": "@hq", "assertion": {"s": "Orbis", "p": "headquartered_in", "o": "Berlin"}, "warrant": "w", "rebuttal_conditions": ["x"], "analytic_confidence": "Medium", "t_valid": "2016-01-01T00:00:00Z", "evidence": [{"source": "@reg", "locator": "p1"}, {"source": "@reg", "locator": "p1"}]},
        {"assertion": {"s": "Orbis", "p": "pays_tax_in", "o": "Germany"}, "warrant": "w", "rebuttal_conditions": ["x"], "depends_on": ["@hq"], "evidence": [{"source": "http://other"}]},
    ],
}


def batch(spark, tmp_path, doc):
    path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
    path.write_text(json.dumps(doc))
    return read_batch(spark, str(path))


def test_ingest_of_a_batch_and_again(spark, tmp_path):
    empty = log_of(spark)
    b = batch(spark, tmp_path, BATCH)
    assert ingest.validate(b).collect() == []
    rows = ingest.events(b, State(empty), "t", "run_1")
    kinds = [r.event for r in rows.orderBy("seq").collect()]
    assert kinds == ["agent_run_started", "source_registered", "claim_created", "evidence_added", "claim_created", "evidence_added"]
    append(rows, str(tmp_path / "log"))
    log = read_table(spark, str(tmp_path / "log"), "t")
    state = State(log)
    made = {r.obj: r for r in state.claims.collect()}
    assert made["Berlin"].analytic_confidence == "mod" and made["Germany"].depends_on == [made["Berlin"].claim_id] and made["Berlin"].epistemic_status == "hypothesized" and str(made["Berlin"].t_valid) == "2016-01-01 00:00:00"
    assert [r.event for r in ingest.events(b, state, "t", "run_2", 100).orderBy("seq").collect()] == ["agent_run_started", "source_registered"]


def test_batches_report_every_error(spark, tmp_path):
    bad = {"sources": [{"alias": "@s"}, {"uri": "u", "authority": "much"}], "claims": [{"assertion": {"s": "", "p": "p", "o": "o"}, "epistemic_status": "sure", "confidence_score": 3, "t_valid": "soon", "depends_on": ["@no", "odd", '{"s":"a","p":"b","o":"c"}', "clm_1"], "evidence": [{"source": "@gone"}, {}]}]}
    said = sorted(r.message.split(":")[0] for r in ingest.validate(batch(spark, tmp_path, bad)).collect())
    assert said == sorted(["uri", "authority", "assertion", "warrant", "rebuttal_conditions", "epistemic_status", "confidence_score", "t_valid", "depends_on", "depends_on", "evidence", "evidence"])
    assert [r.message for r in ingest.validate(batch(spark, tmp_path, {"claims": []})).collect()] == ["a non-empty array is required"]


def test_stream_equals_batch(spark, tmp_path):
    events = random_events(random.Random(9), 300, 30)
    log = read_log(spark, write_log(tmp_path / "s.jsonl", events))
    whole = spark.createDataFrame(log.select(*[f.name for f in spark.createDataFrame([], LOG).schema]).collect(), LOG)
    for a in (0, 150):
        append(whole.where(F.col("seq").between(a, a + 149)).coalesce(1), str(tmp_path / "log"))
    q = fold_stream(log_stream(spark, str(tmp_path / "log"), 1), str(tmp_path / "cp"), name="folded")
    q.processAllAvailable()
    q.stop()
    got = {r.claim_id: r.epistemic_status for r in spark.table("folded").collect()}
    assert got == {k: v["status"] for k, v in model(events).items()}


def test_guard_passes_good_lines(spark):
    lines = spark.createDataFrame([(1, "p", json.dumps({"event": "seed_marker", "note": "n", "t_created": T}))], "seq long, place string, value string")
    assert guarded(lines).first().note == "n"
