"""The command line on a store of its own; vectors; batches of several documents."""

import json

import pytest

from credence import cli
from credence import functions as fn
from credence.operators import conflicts, ingest
from credence.plans import State
from credence.sources import read_batch
from credence.starschema import log_of


def claim(s, p, o, **more):
    return {"assertion": {"s": s, "p": p, "o": o}, "warrant": "w", "rebuttal_conditions": ["x"], "evidence": []} | more


def test_a_session(spark, tmp_path, capsys):
    def run(*args):
        code = cli.main(["--store", str(tmp_path / "store"), *args], spark)
        out = capsys.readouterr()
        return code, out.out.strip().splitlines(), out.err

    assert run("topic")[0] == 1 and run("topics")[1] == [""] or run("topics")[1] == []
    assert run("init", "--topic", "t")[0] == 0 and run("topic")[1] == ["t"]
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    sources = [{"alias": "@a", "uri": "http://a", "authority": 0.9}, {"alias": "@b", "uri": "http://b", "authority": 0.9}]
    evidence = [{"source": "@a", "locator": "1"}, {"source": "@b", "locator": "2"}]
    good.write_text(json.dumps({"sources": sources, "claims": [claim("X", "is_a", "y", confidence_score=0.95, alias="@x", evidence=evidence), claim("X", "is_a", "z", depends_on=["@x"], likelihood_band="likely")]}))
    bad.write_text(json.dumps({"claims": [claim("", "p", "o", analytic_confidence="even")]}))
    code, _, said = run("ingest", str(bad))
    assert code == 1 and "assertion" in said and "did you mean roughly_even?" in said and "high, mod, low" in said
    assert run("ingest", str(good))[0] == 0 and run("topics")[1] == ["t"]
    one = spark.range(1).select(fn.claim_id(*[fn.F.lit(x) for x in ("t", "X", "is_a", "y")])).first()[0]
    assert json.loads(run("claim", "promote", one)[1][0])["to"] == "confirmed"
    assert [json.loads(x)["claim_id"] for x in run("query", "status", "confirmed")[1]] == [one]
    assert len(run("conflict", "detect")[1]) == 1
    assert run("lint")[0] == 1  # the contradiction is not linked
    assert run("claim", "status", one, "--to", "hypothesized")[0] == 1
    flagged = [json.loads(x) for x in run("source", "discredit", "http://a", "--reason", "forged")[1]]
    assert [x["event"] for x in flagged] == ["source_discredited", "status_changed", "status_changed"]
    assert any("needs_review" in x for x in run("report")[1])
    assert "forged" not in " ".join(run("query", "as-of", "2000-01-01")[1])


def test_one_writer_at_a_time(spark, tmp_path):
    store = cli.Store(spark, str(tmp_path))
    with store.lock("t"), pytest.raises(TimeoutError), store.lock("t", wait=0.2):
        pass
    with store.lock("t", wait=0.2):
        pass


def test_documents_keep_apart_and_the_last_alias_counts(spark, tmp_path):
    two = [{"alias": "@s", "uri": "http://old"}, {"alias": "@s", "uri": "http://new"}]
    docs = [
        {"sources": two, "claims": [claim("a", "p", "o", alias="@c"), claim("b", "p", "o", alias="@c"), claim("c", "p", "o", depends_on=["@c"], evidence=[{"source": "@s", "locator": "1"}])]},
        {"claims": [claim("d", "p", "o"), claim("e", "p", "o"), claim("f", "p", "o")]},
    ]
    (tmp_path / "in").mkdir()
    for i, doc in enumerate(docs):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(doc))
    rows = ingest.events(read_batch(spark, str(tmp_path / "in")), State(log_of(spark)), "t", "run").orderBy("seq").collect()
    made = {r.assertion.s: r for r in rows if r.event == "claim_created"}
    assert {s: r.depends_on for s, r in made.items()} == {"a": [], "b": [], "c": [made["b"].claim_id], "d": [], "e": [], "f": []}
    new = spark.range(1).select(fn.source_id(fn.F.lit("http://new"))).first()[0]
    assert [r.source_id for r in rows if r.event == "evidence_added"] == [new] and len({r.event_id for r in rows}) == len(rows)


def test_vectors_instead_of_tokens(spark):
    rows = [(1, "clm_1", "Paris city"), (2, "clm_2", "Lutetia"), (3, "clm_3", "Rome")]
    log = spark.createDataFrame([(i, "claim_created", c, (s, "is_a", f"o{i}", None), "probable") for i, c, s in rows], "seq long, event string, claim_id string, assertion struct<s:string,p:string,o:string,nl:string>, epistemic_status string")
    vectors = spark.createDataFrame([("Paris city", [1.0, 0.1]), ("lutetia", [1.0, 0.0]), ("Rome", [0.0, 1.0]), ("o1", [1.0, 0.0]), ("o2", [1.0, 0.0])], "text string, vector array<double>")
    state = State(log_of(spark, log))
    assert conflicts.fuzzy(state).collect() == []
    got = conflicts.fuzzy(state, vectors=vectors).collect()
    assert [(r.claim_a, r.claim_b, r.pred_sim, r.obj_sim, r.relation) for r in got] == [("clm_1", "clm_2", 1.0, 1.0, "same_object")]
