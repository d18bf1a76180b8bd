"""What must not grow with the tables: rows that hold a whole document, and what is moved."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from credence import functions as fn
from credence.operators import conflicts, guard, ingest
from credence.schema import BATCH
from credence.starschema import log_of
from credence.plans import State

QUERIES = entry.queries()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ingest_validate", "ingest_source_rules"])
def test_no_row_holds_all_claims_or_sources_of_a_document(spark, sf_dir, name):
    assert "collect_list" not in plan(QUERIES[name](spark, sf_dir))


def test_documents_in_parts_keep_their_aliases_apart(spark):
    whole = spark.createDataFrame([], BATCH)
    source, claim = (whole.schema[x].dataType.elementType.simpleString() for x in ("sources", "claims"))
    said = '{"alias": "%s", "assertion": {"s": "a%d", "p": "p", "o": "o"}, "warrant": "w", "rebuttal_conditions": ["r"], "depends_on": ["%s", null], "evidence": [{"source": "%s"}]}'
    claims = [(1, 5, said % ("@a", 1, "@b", "@s")), (1, 9, said % ("@b", 2, "@b", "@s")), (2, 7, said % ("@c", 3, "@a", "@s")), (2, 8, said % ("@d", 4, "@c", "http://x"))]
    batch = ingest.Batch(
        spark.createDataFrame([(1,), (2,), (3,)], "doc int").withColumn("agent_run", F.lit(None).cast(whole.schema["agent_run"].dataType)),
        spark.createDataFrame([(1, 0, '{"alias": "@s", "uri": "u"}')], "doc int, i int, j string").select("doc", "i", F.from_json("j", source).alias("s")),
        spark.createDataFrame(claims, "doc int, i int, j string").select("doc", "i", F.from_json("j", claim).alias("c")),
    )
    want = [("claims", "a non-empty array is required"), ("claims[7]", "depends_on: unresolved alias @a"), ("claims[7]", "evidence: unresolved alias @s")]
    assert sorted(tuple(r) for r in ingest.validate(batch).collect()) == want
    rows = ingest.events(batch, State(log_of(spark)), "t", "run").orderBy("seq").collect()
    assert [r.event for r in rows if r.event != "evidence_added"] == ["source_registered", *["claim_created"] * 4]
    made = {r.assertion.s: r for r in rows if r.event == "claim_created"}
    assert made["a1"].depends_on[0] == made["a2"].claim_id and [r.assertion.s for r in rows if r.event == "claim_created"] == ["a1", "a2", "a3", "a4"]


def test_vectors_are_compared_over_tiles_and_not_shuffled_for_it(spark, monkeypatch):
    """Against all pairs at once, with small tiles, repeated names, zero and null vectors."""
    rng = np.random.default_rng(3)
    rows = [(f"n{i:03}", [float(x) for x in rng.normal(size=4)]) for i in rng.permutation(60)]
    rows += [("n000", [0.0, 0.0, 0.0, 0.0]), ("zero", [0.0] * 4), ("null", None), (None, [1.0] * 4)]
    monkeypatch.setattr(conflicts, "TILE", 7)
    monkeypatch.setattr(conflicts, "STRIP", 3)
    got = conflicts.close(spark.createDataFrame(rows, "n string, v array<double>"), 0.3)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    least = {}
    for n, v in rows:
        if n is not None and v is not None:
            least[n] = min(v, least.get(n, v))
    unit = {n: np.divide(v, np.linalg.norm(v) or 1) for n, v in least.items()}
    want = {(a, b): float(unit[a] @ unit[b]) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.3}
    found = {(r.a, r.b): r.sim for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want) and len(want) > 100
    assert conflicts.close(spark.createDataFrame([], "n string, v array<float>"), 0.3).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        conflicts.close(spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "n string, v array<double>"), 0.3).collect()


def test_cited_pairs_are_those_of_the_evidence_and_written_in_its_place(spark):
    rng = random.Random(5)
    rows = [(i, "evidence_added", rng.choice([None, "", *map(str, range(60))]), rng.choice([None, *"abc"]), rng.choice([None, *"xyz"])) for i in rng.sample(range(1000), 200)]
    rows += [(2000 + i, "evidence_added", f"own{i}", "d", f"s{i}") for i in range(20)]
    log = log_of(spark, spark.createDataFrame(rows, "seq long, event string, evidence_id string, claim_id string, source_id string"))
    state = State(log)
    pairs = sorted(map(tuple, state.evidence.select("claim_id", "source_id").distinct().collect()), key=str)
    assert sorted(map(tuple, state.cited.collect()), key=str) == pairs
    shared = state.shared()
    assert "evidence" not in vars(shared) and sorted(map(tuple, shared.cited.collect()), key=str) == pairs
    assert "evidence_id" not in plan(guard.authoritative(shared).union(guard.authoritative(shared)))


def test_normalize_takes_no_line_end_for_ascii(spark):
    texts = ["", " A\t\nB\x1c ", "AB", "a\u2028", "\u0085x Y", "Stra\u00dfe", "\u00c9 e\u0301"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", fn.normalize(F.col("x")).alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == ["", "a b", "ab", "a", "x y", "strasse", "\u00e9 \u00e9"]
