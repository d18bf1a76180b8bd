"""Candidate batches: validation that reports every error, and the events of a valid batch.

A batch is a table of documents, one in a row, or a Batch of their sources and claims in rows of their own. Aliases are
resolved by joins, so no row but a document that came as one holds more than one claim.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import functions as fn
from ..plans import State
from ..schema import ALIASES, ANALYTIC, BANDS, METHODS, STATUSES
from ..sources import stamp
from ..tables import cut

_ENUMS = {"epistemic_status": STATUSES, "likelihood_band": BANDS, "analytic_confidence": ANALYTIC, "confidence_method": METHODS}


def _blank(x: Column) -> Column:
    return x.isNull() | (x == "")


def _triple(dep: Column) -> Column:
    """A dependency given as a JSON object with s, p and o."""
    return F.from_json(dep, "s STRING, p STRING, o STRING")


class Batch(NamedTuple):
    """Documents in parts: docs(doc, agent_run), sources(doc, i, s) and claims(doc, i, c). i ascends in a document and may have gaps."""

    docs: DataFrame
    sources: DataFrame
    claims: DataFrame


def in_parts(batch: DataFrame | Batch) -> Batch:
    """Documents of one row each are numbered and written once, since their numbers are no property of the rows."""
    if isinstance(batch, Batch):
        return batch
    docs = cut(batch.withColumn("doc", F.monotonically_increasing_id()), "batch")
    return Batch(docs.select("doc", "agent_run"), docs.select("doc", F.posexplode("sources").alias("i", "s")), docs.select("doc", F.posexplode("claims").alias("i", "c")))


def hint(x: Column) -> Column:
    """What a value of a wrong field may have been meant for: a spelling of another vocabulary."""
    found = F.coalesce(*[F.element_at(F.create_map(*[F.lit(y) for kv in known.items() for y in kv]), F.lower(F.trim(x))) for known in ALIASES.values()])
    return F.coalesce(F.concat(F.lit(" (did you mean "), found, F.lit("?)")), F.lit(""))


def claim_errors(c: Column) -> Column:
    """The messages of every rule that a claim breaks by itself, as an array."""
    tests = [
        (F.coalesce(_blank(c["assertion"]["s"]) | _blank(c["assertion"]["p"]) | _blank(c["assertion"]["o"]), F.lit(True)), F.lit("assertion: s, p and o are required")),
        (_blank(c["warrant"]), F.lit("warrant: required")),
        (F.coalesce(F.size(c["rebuttal_conditions"]), F.lit(0)) <= 0, F.lit("rebuttal_conditions: at least one is required")),
    ]
    for field, allowed in _ENUMS.items():
        x, good = c[field], fn.coerce(field, c[field])
        tests.append((x.isNotNull() & ~good.isin(allowed), F.concat(F.lit(f"{field}: unknown value "), x, F.lit(f"; one of {', '.join(allowed)} is required"), hint(x))))
    score = c["confidence_score"].try_cast("double")
    tests.append((c["confidence_score"].isNotNull() & ~F.coalesce(score.between(0, 1), F.lit(False)), F.lit("confidence_score: a number in 0..1 is required")))
    for field in ("t_valid", "t_invalid"):
        tests.append((~_blank(c[field]) & fn.utc(c[field]).isNull(), F.concat(F.lit(f"{field}: not an ISO-8601 time: "), c[field])))
    flat = F.array_compact(F.array(*[F.when(bad, text) for bad, text in tests]))
    none = F.array().cast("array<string>")

    def source_error(e: Column) -> Column:
        return F.when(_blank(e["source"]), F.lit("evidence: a source is required"))

    def parent_error(d: Column) -> Column:
        t = _triple(d)
        broken = F.coalesce(_blank(t["s"]) | _blank(t["p"]) | _blank(t["o"]), F.lit(True))
        return F.when(~d.startswith("@") & ~d.startswith("clm_") & broken, F.concat(F.lit("depends_on: no alias, id or triple: "), d))

    no_evidence = F.array().cast("array<struct<source:string,quote:string,locator:string>>")
    cited = F.transform(F.coalesce(c["evidence"], no_evidence), source_error)
    deps = F.transform(F.coalesce(c["depends_on"], none), parent_error)
    return F.concat(flat, F.array_compact(cited), F.array_compact(deps))


def unresolved(field: str, refs: DataFrame, named: DataFrame) -> DataFrame:
    """(i, message) for each of refs(doc, i, ref) that is an alias without its like in named(doc, ref)."""
    alias = F.col("ref").startswith("@")
    return refs.where(alias).join(named.where(alias), ["doc", "ref"], "left_anti").select("i", F.concat(F.lit(f"{field}: unresolved alias "), "ref").alias("message"))


def validate(batch: DataFrame | Batch) -> DataFrame:
    """(place, message) of every error of batch documents; no row means that they are valid."""
    b = in_parts(batch)
    place = lambda kind, rows: rows.select(F.concat(F.lit(f"{kind}["), F.col("i").cast("string"), F.lit("]")).alias("place"), "message")
    source = b.sources.select("i", F.explode(F.array_compact(F.array(F.when(_blank(F.col("s.uri")), F.lit("uri: required")), F.when(F.col("s.authority").isNotNull() & F.col("s.authority").try_cast("double").isNull(), F.lit("authority: a number is required"))))).alias("message"))
    own = b.claims.select("i", F.explode(claim_errors(F.col("c"))).alias("message"))
    cited = b.claims.select("doc", "i", F.explode("c.evidence").alias("e")).select("doc", "i", F.col("e.source").alias("ref"))
    deps = b.claims.select("doc", "i", F.explode("c.depends_on").alias("ref"))
    errors = own.union(unresolved("evidence", cited, b.sources.select("doc", F.col("s.alias").alias("ref")))).union(unresolved("depends_on", deps, b.claims.select("doc", F.col("c.alias").alias("ref"))))
    empty = b.docs.select("doc").join(b.claims.select("doc").distinct(), "doc", "left_anti").select(F.lit("claims").alias("place"), F.lit("a non-empty array is required").alias("message"))
    return place("sources", source).union(place("claims", errors)).union(empty)


def events(batch: DataFrame | Batch, state: State, topic: str, run_id: str, first_seq: int = 1) -> DataFrame:
    """Log rows of valid batch documents, one document after another: the run, the sources, then each claim that is new
    followed by its new evidence.

    Aliases hold within their document; of equal ones the last counts. All documents see the state before the batch: a
    claim that exists is skipped but its evidence is added; a claim that the batch holds twice is created twice, which the
    fold undoes; evidence that it repeats is added once. Documents without a run of their own are attributed to none.
    """
    b = in_parts(batch)
    own_run = F.when(F.col("agent_run").isNotNull(), F.coalesce("agent_run.run_id", F.lit(run_id)))
    docs = b.docs.withColumn("own_run", own_run)
    run = docs.where("own_run IS NOT NULL").select(
        "doc", F.lit(0).alias("o1"), F.lit(0).alias("o2"), F.lit("agent_run_started").alias("event"),
        F.col("own_run").alias("run_id"), "agent_run.role", "agent_run.model", "agent_run.task",
    )
    listed = b.sources.withColumnRenamed("i", "o2")
    sources = listed.select(
        "doc", F.lit(1).alias("o1"), "o2", F.lit("source_registered").alias("event"), fn.source_id(F.col("s.uri")).alias("source_id"),
        "s.uri", "s.title", "s.origin", F.col("s.authority").try_cast("double").alias("authority"), "s.credibility", "s.retrieved_at",
    )
    ids = b.claims.withColumn("claim_id", claim_key(topic))
    parents = resolved_parents(ids, topic).groupBy("doc", "i").agg(F.sort_array(F.collect_list(F.struct("j", "dep_id"))).alias("deps"))
    none = F.array().cast("array<string>")
    new = ids.join(state.claims.select("claim_id"), "claim_id", "left_anti").join(parents, ["doc", "i"], "left")
    claim = new.select(
        "doc", (F.col("i") + 2).alias("o1"), F.lit(-1).alias("o2"), F.lit("claim_created").alias("event"), "claim_id", "c.assertion", "c.warrant",
        *[F.coalesce(f"c.{x}", none).alias(x) for x in ("backing", "rebuttal_conditions", "grounds")],
        F.coalesce(fn.coerce("epistemic_status", F.col("c.epistemic_status")), F.lit("hypothesized")).alias("epistemic_status"),
        *[fn.coerce(x, F.col(f"c.{x}")).alias(x) for x in ("likelihood_band", "analytic_confidence", "confidence_method")],
        F.col("c.confidence_score").try_cast("double").alias("confidence_score"), "c.method",
        *[fn.utc(F.col(f"c.{x}")).alias(x) for x in ("t_valid", "t_invalid")], F.coalesce("deps.dep_id", none).alias("depends_on"),
    )
    evidence = new_evidence(ids, listed, state)
    rows = run.unionByName(sources, allowMissingColumns=True).unionByName(claim, allowMissingColumns=True).unionByName(evidence, allowMissingColumns=True)
    rows = rows.join(docs.select("doc", F.col("own_run").alias("agent_run")), "doc")
    # sorted by ranges, so these numbers ascend over the partitions; gaps don't matter to seq
    ordered = rows.orderBy("doc", "o1", "o2").withColumn("seq", F.monotonically_increasing_id() + F.lit(first_seq))
    return stamp(ordered.drop("doc", "o1", "o2"), topic)


def claim_key(topic: str) -> Column:
    return fn.claim_id(F.lit(topic), F.col("c.assertion.s"), F.col("c.assertion.p"), F.col("c.assertion.o"))


def resolved_parents(ids: DataFrame, topic: str) -> DataFrame:
    """(doc, i, j, dep_id): the j-th dependency of the i-th claim of a document, given by alias, id or triple."""
    named = ids.where("c.alias IS NOT NULL").groupBy("doc", F.col("c.alias").alias("dep")).agg(F.max_by("claim_id", "i").alias("named_id"))
    deps = ids.select("doc", "i", F.posexplode("c.depends_on").alias("j", "dep")).join(named, ["doc", "dep"], "left")
    triple = _triple(F.col("dep"))
    by_triple = fn.claim_id(F.lit(topic), triple["s"], triple["p"], triple["o"])
    dep_id = F.when(F.col("dep").startswith("@"), F.col("named_id")).when(F.col("dep").startswith("clm_"), F.col("dep")).otherwise(by_triple)
    return deps.select("doc", "i", "j", dep_id.alias("dep_id"))


def new_evidence(ids: DataFrame, listed: DataFrame, state: State) -> DataFrame:
    """Evidence rows that the state lacks; of repeated ones the first. listed(doc, o2, s): the documents' sources."""
    named = listed.where("s.alias IS NOT NULL AND s.alias <> ''").groupBy("doc", F.col("s.alias").alias("ref")).agg(F.max_by("s.uri", "o2").alias("uri"))
    cited = ids.select("doc", "i", "claim_id", F.posexplode("c.evidence").alias("o2", "e")).withColumn("ref", F.col("e.source")).join(named, ["doc", "ref"], "left")
    source = F.when(F.col("ref").startswith("@"), fn.source_id(F.col("uri"))).otherwise(fn.source_ref(F.col("ref")))
    rows = cited.select("doc", (F.col("i") + 2).alias("o1"), "o2", F.lit("evidence_added").alias("event"), "claim_id", source.alias("source_id"), "e.quote", "e.locator")
    rows = rows.withColumn("evidence_id", fn.evidence_id(F.col("claim_id"), F.col("source_id"), F.col("locator")))
    rows = rows.join(state.evidence.select("evidence_id"), "evidence_id", "left_anti")
    order = F.struct("doc", "o1", "o2")
    one = rows.groupBy("evidence_id").agg(F.min_by(F.struct("doc", "o1", "o2", "event", "claim_id", "source_id", "quote", "locator"), order).alias("r"))
    return one.select("evidence_id", "r.*")
