"""Claims corpora made from the star-schema tables, so that every operator runs on whole tables.

``parts``: parts are claims about names (a type, for which one value is allowed, and a brand), suppliers are sources, line
items are evidence, names link their first and last type as a conflict. ``events``: users' events revise one claim each.
``hierarchy``: orders depend on customers, these and suppliers on nations, and nations on regions. ``orders``: orders are
claims that hold from their date to the last shipment.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import functions as fn
from .plans import State
from .schema import BANDS, CONFLICT_TYPES, LOG, METHODS, STATUSES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def log_of(spark: SparkSession, *frames: DataFrame) -> DataFrame:
    """One log of frames that hold some of its columns each; the others are null."""
    fields = T.StructType.fromDDL(LOG)

    def whole(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))

    return reduce(DataFrame.union, map(whole, frames)) if frames else spark.createDataFrame([], fields)


def part_claims(part: DataFrame) -> DataFrame:
    """(seq, claim_id, s, p, o, p_size, deps): two claims for each row of part."""
    cid = lambda p, o: fn.claim_id(F.lit("parts"), F.col("p_name"), F.lit(p), F.col(o))
    kind, key = part.withColumn("kind_id", cid("is_a", "p_type")), F.col("p_partkey")
    none = F.array().cast("array<string>")
    is_a = kind.select((2 * key).alias("seq"), F.col("kind_id").alias("claim_id"), F.col("p_name").alias("s"), F.lit("is_a").alias("p"), F.col("p_type").alias("o"), "p_size", none.alias("deps"))
    brand = kind.select((2 * key + 1).alias("seq"), cid("has_brand", "p_brand").alias("claim_id"), F.col("p_name").alias("s"), F.lit("has_brand").alias("p"), F.col("p_brand").alias("o"), "p_size", F.array("kind_id").alias("deps"))
    return is_a.union(brand)


def parts(spark: SparkSession, sf_dir: str) -> State:
    part = table(spark, sf_dir, "part")
    # a few small files hold all parts, and folding their claims is work for all cores
    rows, size = part_claims(part.repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")), F.col("p_size")
    none, day = F.array().cast("array<string>"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    claims = rows.select(
        "seq", F.lit("claim_created").alias("event"), F.lit("parts").alias("topic"), day.alias("t_created"), "claim_id", F.struct("s", "p", "o", F.lit(None).cast("string").alias("nl")).alias("assertion"),
        F.when(size % 10 == 0, none).otherwise(F.array(F.lit("a recall"))).alias("rebuttal_conditions"), F.when(size % 3 == 0, none).otherwise(F.array(F.lit("catalogue"))).alias("grounds"),
        pick(STATUSES, size).alias("epistemic_status"), pick(BANDS, size).alias("likelihood_band"), (size / 50).alias("confidence_score"), pick(METHODS, size).alias("confidence_method"), F.col("deps").alias("depends_on"),
    )
    key, base = F.col("s_suppkey"), 10**12
    supplier = table(spark, sf_dir, "supplier").withColumn("source_id", fn.source_id(F.concat(F.lit("supplier://"), key.cast("string"))))
    registered = supplier.select((3 * key + base).alias("seq"), F.lit("source_registered").alias("event"), day.alias("t_created"), "source_id", F.concat(F.lit("supplier://"), key.cast("string")).alias("uri"), F.col("s_name").alias("title"), ((F.col("s_acctbal") + 1000) / 11000).alias("authority"))
    bad = supplier.where(key % 7 == 0).select((3 * key + base + 1).alias("seq"), F.lit("source_discredited").alias("event"), day.alias("t_created"), "source_id", F.lit("audit").alias("reason"))
    good = supplier.where(key % 14 == 0).select((3 * key + base + 2).alias("seq"), F.lit("source_recredited").alias("event"), day.alias("t_created"), "source_id")
    kind = part.select(F.col("p_partkey").alias("l_partkey"), fn.claim_id(F.lit("parts"), F.col("p_name"), F.lit("is_a"), F.col("p_type")).alias("claim_id"))
    cited = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").join(kind, "l_partkey")
    cited = cited.select((F.col("l_orderkey") * 10 + F.col("l_linenumber") + 2 * base).alias("seq"), "claim_id", fn.source_id(F.concat(F.lit("supplier://"), F.col("l_suppkey").cast("string"))).alias("source_id"), F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("locator"))
    evidence = cited.select("seq", F.lit("evidence_added").alias("event"), day.alias("t_created"), fn.evidence_id(F.col("claim_id"), F.col("source_id"), F.col("locator")).alias("evidence_id"), "claim_id", "source_id", "locator")
    first = rows.where("p = 'is_a'").groupBy("s", "claim_id").agg(F.min("seq").alias("seq")).groupBy("s").agg(F.min_by("claim_id", "seq").alias("x"), F.max_by("claim_id", "seq").alias("y"), F.min("seq").alias("seq")).where("x <> y")
    pair = first.select("s", (4 * F.col("seq") + 3 * base).alias("seq"), F.least("x", "y").alias("claim_a"), F.greatest("x", "y").alias("claim_b"))
    name = F.concat_ws("_", F.substring("claim_a", 5, 8), F.substring("claim_b", 5, 8))
    linked = pair.select("seq", F.lit("conflict_linked").alias("event"), day.alias("t_created"), F.concat(F.lit("edg_cfl_"), name).alias("edge_id"), F.concat(F.lit("thr_"), name).alias("thread_id"), "claim_a", "claim_b", pick(CONFLICT_TYPES, F.length("s")).alias("conflict_type"), F.col("s").alias("note"))
    closed = pair.where(F.col("s").startswith("r")).select((F.col("seq") + 1).alias("seq"), F.lit("resolution_updated").alias("event"), day.alias("t_created"), F.concat(F.lit("thr_"), name).alias("thread_id"), F.lit("resolved").alias("status"), F.concat(F.lit("closed "), "s").alias("note"))
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("seq"), F.lit("agent_run_started").alias("event"), day.alias("t_created"), F.concat(F.lit("run_"), F.col("n_regionkey").cast("string")).alias("run_id"), F.col("n_name").alias("role"))
    return State(log_of(spark, claims, registered, bad, good, evidence, linked, closed, runs))


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log of one claim for each user."""
    kind, n, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
    event = (
        F.when(kind == "signup", "claim_created").when(kind == "click", "rebuttal_triggered").when((kind == "purchase") & (n % 4 == 0), "confidence_recalibrated").when(kind.isin("view", "purchase"), "status_changed")
        .when(n % 3 == 0, "claim_retracted").when(n % 3 == 1, "claim_invalidated").otherwise("claim_superseded")
    )
    claim, score, of = F.concat(F.lit("clm_"), user.cast("string")), F.col("value") / 500, F.col("e")
    rows = table(spark, sf_dir, "events").withColumn("e", event)
    return rows.select(
        n.alias("seq"), of.alias("event"), F.lit("events").alias("topic"), F.col("ts").alias("t_created"), F.lit(None).cast("string").alias("agent_run"),
        F.when(of != "claim_superseded", claim).alias("claim_id"), F.when(of == "claim_superseded", claim).alias("old_claim_id"), F.when(of == "claim_superseded", F.concat(F.lit("clm_"), (user + 1).cast("string"))).alias("new_claim_id"),
        F.struct(claim.alias("s"), F.lit("is_a").alias("p"), F.lit("user").alias("o"), F.lit(None).cast("string").alias("nl")).alias("assertion"), *[F.lit(None).cast("string").alias(c) for c in ("warrant", "likelihood_band", "analytic_confidence", "cause", "invalidated_by", "evidence")],
        *[F.lit(None).cast("array<string>").alias(c) for c in ("backing", "rebuttal_conditions", "grounds", "depends_on")], F.lit("hypothesized").alias("epistemic_status"), score.alias("confidence_score"), F.lit("self_report").alias("confidence_method"),
        *[F.lit(None).cast("timestamp_ntz").alias(c) for c in ("t_valid", "t_invalid")], F.when(of == "confidence_recalibrated", "human").alias("method"), F.lit(None).cast("string").alias("from"),
        F.when(kind == "view", F.when(n % 3 == 0, "needs_review").otherwise("probable")).when(kind == "purchase", "corroborated").alias("to"), F.when(of == "status_changed", kind).alias("reason"), F.col("props").alias("condition"),
        F.when(of == "claim_invalidated", "disputed").alias("new_status"), F.when(of == "claim_retracted", "auditor").alias("retracted_by"), score.alias("new_score"), F.lit(None).cast("double").alias("old_score"),
    )


def hierarchy(spark: SparkSession, sf_dir: str) -> State:
    """Claims that depend on each other along the foreign keys; regions and nations have registries as sources."""
    day, none = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.array().cast("array<string>")
    cid = lambda kind, key: F.concat(F.lit(f"clm_{kind}_"), F.col(key).cast("string"))
    made = lambda df, kind, key, parent: df.select(F.col(key).cast("long").alias("seq"), F.lit("claim_created").alias("event"), day.alias("t_created"), cid(kind, key).alias("claim_id"), pick(STATUSES, F.col(key)).alias("epistemic_status"), (none if parent is None else F.array(parent)).alias("depends_on"))
    region, nation, customer, supplier, orders = (table(spark, sf_dir, x) for x in ("region", "nation", "customer", "supplier", "orders"))
    cite = lambda df, kind, key, name: df.select(F.lit(10**12).alias("seq"), F.lit("evidence_added").alias("event"), day.alias("t_created"), F.concat(F.lit(f"evd_{kind}_"), F.col(key).cast("string")).alias("evidence_id"), cid(kind, key).alias("claim_id"), fn.source_id(F.concat(F.lit("registry://"), F.col(name))).alias("source_id"))
    return State(log_of(
        spark, made(region, "region", "r_regionkey", None), made(nation, "nation", "n_nationkey", cid("region", "n_regionkey")), made(customer, "customer", "c_custkey", cid("nation", "c_nationkey")),
        made(supplier, "supplier", "s_suppkey", cid("nation", "s_nationkey")), made(orders, "order", "o_orderkey", cid("customer", "o_custkey")), cite(region, "region", "r_regionkey", "r_name"), cite(nation, "nation", "n_nationkey", "n_name"),
    ))


def orders(spark: SparkSession, sf_dir: str) -> State:
    """Orders as claims that hold from their date until the last shipment."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("t_invalid"))
    rows = table(spark, sf_dir, "orders").join(last, "o_orderkey", "left")
    status = F.when(F.col("o_orderstatus") == "F", "confirmed").when(F.col("o_orderstatus") == "O", "probable").otherwise("hypothesized")
    made = rows.select(
        F.col("o_orderkey").alias("seq"), F.lit("claim_created").alias("event"), F.col("o_orderdate").cast("timestamp").alias("t_created"), F.concat(F.lit("clm_"), F.col("o_orderkey").cast("string")).alias("claim_id"),
        F.struct(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("s"), F.lit("has_order").alias("p"), F.col("o_orderkey").cast("string").alias("o"), F.lit(None).cast("string").alias("nl")).alias("assertion"),
        status.alias("epistemic_status"), F.col("o_orderdate").cast("timestamp").alias("t_valid"), F.col("t_invalid").cast("timestamp").alias("t_invalid"),
    )
    return State(log_of(spark, made))
