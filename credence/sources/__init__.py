"""Event logs and candidate batches: readers with guards, and the append-only sink.

A log lives as JSON lines, one file or folder for each topic, or as a Parquet table partitioned by topic. Replay order is
the place in the file; it becomes the column ``seq`` on reading and is what every fold orders by.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import functions as fn
from ..schema import BATCH, EVENTS, LINE, LOG, VERSION

_MERGE = r"^(<{7}|>{7}|={7})"


def guard(lines: DataFrame) -> DataFrame:
    """lines(seq, place, value) -> parsed rows. A merge marker, malformed JSON or an unknown event fails the query and names its place."""
    parsed = F.from_json("value", LINE)
    known = F.get_json_object("value", "$.event")
    say = lambda text: F.raise_error(F.concat(F.col("place"), F.lit(f": {text}")))
    row = (
        F.when(F.col("value").rlike(_MERGE), say("merge conflict marker in the event log"))
        .when(F.try_parse_json("value").isNull() | F.get_json_object("value", "$").isNull(), say("malformed JSON event"))
        .when(~F.coalesce(known.isin(EVENTS), F.lit(False)), say("unknown event type"))
        .otherwise(parsed)
    )
    return lines.select("seq", row.alias("r")).select("seq", "r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as a log. Lines are numbered in the order of files, blocks and lines; blank ones are skipped.

    Within a topic seq ascends with the place; blank lines may leave gaps but never change the order.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    lines = raw.where(F.trim("value") != "").withColumn("value", F.trim("value"))
    # splits are ranked by file and block; within a split, lines keep the order of their numbers
    starts = lines.groupBy("file", "block").agg(F.min("n").alias("first"), (F.max("n") - F.min("n") + 1).alias("lines"))  # a row for each split
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = starts.select("file", "block", "first", before.alias("before"))
    placed = lines.join(ranked, ["file", "block"]).withColumn("seq", F.col("before") + F.col("n") - F.col("first"))
    return typed(guard(placed.select("seq", F.concat_ws(":", "file", F.col("seq").cast("string")).alias("place"), "value")))


def typed(rows: DataFrame) -> DataFrame:
    """Times of parsed lines as timestamps."""
    return rows.withColumns({c: fn.utc(F.col(c)) for c in ("t_created", "t_valid", "t_invalid")})


def read_table(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """One topic of a Parquet log; other topics' files are not read."""
    return spark.read.schema(LOG).parquet(path).where(F.col("topic") == topic)


def stamp(rows: DataFrame, topic: str) -> DataFrame:
    """Rows of new events with their version, topic, time and id: a hash of all their fields but seq, by name."""
    made = rows.withColumns({"v": F.lit(VERSION), "topic": F.lit(topic), "t_created": F.current_timestamp()})
    fields = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(made.columns) if c not in ("seq", "event_id")]))
    return made.withColumn("event_id", F.concat(F.lit("evt_"), fn.hash16(fields)))


def event_rows(spark: SparkSession, events: list[tuple[str, dict]], topic: str, first_seq: int, agent_run: str | None = None) -> DataFrame:
    """Log rows of a few new events, in order from first_seq, stamped now."""
    out = []
    for i, (kind, payload) in enumerate(events):
        if kind not in EVENTS:
            raise ValueError(f"unknown event type {kind!r}")
        out.append((first_seq + i, json.dumps({"event": kind, "agent_run": agent_run, **payload}, ensure_ascii=False)))
    lines = spark.createDataFrame(out, "seq long, value string").withColumn("place", F.col("seq").cast("string"))
    return stamp(typed(guard(lines)), topic)


def append(log_rows: DataFrame, path: str) -> None:
    """Append rows to a Parquet log; columns that they lack are null. One driver writes a topic at a time; the commit of the write job is atomic."""
    have, fields = set(log_rows.columns), T.StructType.fromDDL(LOG)
    rows = log_rows.select(*((F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
    rows.write.mode("append").partitionBy("topic").parquet(path)


def read_batch(spark: SparkSession, path: str) -> DataFrame:
    """A candidate batch document: one row."""
    return spark.read.schema(BATCH).option("multiLine", True).json(path)
