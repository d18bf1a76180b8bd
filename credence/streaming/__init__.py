"""The claim fold over a growing log, as a structured stream.

The fold is one grouped aggregation whose parts each keep one event for a claim, so the engine's own state store holds it:
no custom operator, no watermark (order is seq, not time), and a result that equals the batch fold after every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans import State
from ..schema import LOG


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet log as a stream of its new files."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fold_stream(log: DataFrame, checkpoint: str, sink: str = "memory", name: str = "claims", mode: str = "complete") -> StreamingQuery:
    """Keep the claims of a stream up to date in a sink; mode "update" sends changed claims only."""
    return State(log).claims.writeStream.outputMode(mode).format(sink).queryName(name).option("checkpointLocation", checkpoint).start()
