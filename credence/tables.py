"""Tables of the shared folder: a plan is cut by writing it there and reading it back.

The folder is ``spark.checkpoint.dir``, which a cluster's driver and executors share; a lost executor then costs only the
tasks that it ran. Where the setting is absent, a temporary folder stands in on a single machine, as in tests; on a
cluster that is an error, for executors would each write to a disk of their own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths that cut() wrote and nobody dropped.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        base = f"file://{tempfile.mkdtemp(prefix='credence-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path of the shared folder, with its scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: the plan starts anew from files, of so many rows at most if given."""
    path = new_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    _written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._credence_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _written:
        _written.remove(path)


def drop(df: DataFrame) -> None:
    """Delete a table that cut() wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._credence_path)


def written() -> list[str]:
    """The tables that cut() wrote so far and that are still there."""
    return list(_written)


def clear(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete these tables, or all that cut() wrote; results that read them end with this."""
    for path in written() if paths is None else paths:
        delete(spark, path)
