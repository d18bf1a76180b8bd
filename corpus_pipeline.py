"""The corpus pipeline: quality rules, near copies, repeated passages, benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder and reads again
as the next stage's docs. All stages but the last return the columns of documents.

A stage's own intermediate tables are deleted when the next one begins, since its result is written by then; tables that
the next one's docs still read are left. A stage whose result is not written before another begins must be run last.

Nulls, empty and very long texts, ties, repeated rows, empty tables and columns of any name are handled as the operator of
each stage says; no stage fails on them, and columns that a stage doesn't name pass through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.llm import bpe, decontaminate, quality_rules, suffix_dedup
from credence.llm import near_copies as near
from credence.llm.shared import clear, cut, written

#: Bytes from which on a repeated passage is cut out: below 50 words of the shortest usual length.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    judged, _, kept = quality_rules.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where(F.col(f"`{kept}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return near.dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start anywhere else too are cut out of the texts; n_chars follows."""
    out = suffix_dedup.clean(docs, PASSAGE_BYTES)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) of each document, and the hash of what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that stages have written for their own results alone.
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, after the tables of earlier ones are deleted."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        there = set(written())
        read = docs.inputFiles() if there & set(_left) else []
        unused = [p for p in _left if p in there and not any(f"/{p.rpartition('/')[2]}/" in f for f in read)]
        clear(spark, unused)
        out = stage(spark, docs, sf_dir)
        _left[:] = [p for p in written() if p in _left or p not in there]
        return out

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", tidy(quality)),
    ("SimHash near-dedup", tidy(near_copies)),
    ("suffix-array dedup", tidy(passages)),
    ("benchmark decontamination", tidy(leaks)),
    ("byte-level BPE", tidy(tokens)),
]
#: Suffix refinement and BPE have no SQL form; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
