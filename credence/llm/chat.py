"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, once after each turn. A rolling hash runs over the turns of every logged
conversation; its values are the hashes of all its prefixes. A conversation whose whole hash is the hash of a proper prefix
of another is a snapshot of that one and goes; of equal conversations the one with the smallest id stays. The maximal ones
are rendered, each turn as ``<|im_start|>role``, a new line, the text, ``<|im_end|>`` and a new line.

Hashes are 128 bits wide. Only hashes are shuffled to find snapshots, distinct ones once; the turns of snapshots are not
rendered at all. A conversation is rendered into one row and must fit into a task; conversations themselves are not
gathered by anything they share. Turns are ordered by (turn, role, text), nulls first, so ties and repeated rows have a
defined order and all stay. A null role is "unknown" and a null text empty. Rows with a null conversation id can't be told
to belong together: each is a conversation of one turn, equal ones being one. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut


def plain(turns: DataFrame) -> DataFrame:
    """(conv_id, alone, turn, role, text): nulls filled; alone tells rows without a conversation apart, which are distinct."""
    role, text = F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = turns.select("conv_id", "turn", role, text)
    alone = F.sha2(F.to_json(F.struct("turn", "role", "text")), 256)
    known = rows.where("conv_id IS NOT NULL").select("conv_id", F.lit(None).cast("string").alias("alone"), "turn", "role", "text")
    return known.union(rows.where("conv_id IS NULL").select("conv_id", alone.alias("alone"), "turn", "role", "text").distinct())


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, alone, turns): the turns of each conversation in order."""
    return rows.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def rolled(turns: list[dict]) -> list[bytes]:
    """Hash of the first n turns, for each n from 1."""
    out, state = [], b""
    for t in turns:
        role, text = t["role"].encode(), t["text"].encode()
        state = hashlib.blake2b(b"%b%d %d %b%b" % (state, len(role), len(text), role, text), digest_size=16).digest()
        out.append(state)
    return out


def hashed(turns: DataFrame) -> DataFrame:
    """(conv_id, alone, whole, prefixes) of each conversation: its hash, and those of its proper prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rolled(x) for x in batch.column("turns").to_pylist()]
            columns = [batch.column("conv_id"), batch.column("alone"), pa.array([x[-1] for x in found], pa.binary()), pa.array([x[:-1] for x in found], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "alone", "whole", "prefixes"])

    return ordered(plain(turns)).mapInArrow(run, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, alone string, whole binary, prefixes array<binary>")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, alone) of every conversation that is no prefix of another, one of equal ones."""
    known = cut(hashed(turns), "chat-hashes")
    prefixes = known.select(F.explode("prefixes").alias("whole")).distinct()
    first = F.min_by(F.struct("conv_id", "alone"), F.struct(F.col("conv_id").isNull(), "conv_id", "alone")).alias("c")
    return known.groupBy("whole").agg(first).join(prefixes, "whole", "left_anti").select("c.*")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text) of every maximal conversation."""
    chosen = maximal(turns).withColumnsRenamed({"conv_id": "chosen_id", "alone": "chosen_alone"})
    same = F.col("conv_id").eqNullSafe(F.col("chosen_id")) & F.col("alone").eqNullSafe(F.col("chosen_alone"))
    one = F.transform("turns", lambda t: F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n"), t["text"], F.lit("<|im_end|>\n")))
    return ordered(plain(turns).join(chosen, same, "left_semi")).select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(one, "").alias("text"))
