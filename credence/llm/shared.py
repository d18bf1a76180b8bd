"""Helpers shared by the operators: lineage cuts in the shared folder, Arrow batches of bounded size, byte files.

Intermediate tables are those of credence.tables: files under ``spark.checkpoint.dir``, the folder that the cluster
shares between driver and executors.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from ..tables import clear, cut, drop, new_path, shared_dir, written  # noqa: F401  for the operators

#: Bytes of text that a task's vector code handles at once; its temporaries are some tens of times this.
CHUNK_BYTES = 1 << 20


def fresh(columns: Iterable[str], base: str) -> str:
    """base, or base with underscores appended until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose column holds at most `limit` bytes, or a single longer value."""
    if not batch.num_rows:
        return
    at = offsets(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(at, at[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def offsets(column: pa.Array) -> np.ndarray:
    """Offsets into values() of a string or binary array; a null's span is empty."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1]
    return raw.astype(np.int64)


def values(column: pa.Array) -> np.ndarray:
    """All bytes that a string or binary array's offsets point into, without a copy."""
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)


def give_back() -> None:
    """Return freed memory to the system at the end of a task: a Python worker outlives it, idle or not."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


@contextlib.contextmanager
def small_batches(spark, rows: int = 1000) -> Iterator[None]:
    """Inside, rows pass to Python by so many: the JVM holds every batch twice outside its heap, and the worker once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def filesystem(uri: str):
    """pyarrow's file system for a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, data: bytes) -> None:
    """Write a whole file; the caller's names are unique, so a repeated task attempt never meets another's file."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(uri: str) -> bytes:
    store, path = filesystem(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()
