"""Texts in and rows out of Arrow batches without Python strings in between."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string of a column, nothing for null."""
    wide = pa.types.is_large_string(column.type)
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if ends else np.zeros(len(column) + 1, np.int32)
    data = memoryview(data) if data else memoryview(b"")
    nulls = column.is_null().to_numpy(zero_copy_only=False)
    return [b"" if gone else bytes(data[a:b]) for a, b, gone in zip(ends[:-1].tolist(), ends[1:].tolist(), nulls.tolist())]


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def batch(schema: str | T.StructType, *columns) -> pa.RecordBatch:
    """A record batch of numpy arrays, lists or Arrow arrays."""
    fields = pa.schema([(n, _TYPES[t]) for n, t in map(str.split, schema.split(", "))]) if isinstance(schema, str) else to_arrow_schema(schema)
    plain = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(plain, fields)], schema=fields)


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """One list for each of ``sizes``, of consecutive values."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def release() -> None:
    """Give freed memory back to the system: a worker lives on, and its next task needs other sizes."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` with freed memory given back after each batch and at a task's end, when the worker lies idle."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return tidied
