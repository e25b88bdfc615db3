"""Small helpers for operators that work on Arrow batches inside Spark tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: Text bytes that one step holds at a time; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def steps(batches: Iterator[pa.RecordBatch], column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of ``column`` each, empty batches left out."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on for the next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The column's values as UTF-8, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary() if batch.column(column).type != pa.large_string() else pa.large_binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced or added."""
    names = list(batch.schema.names) + [n for n in new if n not in batch.schema.names]
    return pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names=names)


def plus(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with columns appended."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as compressed byte planes of their differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_keys(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack_counts(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)
