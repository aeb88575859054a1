"""Shared numpy routines over Arrow string batches, and the shared scratch folder.

Texts are handled as one byte buffer with row offsets, a few megabytes at a time, so
that splitting and hashing words costs a few numpy passes instead of a Python loop.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 2 << 20
_LIBC = ctypes.CDLL(None) if ctypes.util.find_library("c") and hasattr(ctypes.CDLL(None), "malloc_trim") else None


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; one of its own only where that is unset."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pageframe-")
        spark.sparkContext.setCheckpointDir(root)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/pageframe-{uuid.uuid4().hex}/{name}"


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; others are left alone."""
    for df in tables:
        if (path := _PLACES.pop(df, None)) is not None:
            remove(df.sparkSession, path.rpartition("/")[0])


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Give freed memory back to the system: Python workers live on for tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def pieces(batches: Iterable[pa.RecordBatch], text: int, limit: int = PIECE_BYTES, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most ``limit`` text bytes (or one row) and ``most`` rows each."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = buffer(batch.column(text))
        i = 0
        while i < batch.num_rows:
            j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
            j = min(max(j, i + 1), batch.num_rows, i + most if most else batch.num_rows)
            yield batch.slice(i, j - i)
            i = j
    release()


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n+1 offsets of the rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if not wide and not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col, wide = col.cast(pa.large_string()), True
    _, offs, data = col.buffers()
    dtype = np.int64 if wide else np.int32
    offs = np.frombuffer(offs, dtype=dtype, count=len(col) + 1, offset=col.offset * np.dtype(dtype).itemsize).astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 of each value."""
    with np.errstate(over="ignore"):
        return _mix(x.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


_BYTE = mix(np.arange(256, dtype=np.uint64), 11)


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64), 12) | np.uint64(1)


def spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each maximal run of word bytes inside one row."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    m = is_word[data]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    start = m.copy()
    start[1:] &= ~m[:-1] | first[1:n]
    last = np.zeros(n + 1, bool)
    last[offs[1:]] = True
    end = m.copy()
    end[:-1] &= ~m[1:] | last[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each run [s, e)."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    at = np.zeros(len(s) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    inner = np.arange(at[-1]) - np.repeat(at[:-1], size)
    take = inner + np.repeat(s, size)
    with np.errstate(over="ignore"):
        v = _BYTE[data[take]] * _multipliers(int(size.max()))[inner]
        return _mix(np.add.reduceat(v, at[:-1]) + size.astype(np.uint64))


def ngrams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of n consecutive runs of a row at each start, and whether the n are in one row."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    k = len(h) - n + 1
    q = _multipliers(n + 7)[7:]
    with np.errstate(over="ignore"):
        g = h[:k] * q[0]
        for j in range(1, n):
            g = g + h[j : j + k] * q[j]
        return _mix(g), row[:k] == row[n - 1 :]


def starts_of(row: np.ndarray, rows: int) -> np.ndarray:
    """Index of the first run of each row, n+1 values."""
    return np.searchsorted(row, np.arange(rows + 1))


def merge_cover(starts: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in one of the intervals [start, start + length)."""
    d = np.zeros(n + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(np.asarray(starts) + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)
