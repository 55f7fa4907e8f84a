"""What the operators share: tables in the shared folder, blocks of text, words of a block as Arrow arrays."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import store

#: Bytes of text that a Python worker handles at once; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20

#: Rows that reach a Python worker at once.
BATCH_ROWS = 1000

_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32
#: op1's words: every byte outside 0-9, a-z (after lower-casing) and the bytes of non-ASCII letters becomes a space.
WORD_BYTES = _UPPER.copy()
WORD_BYTES[[b for b in range(128) if not (48 <= _UPPER[b] <= 57 or 97 <= _UPPER[b] <= 122)]] = 32
#: op10's words: whatever stands between ASCII white space, with A-Z lower-cased.
LOWER_BYTES = _UPPER
SAME_BYTES = np.arange(256, dtype=np.uint8)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only under a local master whose session names none, as in tests."""
    small_batches(spark)
    return store.shared_dir(spark)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a few dozen bytes that may be broadcast; beyond that, a shuffled join.
BROADCAST_ROWS = 500_000


def without(rows: DataFrame, away: DataFrame, on: list[tuple[str, str]], how: str = "left_anti") -> DataFrame:
    """The rows that have no partner in away (a written table), columns compared null-safely; its size decides whether it is broadcast."""
    few = away.count() <= BROADCAST_ROWS
    away = away.select(*(F.col(b).alias(f"__away{k}") for k, (_, b) in enumerate(on)))
    same = F.lit(True)
    for k, (a, _) in enumerate(on):
        same = same & rows[a].eqNullSafe(away[f"__away{k}"])
    return rows.join(F.broadcast(away) if few else away, same, how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_distinct(rows: DataFrame, want: int) -> list:
    """`want` distinct rows, those with the least hash. Only rows under a threshold of the hash are told apart, and the
    threshold rises until there are enough; so nothing but a few rows is shuffled, unless nearly all are repeated."""
    n = rows.count()
    share = min(1.0, 4 * want / max(1, n))
    while True:
        h = F.xxhash64(*rows.columns)
        top = F.lit(-(1 << 63) + min(int(share * (1 << 64)), (1 << 64) - 1)).cast("long")
        found = rows.where(h <= top).distinct().orderBy(F.xxhash64(*rows.columns), *rows.columns).limit(want).collect()
        if len(found) >= want or share >= 1:
            return found
        share = min(1.0, 16 * share)


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def words(col: pa.Array, mapped: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words and the words; mapped turns each byte into the one that counts."""
    offsets, data = binary(col)
    parts = pc.ascii_split_whitespace(strings(offsets, mapped[data]))
    flat, at = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        flat = flat.filter(pa.array(full))
        at = np.concatenate([[0], np.cumsum(full)])[at]
    return at, flat


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in slices of at most `most` bytes of the column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(size, size[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j
        del batch
        trim()


def trim() -> None:
    """Gives freed memory back to the system, so that a worker doesn't keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Rows of a text table in an Arrow batch: a worker holds a batch at once, and each may be a long document."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that near values share no bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices starts[i] .. starts[i] + lens[i], one range after another."""
    lens = np.asarray(lens, np.int64)
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lens), lens)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
