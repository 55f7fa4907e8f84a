"""Fixed-size records dealt by key in compact blobs: one shuffled row for each (task, bucket) instead of one for each record."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from ._common import small_batches, trim

#: Records that a task holds before it writes its blobs.
FLUSH = 400_000
#: Records of a bucket, about.
BUCKET = 500_000


def scatter(df: DataFrame, records: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], buckets: int, thin: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """records yields structured arrays whose field `key` (uint64) says the bucket; rows of (bucket, payload). thin may
    lessen or change the records that are written together."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in records(batches):
            if len(part):
                held.append(part)
            if sum(map(len, held)) >= FLUSH:
                yield blobs(np.concatenate(held))
                held = []
                trim()
        if held:
            yield blobs(np.concatenate(held))

    def blobs(part: np.ndarray) -> pa.RecordBatch:
        if thin is not None:
            part = thin(part)
        to = (part["key"] % np.uint64(buckets)).astype(np.int64)
        part = part[np.lexsort((part["key"], to))]
        ends = np.cumsum(np.bincount(to, minlength=buckets))
        full = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
        pack = zstandard.ZstdCompressor(level=1).compress
        # field after field: near keys and repeated ids compress well
        payload = [pack(b"".join(np.ascontiguousarray(x[f]).tobytes() for f in part.dtype.names)) for b in full if (x := part[(ends[b - 1] if b else 0) : ends[b]]) is not None]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payload, pa.binary())], ["bucket", "payload"])

    return df.mapInArrow(rows, "bucket int, payload binary")


def unpack(payload: bytes, dtype: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = len(raw) // dtype.itemsize
    out, at = np.empty(n, dtype), 0
    for f in dtype.names:
        size = dtype[f].itemsize * n
        out[f] = np.frombuffer(raw, dtype[f], n, at)
        at += size
    return out


def gather(scattered: DataFrame, dtype: np.dtype, buckets: int, work: Callable[[np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """work gets all records of a bucket at once, and gives its rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for bucket, payload in zip(b.column("bucket").to_pylist(), b.column("payload"), strict=True):
                if bucket != now and held:
                    if (out := work(np.concatenate(held))) is not None:
                        yield out
                    held = []
                    trim()
                now = bucket
                held.append(unpack(payload.as_buffer(), dtype))
        if held and (out := work(np.concatenate(held))) is not None:
            yield out

    return scattered.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(rows, schema)


def buckets_for(spark: SparkSession, records: int) -> int:
    small_batches(spark)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-records // BUCKET))


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps, whose rows are in a written table."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
