"""Token-id output in ascending doc_id order, as files of Simple-8b images.

Documents are dealt by ranges of (doc_id, text hash), so one id or source that holds many rows doesn't
meet in one task, sorted there, encoded, and written to files in the shared folder. A file holds up to
FILE_IMAGES records, each followed by a line feed. A record is: magic, four little-endian 64-bit counts
(part, place in the part, documents, ids), the documents' ids (64 bits), whether each has one (8 bits),
their lengths (32 bits), and the Simple-8b image (simple8b) of all their ids, about text_bytes of text.

The files are written by Spark's own file writer, so its commit protocol holds on any store it reaches and
lost executors leave no half files. That writer names them part-<part>-...txt; in the order of their names
they hold the documents in ascending order. Reading takes nothing but the files: it decodes each once and
counts the ids of all records before it. A task reads whole files, FILE_IMAGES records each.

Null text counts as empty: it has the end id alone. Repeated rows are written each time; a null doc_id
comes first. Other columns are ignored. An empty table gives files without records.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import simple8b
from ._common import binaries, blocks, materialize, shared_dir
from ._tokens import encoder, tokenizer_path

END_ID = 1
TEXT_BYTES = 4 << 20
#: Records of a file; a record is 1 to 2 MB, unless one document is longer.
FILE_IMAGES = 8
MAGIC = b"S8BF"
SCHEMA = "doc_id long, part long, seq long, here long, n_tokens long, ids_crc32 long"


def record(part: int, seq: int, doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    known = doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
    numbers = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    counts = np.array([part, seq, len(doc_ids), len(ids)], "<i8")
    return b"".join([MAGIC, counts.tobytes(), numbers.tobytes(), known.tobytes(), lengths.astype("<i4").tobytes(), simple8b.encode(ids)])


def records(file: memoryview) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray]]:
    """What `record` was given, for each record of a file."""
    at = 0
    while at < len(file):
        if file[at : at + 4] != MAGIC:
            raise ValueError("not a file of Simple-8b images")
        part, seq, n, n_ids = np.frombuffer(file, "<i8", 4, at + 4).tolist()
        at += 36
        numbers, known, lengths = np.frombuffer(file, "<i8", n, at), np.frombuffer(file, np.uint8, n, at + 8 * n), np.frombuffer(file, "<i4", n, at + 9 * n)
        at += 13 * n
        size = simple8b.image_size(file[at:])
        ids = simple8b.decode(file[at : at + size])
        if len(ids) != n_ids or int(lengths.sum(dtype=np.int64)) != n_ids:
            raise ValueError("a record without all its ids")
        yield part, seq, pa.array(numbers, pa.int64(), mask=known == 0), lengths.astype(np.int64), ids
        at += size + 1


def write_ids(docs: DataFrame, path: str, byte_level: bool = False, end_id: int = END_ID, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, text_bytes: int = TEXT_BYTES) -> str:
    """Encodes and writes; the folder of the files, a new one in the shared folder unless it is given. path: of the tokenizer's file."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        enc = encoder(path, byte_level)
        for b in blocks(batches, "text", text_bytes):
            at, ids = enc.encode(b.column("text"))
            lens = np.diff(at) + 1
            out = np.full(int(lens.sum()), end_id, ids.dtype)
            kept = np.ones(len(out), bool)
            kept[np.cumsum(lens) - 1] = False
            out[kept] = ids
            yield pa.RecordBatch.from_arrays([binaries([record(part, seq, b.column("doc_id"), lens, out)])], ["image"])
            seq += 1

    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/llm-ids-{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # the text writer puts down a string's bytes as they are, and binary becomes a string as it is
    files = rows.mapInArrow(encoded, "image binary").select(F.col("image").cast("string"))
    files.write.option("maxRecordsPerFile", FILE_IMAGES).option("lineSep", "\n").option("compression", "none").text(folder)
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, decoded from the files."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                for part, seq, doc_ids, lens, ids in records(memoryview(content.as_buffer())):
                    ends = np.cumsum(lens)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
                    same = np.ones(len(lens), np.int64)
                    yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(x, pa.int64()) for x in (same * part, same * seq, ends - lens, lens, crc))], ["doc_id", "part", "seq", "here", "n_tokens", "ids_crc32"])

    shared_dir(spark)
    docs = materialize(spark.read.format("binaryFile").load(folder).select("content").mapInArrow(decoded, SCHEMA), "read")
    images = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    inside = images.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("inside"))
    parts = images.groupBy("part").agg(F.sum("n").alias("n"))  # a row for each partition of the writer
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    first = inside.join(before, "part").select("part", "seq", (F.col("inside") + F.col("before")).alias("first"))
    return docs.join(first, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("here")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    return read_ids(docs.sparkSession, write_ids(docs, path or tokenizer_path("word_bpe_49k.json")))
