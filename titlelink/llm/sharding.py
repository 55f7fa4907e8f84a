"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

A group is all rows of one text. Each goes to the shard where the dot product of its (bytes, tokens,
rows), as shares of a shard's capacity, with the shard's residual capacity is highest. Groups above
1 / HEAVY of a capacity in any measure (a bounded number: at most 3 * shards * HEAVY) are placed one by
one; all others, summed by a hash of their text into BUNDLES bundles, as bundles. So the driver holds a
number of items that doesn't depend on the input. A group above a whole capacity is cut into pieces by
a hash of doc_id: no shard could hold it, and balance is the law that the result keeps.

Null text has size 1 and no tokens and is a group of its own with the empty text. Repeated rows each take a slot. Only
the id and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize

HEAVY = 64
BUNDLES = 8192
#: Rows of a shard that one window numbers.
CHUNK_ROWS = 512


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """items: bytes, tokens, rows of each; the shard of each. Largest first; a shard that an item overfills is taken only if all would be."""
    capacity = np.maximum(items.sum(axis=0) / shards, 1e-9)
    need = items / capacity
    free = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-need.max(axis=1), kind="stable"):
        fits = (free >= need[i]).all(axis=1)
        if fits.any():
            out[i] = np.argmax(np.where(fits, free @ need[i], -np.inf))
        else:
            out[i] = np.argmax(free[:, 0])  # nothing holds it whole: the most room for bytes
        free[out[i]] -= need[i]
    return out


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in each shard), and the piece of a cut group."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("h").agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "groups")
    total = np.array(groups.agg(F.sum("size"), F.sum("tokens"), F.sum("n")).first(), dtype=object)
    if total[2] is None:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("piece"))
    capacity = [max(1.0, int(x) / shards) for x in total]
    share = F.greatest(F.col("size") / capacity[0], F.col("tokens") / capacity[1], F.col("n") / capacity[2])
    groups = groups.withColumn("share", share)
    heavy = groups.where(F.col("share") > 1 / HEAVY).collect()  # at most 3 * shards * HEAVY rows
    light = groups.where(F.col("share") <= 1 / HEAVY).groupBy(F.pmod("h", F.lit(BUNDLES)).cast("int").alias("b")).agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()
    keys, items = [], []
    for x in sorted(heavy, key=lambda r: r["h"]):
        pieces = int(np.ceil(x["share"])) if x["share"] > 1 else 1
        for p in range(pieces):
            keys.append((True, x["h"], pieces, p))
            items.append([x[c] / pieces for c in ("size", "tokens", "n")])
    for x in sorted(light, key=lambda r: r["b"]):
        keys.append((False, x["b"], 1, 0))
        items.append([x["size"], x["tokens"], x["n"]])
    where = place(np.array(items, float), shards)
    placed = spark.createDataFrame([(*k, int(s)) for k, s in zip(keys, where, strict=True)], "alone boolean, key long, pieces int, piece int, shard int")
    cut = F.broadcast(placed.where("alone and piece = 0").select(F.col("key").alias("h"), "pieces"))  # as few as heavy groups
    rows = rows.join(cut, "h", "left").withColumn("alone", F.col("pieces").isNotNull())
    rows = rows.withColumn("piece", F.when(F.col("alone"), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("pieces"))).otherwise(0).cast("int"))
    rows = rows.withColumn("key", F.when(F.col("alone"), F.col("h")).otherwise(F.pmod("h", F.lit(BUNDLES))))
    rows = rows.join(F.broadcast(placed.drop("pieces")), ["alone", "key", "piece"])  # as few as items
    chunks = max(1, int(total[2]) // (shards * CHUNK_ROWS))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h"), F.lit(chunks)).cast("int"))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = counts.select("shard", "chunk", (F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h", "size")) - 1
    return rows.withColumn("k", number).join(before, ["shard", "chunk"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("k")).cast("long").alias("slot"), "piece")


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Whole rows as Parquet, a folder shard_id=... for each shard; all columns stay as they are, whatever their names (but for one called shard_id, which is refused)."""
    if "shard_id" in docs.columns:
        raise ValueError("a column shard_id would clash with the folders' name")
    at = shard(docs, shards, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), F.col("shard").alias("shard_id")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    same = docs[id_col].eqNullSafe(at["__id"]) & (F.crc32(text.cast("binary")) == at["__crc"]) & (F.octet_length(text) + 1 == at["__size"])
    docs.join(at, same).drop("__id", "__crc", "__size").write.partitionBy("shard_id").parquet(path)
