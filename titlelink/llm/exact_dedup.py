"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes: first by length and the first 64 bytes, then every group that
still has several rows by its next 960 bytes, and so on, sixteen times as deep at each round, until a
group is a singleton or its text has ended. Texts are compared by their bytes alone; the SHA-256 is only
reported. A round counts its groups with map-side combine, so a group that holds a third of all rows
is one row from each task, and rows find their group by a join that adaptive execution can split. Only
groups of several rows take their text to the next round.

Null text counts as empty. Of rows with equal text the smallest doc_id stays, a null doc_id only where
there is no other; of repeated rows (same doc_id, same text) exactly one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, without

FIRST_DIGIT = 64
GROWTH = 16


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    base = docs.select(F.col(id_col).alias("doc_id"), normalized(F.col(text_col)).cast("binary").alias("t"))
    base = base.select("doc_id", "t", F.length("t").alias("n"), F.substring("t", 1, FIRST_DIGIT).alias("d"))
    first = base.select("doc_id", "n", "d", F.sha2("t", 256).alias("sha"))
    groups = first.groupBy("n", "d").agg(F.count("*").alias("c"), F.min("doc_id").alias("m"), F.first("sha").alias("sha"))
    groups = materialize(groups.withColumn("g", F.monotonically_increasing_id()), "radix0")

    def single(g: DataFrame) -> DataFrame:
        return g.where("c = 1").select(F.col("m").alias("doc_id"), F.col("m").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))

    parts = [single(groups)]
    if groups.where("c > 1").isEmpty():
        return parts[0]
    active = base.join(groups.where("c > 1").select("n", "d", "g"), ["n", "d"])
    active = materialize(active.select("g", "doc_id", "n", F.expr(f"substring(t, {FIRST_DIGIT + 1})").alias("rest"), F.sha2("t", 256).alias("sha")).withColumn("r", F.monotonically_increasing_id()), "radix-rows0")
    depth, k = FIRST_DIGIT, 0
    while True:
        k += 1
        first_row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r")).alias("least")
        ended = active.where(F.col("n") <= depth).drop("rest")
        heads = ended.groupBy("g").agg(F.count("*").alias("c"), first_row)
        parts.append(
            ended.join(heads, "g").select("doc_id", F.col("least.doc_id").alias("keep_id"), F.col("c").alias("group_size"), (F.col("r") == F.col("least.r")).alias("kept"), F.col("sha").alias("text_sha256"))
        )
        width = depth * (GROWTH - 1)
        rest = active.where(F.col("n") > depth).select("g", "doc_id", "n", "r", "sha", F.substring("rest", 1, width).alias("d"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        if active.where(F.col("n") > depth).isEmpty():
            return _union(parts)
        groups = rest.groupBy("g", "d").agg(F.count("*").alias("c"), F.min("doc_id").alias("m"), F.first("sha").alias("sha"))
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), f"radix{k}")
        parts.append(single(groups))
        active = materialize(rest.join(groups.where("c > 1").select("g", "d", "next"), ["g", "d"]).select(F.col("next").alias("g"), "doc_id", "n", "r", "sha", "rest"), f"radix-rows{k}")
        depth += width


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    sha = "__sha_of_text"
    while sha in docs.columns:
        sha += "_"
    gone = materialize(exact_groups(docs, id_col, text_col).where("not kept").select("doc_id", "text_sha256", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("again")).distinct(), "copies")
    on = [(id_col, "doc_id"), (sha, "text_sha256")]
    rows = docs.withColumn(sha, F.sha2(normalized(F.col(text_col)).cast("binary"), 256))
    rows = without(rows, gone.where("not again"), on)
    twice = gone.where("again")  # repeated rows: same id, same text
    if not twice.isEmpty():
        rows = without(rows, twice, on).unionByName(without(rows, twice, on, "left_semi").dropDuplicates([id_col, sha]))
    return rows.drop(sha)
