"""The corpus pipeline: toxic documents go, then copies, near copies and benchmark leaks; the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from titlelink.llm import decontaminate, exact_dedup, jaccard_join, packing, toxicity
from titlelink.llm._common import materialize, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def _exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def _jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near_copies(docs)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("toxicity", _toxicity), ("exact dedup", _exact_dedup), ("jaccard join", _jaccard_join), ("decontamination", _decontamination), ("packing", _packing)]

#: A trained model decides and a tokenizer cuts, neither of which SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
