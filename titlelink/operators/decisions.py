"""Import planning: which held downloads are single files or whole packs that can be imported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T


def holds(queue: DataFrame) -> DataFrame:
    """queue: download_id, movie_id, state, messages. Items held because they were matched by id; null or empty ids are no items."""
    return queue.where((F.coalesce("download_id", F.lit("")) != "") & (F.coalesce("movie_id", F.lit(0)) != 0) & T.is_by_id_hold(F.col("state"), F.col("messages")))


def plan_single(files: DataFrame) -> DataFrame:
    """files: download_id, grabbed_id, path, movie_id, rejections. The first rule that fails says why a download is skipped."""
    real = ~T.is_sample(F.col("rejections"))
    each = files.groupBy("download_id", "grabbed_id").agg(
        F.count_if(real).alias("videos"), F.max(F.when(real, F.col("movie_id"))).alias("movie_id"), F.max(F.when(real, F.size("rejections"))).alias("rejected"), F.max(F.when(real, F.col("path"))).alias("path")
    )
    reason = F.when(F.col("videos") != 1, "not-one-video").when(F.col("movie_id").isNull(), "no-movie").when(F.col("movie_id") != F.col("grabbed_id"), "other-movie").when(F.col("rejected") > 0, "rejected")
    return each.select("download_id", F.when(reason.isNull(), "plan").otherwise("skip").alias("action"), reason.alias("reason"), F.when(reason.isNull(), F.col("path")).alias("path"))


def judge_files(files: DataFrame, scored: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """files: file_id, download_id, grabbed_id, movie_id, rejections; scored: file_id, entity_id, confidence, n_strong.
    Verdict and movie of each file that is no sample."""
    w = Window.partitionBy("file_id").orderBy(F.desc("confidence"), "entity_id")
    top = scored.select("file_id", "entity_id", "confidence", "n_strong", F.row_number().over(w).alias("rank"), F.coalesce(F.lead("confidence").over(w), F.lit(0)).alias("next")).where("rank = 1")
    f = files.where(~T.is_sample(F.col("rejections"))).join(top, "file_id", "left")
    weak = F.coalesce(F.col("confidence"), F.lit(0)) < settings.import_threshold
    verdict = (
        F.when(F.size("rejections") > 0, "unmatched")
        .when(F.col("movie_id").isNotNull(), F.when(F.col("movie_id") == F.col("grabbed_id"), "matched").otherwise("unmatched"))
        .when(weak | (F.coalesce("n_strong", F.lit(0)) == 0), "unmatched")
        .when(F.col("confidence") - F.col("next") < settings.import_margin, "ambiguous")
        .otherwise("matched")
    )
    f = f.withColumn("verdict", verdict)
    return f.select("file_id", "download_id", "verdict", F.when(F.col("verdict") == "matched", F.coalesce("movie_id", "entity_id")).alias("target_id"))


#: Files that one task groups, so that its memory doesn't grow with the table.
TASK_ROWS = 250_000


def finish_packs(judged: DataFrame, movies: DataFrame) -> DataFrame:
    """All files matched, every target monitored and without a file, no target twice. movies: movie_id, monitored, has_file; a missing one fails safe.
    Files are dealt out by their download before they are grouped, in parts of a fixed size; those without a target, which would all
    meet in one task, take no part in the join."""
    m = movies.select(F.col("movie_id").alias("target_id"), "monitored", "has_file")
    parts = max(1, -(-judged.count() // TASK_ROWS))
    aimed = judged.where("target_id is not null").repartition(parts, "target_id").join(m, "target_id", "left")
    j = aimed.unionByName(judged.where("target_id is null"), allowMissingColumns=True).repartition(parts, "download_id")
    each = j.groupBy("download_id").agg(
        F.count("*").alias("files"), F.count_if(F.col("verdict") == "matched").alias("matched"), F.count_if(~F.coalesce("monitored", F.lit(False)) & (F.col("verdict") == "matched")).alias("unmonitored"),
        F.count_if(F.coalesce("has_file", F.lit(True)) & (F.col("verdict") == "matched")).alias("with_file"), F.count("target_id").alias("targets"), F.countDistinct("target_id").alias("distinct_targets"),
    )
    reason = F.when((F.col("files") == 0) | (F.col("matched") < F.col("files")), "not-fully-matched").when((F.col("unmonitored") > 0) | (F.col("with_file") > 0), "target-state").when(F.col("targets") != F.col("distinct_targets"), "duplicate-target")
    return each.select("download_id", "files", "matched", F.when(reason.isNull(), "plan").otherwise("skip").alias("action"), reason.alias("reason"))


def sweep_summary(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """Counts of acted, skipped, waited and parked outcomes."""
    return outcomes.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("acted", "skipped", "waited", "parked")))


def gate(first_seen: Column, fired: Column, attempts: Column, now: Column, ready: Column, settings: Settings = DEFAULTS) -> Column:
    """The outcome of one live sweep for a held download: wait for the grace time, park after the last attempt, skip what can't be planned, wait a grace time after a try."""
    cooling = fired.isNotNull() & (now - fired < settings.grace_seconds)
    return F.when(now - first_seen < settings.grace_seconds, "waited").when(attempts >= settings.attempts, "parked").when(~ready, "skipped").when(cooling, "waited").otherwise("acted")


def route(files: DataFrame, has_index: bool = True, settings: Settings = DEFAULTS) -> DataFrame:
    """files: download_id, rejections. Which way a download is planned: alone (one video at most), as a pack, or why not."""
    videos = F.count_if(~T.is_sample(F.col("rejections")))
    way = F.when(F.col("videos") <= 1, "single").when(F.lit(not settings.multipack), "multipack-disabled").when(F.lit(not has_index), "no-index").otherwise("pack")
    return files.groupBy("download_id").agg(videos.alias("videos")).withColumn("route", way)
