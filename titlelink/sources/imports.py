"""Queue pages, manual-import lists and catalog pages (JSON), and the commands that are sent back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .feed import catalog_day

QUEUE = "downloadId string, movieId long, trackedDownloadState string, title string, statusMessages array<string>"
MESSAGE = "title string, messages array<string>"
FILE = (
    "id long, path string, folderName string, size long, releaseGroup string, indexerFlags long, quality variant, languages array<variant>, "
    "rejections array<string>, movie struct<id:long,monitored:boolean,movieFileId:long>"
)
CATALOG = "id long, title string, releaseDate string, studioTitle string, studio struct<title:string>, performerNames array<string>"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Pages of {records: [...]} or plain lists, a file each: one row for each record, as JSON."""
    pages = spark.read.text(path, wholetext=True)
    whole = F.from_json("value", "array<string>")
    inside = F.from_json("value", "records array<string>")["records"]
    listed = F.ltrim(F.col("value")).startswith("[")
    return pages.select(F.explode(F.when(listed, whole).otherwise(inside)).alias("record"))


def messages(blocks: Column) -> Column:
    """Status messages in order: a block's title, then its messages; a block may be a text itself."""

    def flat(b: Column) -> Column:
        x = F.from_json(b, MESSAGE)
        titled = F.when(F.coalesce(x["title"], F.lit("")) != "", F.array(x["title"])).otherwise(F.array().cast("array<string>"))
        parts = F.concat(titled, F.array_compact(F.coalesce(x["messages"], F.array().cast("array<string>"))))
        return F.when(F.ltrim(b).startswith("{"), parts).otherwise(F.array(b))

    return F.flatten(F.transform(F.array_compact(F.coalesce(blocks, F.array().cast("array<string>"))), flat))


def map_queue(records: DataFrame, column: str = "record") -> DataFrame:
    """Queue records (JSON) as download_id, movie_id, state, messages, title; without a download or a movie there is no item."""
    x = records.select(F.from_json(column, QUEUE).alias("x")).select("x.*")
    x = x.where("downloadId <> '' and movieId <> 0")
    return x.select(F.col("downloadId").alias("download_id"), F.col("movieId").alias("movie_id"), F.coalesce("trackedDownloadState", F.lit("")).alias("state"), messages(F.col("statusMessages")).alias("messages"), F.coalesce("title", F.lit("")).alias("title"))


def reasons(rejections: Column) -> Column:
    """Rejections as texts: the reason of an object, the object itself if it has none."""
    return F.transform(F.coalesce(rejections, F.array().cast("array<string>")), lambda r: F.when(F.ltrim(r).startswith("{"), F.coalesce(F.get_json_object(r, "$.reason"), r)).otherwise(r))


def map_files(records: DataFrame, column: str = "record") -> DataFrame:
    """Manual-import records (JSON), beside the other columns: path, movie_id, quality and languages as they came, rejections, is_sample."""
    x = F.from_json(column, FILE)
    out = records.withColumn("__x", x)
    why = reasons(F.col("__x.rejections"))
    objects = F.filter(F.coalesce(F.col("__x.languages"), F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    return out.withColumns(
        {
            "path": F.coalesce("__x.path", F.lit("")), "folder_name": F.coalesce("__x.folderName", F.lit("")), "movie_id": F.nullif(F.col("__x.movie.id"), F.lit(0)),
            "quality": F.col("__x.quality"), "languages": objects, "release_group": F.col("__x.releaseGroup"), "rejections": why, "is_sample": T.is_sample(why),
            "size": F.coalesce("__x.size", F.lit(0)), "item_id": F.col("__x.id"), "indexer_flags": F.coalesce("__x.indexerFlags", F.lit(0)),
            "monitored": F.col("__x.movie.monitored"), "movie_file_id": F.col("__x.movie.movieFileId"),
        }
    ).drop("__x")


def file_entry(target_id: Column) -> Column:
    """The JSON of one planned file, over what map_files gives and download_id; `id` only where there is one."""
    parts = [F.col("path"), target_id.alias("movieId"), F.col("quality"), F.col("languages"), F.col("release_group").alias("releaseGroup"), F.col("download_id").alias("downloadId"), F.col("indexer_flags").alias("indexerFlags")]
    keep = {"ignoreNullFields": "false"}
    return F.when(F.col("item_id").isNull(), F.to_json(F.struct(*parts), keep)).otherwise(F.to_json(F.struct(*parts, F.col("item_id").alias("id")), keep))


def commands(planned: DataFrame) -> DataFrame:
    """planned: download_id, path, entry (file_entry's JSON). One command for each download, its files by path."""
    files = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "entry"))), lambda x: x["entry"]), ",")
    return planned.groupBy("download_id").agg(F.concat(F.lit('{"name":"ManualImport","importMode":"copy","files":['), files, F.lit("]}")).alias("command"))


def map_catalog_records(records: DataFrame, column: str = "record") -> DataFrame:
    """Catalog records (JSON) in the columns that feed.map_catalog takes."""
    x = records.select(F.from_json(column, CATALOG).alias("x"))
    return x.select(F.col("x.id").alias("id"), F.col("x.title").alias("title"), F.col("x.releaseDate").alias("release_date"), F.col("x.studioTitle").alias("studio_title"), F.col("x.studio.title").alias("studio"), F.col("x.performerNames").alias("performers"))


def catalog_counts(records: DataFrame) -> DataFrame:
    """records as feed.map_catalog takes them: how many there are, how many it drops."""
    site = F.coalesce(F.nullif("studio_title", F.lit("")), F.nullif("studio", F.lit("")))
    usable = (F.coalesce("title", F.lit("")) != "") & catalog_day(F.col("release_date")).isNotNull() & site.isNotNull()
    return records.agg(F.count("*").alias("records"), F.count_if(usable).alias("mapped"), F.count_if(~usable).alias("skipped"))
