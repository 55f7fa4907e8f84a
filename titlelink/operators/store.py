"""Tables that are written once, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names. Without it a temporary folder, for a local master alone: on a cluster each executor would write to its own disk."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "here" not in _local:
        _local["here"] = tempfile.mkdtemp(prefix="titlelink-")
        atexit.register(shutil.rmtree, _local["here"], ignore_errors=True)
    return _local["here"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder, which outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/titlelink-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes a table that stored has written and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
