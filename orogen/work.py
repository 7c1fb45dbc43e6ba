"""The work folder that driver and executors share, and tables that are kept in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tops: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset the session's checkpoint folder, or on one machine a temporary one; on a cluster without either it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orogen-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A path not used before, below a folder that Hadoop removes when the application's JVM ends."""
    top = f"{shared_dir(spark)}/orogen-raster-{spark.sparkContext.applicationId}"
    if top not in _tops:
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        files.mkdirs(at)
        files.deleteOnExit(at)
        _tops.add(top)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that it is computed once."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
