"""Helpers shared by the operators: the shared work folder, cut lineage, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_tops: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset the session's checkpoint folder, or on one machine a temporary one.

    On a cluster without either it raises: executors would each write to their own disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orogen-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """names that df has no column of, with underscores added where it has; upper and lower case count as the same."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
        taken.add(n.lower())
    return out


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder not used before, below one that Hadoop removes when the application's JVM ends."""
    top = f"{shared_dir(spark)}/orogen-{spark.sparkContext.applicationId}"
    if top not in _tops:
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        files = _files(spark, at)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _tops.add(top)
    return f"{top}/{label}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, at):
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that no later failure recomputes it."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._orogen_path = path
    return out


def drop(df: DataFrame) -> None:
    """Remove the files of a table made by cut() that nothing reads any more."""
    path = getattr(df, "_orogen_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        _files(df.sparkSession, at).delete(at, True)


def in_slices(batches, at: int, size: int = 1 << 20):
    """Arrow batches in slices of about size bytes of text in column at, so that a worker holds few of a batch's texts as Python objects at once; a longer text is a slice of its own.

    After each batch Arrow's unused memory goes back to the system: the workers stay, and would hold it through all later stages.
    """
    for b in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(b.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < b.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, size + (upto[start - 1] if start else 0), side="right")))
            yield b.slice(start, stop - start)
            start = stop
        del b
        pa.default_memory_pool().release_unused()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Component of every node of an edge list (u long, v long): rows (node, component), component = smallest node.

    Alternates large-star and small-star steps until the edge set stays the same; each step keeps at most as many edges
    as it got and holds no neighbourhood in one row, so a hub is only a skewed join key, which AQE splits. Null ends and
    self loops are ignored; repeated edges count once; an empty edge list gives an empty table.
    """
    edges = cut(edges.where("u is not null and v is not null and u <> v").select("u", "v").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        pairs = large.join(low, F.col("u") == F.col("k"))
        small = pairs.select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).union(pairs.select(F.col("u"), F.col("m")))
        after = cut(small.toDF("u", "v").where("u <> v").distinct(), "edges")
        now = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 31)))).first()
        drop(edges)
        edges = after
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())
