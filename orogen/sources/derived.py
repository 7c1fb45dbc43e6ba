"""Rasters made from the driver's tables; they use every row of their table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.operators.align import empty
from orogen.operators.grid import Grid


def embedding_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """A row per vector, a column per component: z = 100 * component."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = e.agg((F.max("vec_id") + 1).cast("int"), F.max(F.size("embedding"))).first()
    cells = e.select(F.posexplode("embedding").alias("x", "e"), F.col("vec_id").cast("int").alias("y")).select("x", "y", (100 * F.col("e").cast("double")).alias("z"))
    return cells, Grid(size[1], size[0], source="embeddings")


def with_holes(cells: DataFrame) -> DataFrame:
    """The same with about a eleventh of its cells missing."""
    return cells.withColumn("z", F.when((7 * F.col("x") + 13 * F.col("y")) % 11 != 0, F.col("z")))


def unit_range(cells: DataFrame) -> DataFrame:
    """z from 0 to 1."""
    r = cells.agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return cells.crossJoin(F.broadcast(r)).select("x", "y", ((F.col("z") - F.col("low")) / (F.col("high") - F.col("low"))).alias("z"))  # r is one row


def shipping_raster(spark: SparkSession, sf_dir: str, side: int = 64) -> tuple[DataFrame, Grid]:
    """Largest quantity by part and supplier, both folded to a square of the given side."""
    g = Grid(side, side, source="lineitem")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    tops = li.groupBy((F.col("l_partkey") % side).cast("int").alias("x"), (F.col("l_suppkey") % side).cast("int").alias("y")).agg(F.max("l_quantity").alias("z"))
    return empty(spark, g).join(tops, ["x", "y"], "left"), g


def part_raster(spark: SparkSession, sf_dir: str, width: int = 40) -> tuple[DataFrame, Grid]:
    """Retail price of the parts, laid out in rows."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    last = p.agg(F.max("p_partkey")).first()[0]
    cells = p.select((F.col("p_partkey") % width).cast("int").alias("x"), F.floor(F.col("p_partkey") / width).cast("int").alias("y"), F.col("p_retailprice").alias("z"))
    return cells, Grid(width, last // width + 1, source="part")
