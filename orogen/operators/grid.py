"""Rasters as cell tables (x, y, z): extents, windows, tile plans, halos.

A cell table is dense: a missing cell is a row with a null z. y grows downwards from the upper edge.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BBox:
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    def __post_init__(self):
        if not all(map(math.isfinite, (self.min_x, self.min_y, self.max_x, self.max_y))):
            raise ValueError("BBOX values must be finite.")
        if self.min_x >= self.max_x or self.min_y >= self.max_y:
            raise ValueError("BBOX must satisfy min < max.")

    @staticmethod
    def parse(text: str) -> BBox:
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError("BBOX must have four comma-separated values.")
        return BBox(*(float(p.strip()) for p in parts))


@dataclass(frozen=True)
class Window:
    x: int
    y: int
    width: int
    height: int

    @property
    def end_x(self) -> int:
        return self.x + self.width

    @property
    def end_y(self) -> int:
        return self.y + self.height


@dataclass(frozen=True)
class Grid:
    """Size, place and resolution of a raster; nodata is the sentinel of its file."""

    width: int
    height: int
    min_x: float = 0.0
    min_y: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    crs: str = "EPSG:2056"
    nodata: float = math.nan
    source: str = ""

    def __post_init__(self):
        if self.width <= 0 or self.height <= 0 or self.res_x <= 0 or self.res_y <= 0:
            raise ValueError("Raster size and resolution must be positive.")

    @property
    def max_x(self) -> float:
        return self.min_x + self.width * self.res_x

    @property
    def max_y(self) -> float:
        return self.min_y + self.height * self.res_y

    @property
    def whole(self) -> Window:
        return Window(0, 0, self.width, self.height)

    def snap(self, box: BBox) -> Window:
        """The pixels that a box touches within the raster."""
        low_x, high_x = max(box.min_x, self.min_x), min(box.max_x, self.max_x)
        low_y, high_y = max(box.min_y, self.min_y), min(box.max_y, self.max_y)
        if low_x >= high_x or low_y >= high_y:
            raise ValueError("BBOX does not overlap the raster extent.")
        x0 = max(0, math.floor((low_x - self.min_x) / self.res_x))
        x1 = min(self.width, math.ceil((high_x - self.min_x) / self.res_x))
        y0 = max(0, math.floor((self.max_y - high_y) / self.res_y))
        y1 = min(self.height, math.ceil((self.max_y - low_y) / self.res_y))
        return Window(x0, y0, x1 - x0, y1 - y0)

    def envelope(self, w: Window) -> BBox:
        return BBox(self.min_x + w.x * self.res_x, self.max_y - w.end_y * self.res_y, self.min_x + w.end_x * self.res_x, self.max_y - w.y * self.res_y)

    def pixels(self, metres: float) -> tuple[int, int]:
        return math.ceil(metres / self.res_x), math.ceil(metres / self.res_y)

    def describe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.source, self.crs, self.width, self.height, self.min_x, self.min_y, self.max_x, self.max_y, self.res_x, self.res_y, self.nodata)], "source string, crs string, width int, height int, min_x double, min_y double, max_x double, max_y double, res_x double, res_y double, nodata double")


@dataclass(frozen=True)
class Tiling:
    """Tiles of a window, numbered row by row from 0, each with a buffer clipped to the raster."""

    grid: Grid
    size: int
    buffer_x: int = 0
    buffer_y: int = 0
    window: Window | None = None

    def __post_init__(self):
        if self.size <= 0 or self.buffer_x < 0 or self.buffer_y < 0:
            raise ValueError("Tile size must be positive and buffers not negative.")

    @property
    def area(self) -> Window:
        return self.window or self.grid.whole

    @property
    def columns(self) -> int:
        return -(-self.area.width // self.size)

    @property
    def rows(self) -> int:
        return -(-self.area.height // self.size)


def plan(spark: SparkSession, t: Tiling) -> DataFrame:
    """A row per tile: tile_id, tile_col, tile_row, core window (x, y, width, height), buffered window (bx, by, b_width, b_height) and offsets of the core in it."""
    area, grid = t.area, t.grid
    col, row = (F.col("id") % t.columns).cast("int"), (F.col("id") / t.columns).cast("int")
    x, y = F.lit(area.x) + F.col("tile_col") * t.size, F.lit(area.y) + F.col("tile_row") * t.size
    tiles = spark.range(t.columns * t.rows).select(F.col("id").cast("int").alias("tile_id"), col.alias("tile_col"), row.alias("tile_row"))
    tiles = tiles.select("*", x.alias("x"), y.alias("y"))
    tiles = tiles.select("*", F.least(F.lit(t.size), F.lit(area.end_x) - F.col("x")).alias("width"), F.least(F.lit(t.size), F.lit(area.end_y) - F.col("y")).alias("height"))
    tiles = tiles.select("*", F.greatest(F.lit(0), F.col("x") - t.buffer_x).alias("bx"), F.greatest(F.lit(0), F.col("y") - t.buffer_y).alias("by"))
    ends = F.least(F.lit(grid.width), F.col("x") + F.col("width") + t.buffer_x), F.least(F.lit(grid.height), F.col("y") + F.col("height") + t.buffer_y)
    return tiles.select("*", (ends[0] - F.col("bx")).alias("b_width"), (ends[1] - F.col("by")).alias("b_height"), (F.col("x") - F.col("bx")).alias("off_x"), (F.col("y") - F.col("by")).alias("off_y"))


def clip(cells: DataFrame, w: Window) -> DataFrame:
    """The cells of a window; on Parquet the bounds reach the scan."""
    return cells.where(F.col("x").between(w.x, w.end_x - 1) & F.col("y").between(w.y, w.end_y - 1))


def tile_of(t: Tiling) -> Column:
    """The tile that owns a cell."""
    return (((F.col("y") - t.area.y) / t.size).cast("int") * t.columns + ((F.col("x") - t.area.x) / t.size).cast("int")).alias("tile_id")


def with_halo(cells: DataFrame, t: Tiling) -> DataFrame:
    """Each cell once for every tile whose buffered window holds it: tile_id, tile_col, tile_row and the cell's columns. One shuffle by tile_id follows, none before."""

    def span(v: str, at: int, buffer: int, n: int) -> Column:
        low = F.floor((F.col(v) - at - buffer) / t.size)
        high = F.floor((F.col(v) - at + buffer) / t.size)
        return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(n - 1)).cast("int"))

    near = clip(cells, Window(t.area.x - t.buffer_x, t.area.y - t.buffer_y, t.area.width + 2 * t.buffer_x, t.area.height + 2 * t.buffer_y))
    wide = near.select("*", F.explode(span("x", t.area.x, t.buffer_x, t.columns)).alias("tile_col"))
    tall = wide.select("*", F.explode(span("y", t.area.y, t.buffer_y, t.rows)).alias("tile_row"))
    # The last tile of a row or column may be smaller; its buffer ends a buffer's width after the area.
    return tall.select((F.col("tile_row") * t.columns + F.col("tile_col")).alias("tile_id"), "*")


def counts(cells: DataFrame, t: Tiling) -> DataFrame:
    """tile_id, valid: how many cells of each tile's core are not missing."""
    return clip(cells, t.area).groupBy(tile_of(t)).agg(F.count("z").alias("valid"))


def keep_tiles(cells: DataFrame, t: Tiling, start: int = 0) -> DataFrame:
    """The cells of tiles from number start on that have any valid core cell."""
    some = counts(cells, t).where((F.col("valid") > 0) & (F.col("tile_id") >= start)).select("tile_id")
    return clip(cells, t.area).withColumn("tile_id", tile_of(t)).join(some, "tile_id", "left_semi")
