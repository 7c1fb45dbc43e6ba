"""Bringing a raster onto another's grid: block maximum, nearest, bilinear."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.operators.grid import Grid, Window

EPSILON = 1e-9


def same_grid(a: Grid, b: Grid) -> bool:
    near = lambda x, y: abs(x - y) <= EPSILON
    return a.width == b.width and a.height == b.height and all(near(x, y) for x, y in ((a.res_x, b.res_x), (a.res_y, b.res_y), (a.min_x, b.min_x), (a.max_x, b.max_x), (a.min_y, b.min_y), (a.max_y, b.max_y)))


@dataclass(frozen=True)
class Alignment:
    """How the finer grid nests in the coarser one: factors, and where it starts in it."""

    factor_x: int
    factor_y: int
    start_x: int
    start_y: int
    end_x: int
    end_y: int

    @staticmethod
    def between(fine: Grid, coarse: Grid, label: str = "Input raster") -> Alignment:
        def whole(v: float, message: str) -> int:
            n = math.floor(v + 0.5)
            if abs(v - n) > EPSILON:
                raise ValueError(message)
            return n

        if fine.crs != coarse.crs:
            raise ValueError(f"{label} CRS does not match the reference raster.")
        if fine.res_x - coarse.res_x > EPSILON or fine.res_y - coarse.res_y > EPSILON:
            raise ValueError(f"{label} resolution must be finer than or equal to the reference raster.")
        fx, fy = (whole(b / a, f"{label} resolution is not an integer fraction of the reference raster.") for a, b in ((fine.res_x, coarse.res_x), (fine.res_y, coarse.res_y)))
        if fine.width % fx or fine.height % fy:
            raise ValueError(f"{label} dimensions are not aligned to the reference raster grid.")
        x = whole((fine.min_x - coarse.min_x) / coarse.res_x, f"{label} minX is not aligned to the reference raster grid.")
        y = whole((coarse.max_y - fine.max_y) / coarse.res_y, f"{label} maxY is not aligned to the reference raster grid.")
        return Alignment(fx, fy, x, y, x + fine.width // fx, y + fine.height // fy)

    def require_same_extent(self, coarse: Grid, label: str = "Input raster") -> None:
        if (self.start_x, self.start_y, self.end_x, self.end_y) != (0, 0, coarse.width, coarse.height):
            raise ValueError(f"{label} extent does not match the reference raster.")


def empty(spark: SparkSession, g: Grid) -> DataFrame:
    """All cells (x, y) of a grid."""
    n = F.lit(g.width).cast("long")
    return spark.range(g.width * g.height).select((F.col("id") % n).cast("int").alias("x"), (F.col("id") / n).cast("long").cast("int").alias("y"))


@dataclass(frozen=True)
class Source:
    """A raster to bring onto a grid: its cells (x, y, z), its grid, and how: same, max, nearest or bilinear. label: how errors name it."""

    cells: DataFrame
    grid: Grid
    how: str
    label: str = "Input raster"


TILE = 512  # target cells along a tile's side at most
HELD = 2048  # source cells along the side of what a tile is made of, where one target cell does not need more


def _reach(s: Source, target: Grid, axis: str) -> tuple[Column, Column]:
    """First and last target cell along an axis that a source cell can have a part in, to a source cell more than exactly."""
    own, at = s.grid, F.col(axis)
    if s.how == "same":
        return at.cast("long"), at.cast("long")
    if axis == "x":
        place = lambda n: (F.lit(own.min_x - target.min_x) + n * own.res_x) / target.res_x
    else:
        place = lambda n: (F.lit(target.max_y - own.max_y) + n * own.res_y) / target.res_y
    wide = 0 if s.how == "max" else 1
    return F.floor(place(at - wide) - EPSILON), F.floor(place(at + 1 + wide) + EPSILON)


def _resample(s: Source, target: Grid, xs: np.ndarray, ys: np.ndarray, m: np.ndarray, x0: int, y0: int) -> np.ndarray:
    """Values of target cells xs by ys from a matrix of source cells that begins at x0, y0; NaN is missing, and so is what lies beyond the matrix."""
    own = s.grid

    def at(sx: np.ndarray, sy: np.ndarray) -> np.ndarray:
        inside_x, inside_y = (sx >= x0) & (sx < x0 + m.shape[1]), (sy >= y0) & (sy < y0 + m.shape[0])
        found = m[np.where(inside_y, sy - y0, 0)[:, None], np.where(inside_x, sx - x0, 0)[None, :]]
        return np.where(inside_y[:, None] & inside_x[None, :], found, np.nan)

    if s.how == "same":
        return at(xs, ys)
    if s.how == "max":
        a = Alignment.between(own, target, s.label)
        tx, ty = (np.arange(m.shape[1]) + x0) // a.factor_x + a.start_x - xs[0], (np.arange(m.shape[0]) + y0) // a.factor_y + a.start_y - ys[0]
        fx, fy = (tx >= 0) & (tx < len(xs)), (ty >= 0) & (ty < len(ys))
        out = np.full(len(xs) * len(ys), -np.inf)
        np.maximum.at(out, (ty[fy][:, None] * len(xs) + tx[fx][None, :]).ravel(), np.where(np.isnan(m), -np.inf, m)[fy][:, fx].ravel())
        return np.where(np.isneginf(out), np.nan, out).reshape(len(ys), len(xs))
    u = (target.min_x + (xs + 0.5) * target.res_x - own.min_x) / own.res_x
    v = (own.max_y - (target.max_y - (ys + 0.5) * target.res_y)) / own.res_y
    if s.how == "nearest":
        return at(np.floor(u).astype(np.int64), np.floor(v).astype(np.int64))
    inside = ((v >= 0) & (v <= own.height))[:, None] & ((u >= 0) & (u <= own.width))[None, :]
    u, v = np.clip(u - 0.5, 0, own.width - 1.0), np.clip(v - 0.5, 0, own.height - 1.0)
    left, top = np.floor(u), np.floor(v)
    total = np.zeros((len(ys), len(xs)))
    for j in (0, 1):
        for i in (0, 1):
            w = (v - top if j else 1 - v + top)[:, None] * (u - left if i else 1 - u + left)[None, :]
            total += np.where(w > 0, w * at(left.astype(np.int64) + i, top.astype(np.int64) + j), 0.0)
    return np.where(inside, total, np.nan)


def on_grid(sources: dict[str, Source], target: Grid, window: Window | None = None) -> DataFrame:
    """x, y and a column for every source: all cells of a grid, or of a window of it, null where a source has no value.

    Every source cell is dealt out once to the tiles of the target that it has a part in, all sources together in one exchange; a tile's kernel then resamples each. Tiles are
    small where sources are much finer, so that a task holds some millions of source cells; where even one target cell takes more, its largest is found before.
    """
    area = window or target.whole
    for s in sources.values():
        if s.grid.crs != target.crs:
            raise ValueError(f"{s.label} CRS does not match the reference raster.")
        if s.how == "max":
            Alignment.between(s.grid, target, s.label)
    finest = max(max(target.res_x / s.grid.res_x, target.res_y / s.grid.res_y) for s in sources.values())
    side = max(1, min(TILE, int(HELD / max(1.0, finest))))
    across, down = -(-area.width // side), -(-area.height // side)
    names, kept = list(sources), {}
    spark = next(iter(sources.values())).cells.sparkSession
    parts = [spark.range(across * down).select(F.col("id").alias("tile"), F.lit(-1).alias("layer"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(None).cast("double").alias("z"))]  # every tile has a result
    for i, s in enumerate(sources.values()):
        cells = s.cells
        if s.how == "max" and max(target.res_x / s.grid.res_x, target.res_y / s.grid.res_y) > HELD:
            a = Alignment.between(s.grid, target, s.label)
            at = lambda c, n, start: (F.floor(F.col(c) / n) + start).cast("int").alias(c)
            cells, s = cells.groupBy(at("x", a.factor_x, a.start_x), at("y", a.factor_y, a.start_y)).agg(F.max("z").alias("z")), Source(cells, target, "same", s.label)
        kept[i] = Source(None, s.grid, s.how, s.label)
        spans = []
        for axis, begin, n, count in (("x", area.x, area.width, across), ("y", area.y, area.height, down)):
            low, high = _reach(s, target, axis)
            low, high = F.greatest(low - begin, F.lit(0)), F.least(high - begin, F.lit(n - 1))
            spans.append(F.when(low <= high, F.sequence(F.floor(low / side), F.floor(high / side))))
        dealt = cells.select("x", "y", F.col("z").cast("double").alias("z"), spans[1].alias("rows"), F.explode(spans[0]).alias("col")).select("x", "y", "z", "col", F.explode("rows").alias("row"))
        parts.append(dealt.select((F.col("row") * across + F.col("col")).alias("tile"), F.lit(i).alias("layer"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "z"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        row, col = divmod(int(pdf["tile"].iloc[0]), across)
        xs = np.arange(area.x + col * side, min(area.x + (col + 1) * side, area.end_x))
        ys = np.arange(area.y + row * side, min(area.y + (row + 1) * side, area.end_y))
        out = {"x": np.tile(xs, len(ys)).astype(np.int32), "y": np.repeat(ys, len(xs)).astype(np.int32)}
        layer, px, py, z = (pdf[c].to_numpy() for c in ("layer", "x", "y", "z"))
        for i, name in enumerate(names):
            own = layer == i
            if not own.any():
                out[name] = np.full(len(xs) * len(ys), np.nan)
                continue
            x0, y0 = int(px[own].min()), int(py[own].min())
            m = np.full((int(py[own].max()) - y0 + 1, int(px[own].max()) - x0 + 1), np.nan)
            m[py[own] - y0, px[own] - x0] = z[own]
            try:
                out[name] = _resample(kept[i], target, xs, ys, m, x0, y0).ravel()
            except Exception as e:
                raise RuntimeError(f"tile {row * across + col}: {e}") from e
        return pd.DataFrame(out)

    return reduce(DataFrame.union, parts).groupBy("tile").applyInPandas(run, "x int, y int, " + ", ".join(f"`{n}` double" for n in names))


def block_max(cells: DataFrame, fine: Grid, coarse: Grid, label: str = "Input raster") -> DataFrame:
    """x, y, z of the coarser grid: the largest valid cell of each block, null where there is none or the rasters do not overlap."""
    return on_grid({"z": Source(cells, fine, "max", label)}, coarse)


def align_grid(cells: DataFrame, fine: Grid, coarse: Grid, label: str = "Input raster") -> DataFrame:
    """block_max of a raster that has the reference's extent."""
    Alignment.between(fine, coarse, label).require_same_extent(coarse, label)
    return block_max(cells, fine, coarse, label)


def nearest(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """x, y, z of target: the source cell that holds the centre."""
    return on_grid({"z": Source(cells, source, "nearest")}, target)


def bilinear(cells: DataFrame, source: Grid, target: Grid) -> DataFrame:
    """x, y, z of target: weighted mean of the four source cells around the centre. A missing one that has weight makes the result missing; beyond the outer centres the border cells hold, beyond the raster nothing."""
    return on_grid({"z": Source(cells, source, "bilinear")}, target)
