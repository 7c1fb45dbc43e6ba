"""Neighbourhood operators: slope and hillshade by windows along rows and columns, box statistics by tiles, and what builds on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def along_x():
    return W.partitionBy("y").orderBy("x")


def along_y():
    return W.partitionBy("x").orderBy("y")


def slope_aspect(cells: DataFrame, res_x: float = 1.0, res_y: float = 1.0, exaggeration: float = 1.0) -> DataFrame:
    """cells with slope and aspect in radians, by central differences; a missing or absent neighbour counts as the centre."""
    z = F.col("z") * exaggeration
    near = lambda f, w: F.coalesce(f("z").over(w) * exaggeration, z)
    d = cells.select("*", near(F.lag, along_x()).alias("_l"), near(F.lead, along_x()).alias("_r")).select("*", near(F.lag, along_y()).alias("_u"), near(F.lead, along_y()).alias("_d"))
    dx, dy = (F.col("_l") - F.col("_r")) / 2 / res_x, (F.col("_d") - F.col("_u")) / 2 / res_y
    known = F.col("z").isNotNull()
    d = d.select(*cells.columns, dx.alias("_dx"), dy.alias("_dy"))
    aspect = F.atan2(F.col("_dx"), F.when(F.col("_dy") == 0, F.lit(1e-8)).otherwise(F.col("_dy")))
    return d.select(*cells.columns, F.when(known, F.atan(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")))).alias("slope"), F.when(known, aspect).alias("aspect"))


def shade(azimuth: float, elevation: float, slope: Column | None = None, aspect: Column | None = None) -> Column:
    """Hillshade of slope and aspect under a sun at azimuth and elevation (degrees)."""
    slope, aspect = F.col("slope") if slope is None else slope, F.col("aspect") if aspect is None else aspect
    zenith, az = math.radians(90 - elevation), math.radians(azimuth)
    lit = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(aspect - F.lit(az))
    return F.when(slope.isNotNull(), F.greatest(F.lit(0.0), lit))


def multi_hillshade(cells: DataFrame, directions: int = 16, elevation: float = 35.0, **raster) -> DataFrame:
    """x, y and a band b0, b1, ... per sun direction; slope and aspect are shared."""
    return slope_aspect(cells, **raster).select("x", "y", *(shade(360.0 / directions * i, elevation).alias(f"b{i}") for i in range(directions)))


class Boxes:
    """Sums over boxes about the core cells of a tile, clipped to what is there. values: a matrix without NaN; core: slices of its rows and columns.

    The running sums along rows are shared by all radii; sums start anew in each tile, so their error does not grow with the raster.
    """

    def __init__(self, values: np.ndarray, core: tuple[slice, slice]):
        self.rows, self.columns = core
        self.shape = values.shape
        self.sums = np.zeros((values.shape[0], values.shape[1] + 1))
        np.cumsum(values, axis=1, out=self.sums[:, 1:])

    def within(self, r: int) -> np.ndarray:
        def ends(part: slice, n: int):
            at = np.arange(part.start, part.stop)
            return np.maximum(at - r, 0), np.minimum(at + r + 1, n)

        left, right = ends(self.columns, self.shape[1])
        low, high = ends(self.rows, self.shape[0])
        wide = np.zeros((self.shape[0] + 1, len(left)))
        np.cumsum(self.sums[:, right] - self.sums[:, left], axis=0, out=wide[1:])
        return wide[high] - wide[low]


def over_boxes(cells: DataFrame, radius: int, kernel, *names: str) -> DataFrame:
    """x, y and the kernel's columns for all cells, also missing ones. One shuffle deals cells to tiles twice as wide as the radius (512 at least), with their halo.

    kernel(heights above the tile's mean, core): a matrix of the core for each name; missing is NaN on both sides. An error in a kernel names its tile by column and row, as these tiles are the operator's own.
    """
    size = max(512, 2 * radius)

    def near(v: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(v) - radius) / size).cast("int"), F.floor((F.col(v) + radius) / size).cast("int")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        own = (x // size == key[0]) & (y // size == key[1])
        if not own.any():
            return pd.DataFrame({"x": x[own], "y": y[own], **{n: np.zeros(0) for n in names}})
        x0, y0 = x.min(), y.min()
        z = np.full((y.max() - y0 + 1, x.max() - x0 + 1), np.nan)
        z[y - y0, x - x0] = pdf["z"].to_numpy(dtype=np.float64)
        if not np.isnan(z).all():
            z -= np.nanmean(z)
        px, py = x[own] - x0, y[own] - y0
        core = slice(py.min(), py.max() + 1), slice(px.min(), px.max() + 1)
        try:
            found = kernel(z, core)
        except Exception as e:
            raise RuntimeError(f"tile {key[0]},{key[1]} of {size} cells: {e}") from e
        at = py - core[0].start, px - core[1].start
        return pd.DataFrame({"x": x[own], "y": y[own], **{n: m[at] for n, m in zip(names, found)}})

    dealt = cells.select("x", "y", "z", near("x").alias("_col")).select("*", near("y").alias("_row"))
    schema = "x int, y int, " + ", ".join(f"{n} double" for n in names)
    out = dealt.groupBy("_col", "_row").applyInPandas(run, schema)
    return out.select("x", "y", *(F.when(~F.isnan(n), F.col(n)).alias(n) for n in names))


def means(z: np.ndarray, core: tuple[slice, slice], radii: list[int]) -> list[np.ndarray]:
    """Means of the valid cells within each radius; NaN where there are none."""
    known = ~np.isnan(z)
    sums, counts = Boxes(np.where(known, z, 0.0), core), Boxes(known.astype(np.float64), core)
    with np.errstate(invalid="ignore", divide="ignore"):
        return [sums.within(r) / counts.within(r) for r in radii]


def slrm(cells: DataFrame, radius: int = 20) -> DataFrame:
    """x, y, v: height above the mean of the surrounding box."""
    return over_boxes(cells, radius, lambda z, core: [z[core] - means(z, core, [radius])[0]], "v")


def msrm_radii(minimum: float, maximum: float, scaling: int, resolution: float) -> tuple[int, int, int]:
    """First and last radius of the series round(n^scaling), and the number of steps between them."""
    low = max(minimum, resolution)
    i = math.floor(((low - resolution) / (2 * resolution)) ** (1 / scaling))
    n = max(math.ceil(((maximum - resolution) / (2 * resolution)) ** (1 / scaling)), i + 1)
    return math.floor(max(i, 0) ** scaling + 0.5), math.floor(max(n, 0) ** scaling + 0.5), n - i


def msrm(cells: DataFrame, minimum: float = 1.0, maximum: float = 20.0, scaling: int = 2, resolution: float = 1.0) -> DataFrame:
    """x, y, v: mean of the differences of box means at successive radii. The sum telescopes, so two boxes suffice; a missing centre is filled where the smaller box has a value."""
    first, last, steps = msrm_radii(minimum, maximum, scaling, resolution)

    def kernel(z, core):
        inner, outer = means(z, core, [first, last])
        return [(inner - outer) / steps]

    return over_boxes(cells, max(first, last), kernel, "v")


def mstp(cells: DataFrame, local=(1, 5, 1), meso=(5, 50, 5), broad=(50, 500, 50), lightness: float = 0.9) -> DataFrame:
    """x, y, red (broad), green (meso), blue (local): 1 - exp(-lightness * |d|) of the largest deviation d from a box's mean in its standard deviations."""
    scales = [range(a, b + 1, s) for a, b, s in (broad, meso, local)]

    def kernel(z, core):
        known, centre = ~np.isnan(z), z[core]
        filled = np.where(known, z, 0.0)
        sums, counts, squares = Boxes(filled, core), Boxes(known.astype(np.float64), core), Boxes(filled * filled, core)
        largest = [np.zeros(centre.shape) for _ in scales]
        for r in sorted(set().union(*scales)):
            n = np.maximum(counts.within(r), 1.0)
            mean = sums.within(r) / n
            deviation = np.abs(centre - mean) / (np.sqrt(np.maximum(squares.within(r) / n - mean * mean, 0.0)) + 1e-6)
            for band, radii in zip(largest, scales):
                if r in radii:
                    np.maximum(band, deviation, out=band)  # NaN stays
        return [np.clip(1 - np.exp(-lightness * band), 0.0, 1.0) for band in largest]

    return over_boxes(cells, max(max(s) for s in scales), kernel, "red", "green", "blue")
