"""Sky and sun visibility from horizon profiles over a pyramid of block maxima."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.functions.lighting import Lighting
from orogen.operators.directional import over_tiles
from orogen.operators.grid import Tiling

SAMPLES = 8  # steps along a direction on each level


def pyramid(m: np.ndarray, radius: int) -> list[np.ndarray]:
    """Level k holds the largest valid of 2^k by 2^k cells, counted from the matrix's corner."""
    levels = [m]
    while (1 << (len(levels) - 1)) * SAMPLES < radius and levels[-1].size > 1:
        top = levels[-1]
        even = np.full((top.shape[0] + top.shape[0] % 2, top.shape[1] + top.shape[1] % 2), np.nan)
        even[: top.shape[0], : top.shape[1]] = top
        levels.append(np.fmax(np.fmax(even[::2, ::2], even[1::2, ::2]), np.fmax(even[::2, 1::2], even[1::2, 1::2])))
    return levels


def steps(n_levels: int, radius: int) -> list[tuple[int, int]]:
    """(level, distance) of the samples along a direction: each level adds the distances that finer ones have not reached."""
    out, reached = [], 0
    for k in range(n_levels):
        out += [(k, s << k) for s in range(1, SAMPLES + 1) if reached < s << k <= radius]
        reached = min(radius, SAMPLES << k)
        if reached >= radius:
            break
    return out


def directions(n: int) -> list[tuple[float, float]]:
    return [(math.sin(2 * math.pi * i / n), -math.cos(2 * math.pi * i / n)) for i in range(n)]


def pyramid_cells(cells: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, z): the pyramid of a whole raster as a table."""
    out = cells.select(F.lit(0).alias("level"), "x", "y", "z")
    last = out
    for k in range(1, levels):
        last = last.groupBy(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).agg(F.max("z").alias("z")).select(F.lit(k).alias("level"), "x", "y", "z")
        out = out.union(last)
    return out


def horizon(levels: list[np.ndarray], ys: np.ndarray, xs: np.ndarray, step: tuple[float, float], reach: int, metres: float) -> np.ndarray:
    """The horizon's angle from each cell along a direction, -pi/2 where nothing is in sight."""
    (dx, dy), eye = step, levels[0][ys, xs]
    best = np.full(len(ys), -np.inf)
    for k, d in steps(len(levels), reach):
        top, scale = levels[k], 1 << k
        sx, sy = np.floor((xs + dx * d) / scale + 0.5).astype(int), np.floor((ys + dy * d) / scale + 0.5).astype(int)
        inside = (sx >= 0) & (sx < top.shape[1]) & (sy >= 0) & (sy < top.shape[0])
        sample = np.where(inside, top[np.where(inside, sy, 0), np.where(inside, sx, 0)], np.nan)
        best = np.fmax(best, (sample - eye) / (d * metres))
    return np.where(np.isinf(best), -math.pi / 2, np.arctan(best))


def visibility(cells: DataFrame, t: Tiling, light: Lighting, n: int = 32, radius_metres: float | None = None, exaggeration: float = 1.0) -> DataFrame:
    """x, y, diffuse, sun, v: share of the sky in sight, share of the sun, and both weighted by their powers plus the ambient light."""
    radius = max(t.grid.pixels(radius_metres)) if radius_metres is not None else None
    scaled = light.azimuth % 360.0 / (360.0 / n)
    low, part = math.floor(scaled) % n, scaled - math.floor(scaled)

    def kernel(m, ys, xs, tile):
        m = m * exaggeration
        reach = max(m.shape) if radius is None else radius
        levels = pyramid(m, reach)
        free, beside = np.zeros(len(ys)), {}
        for i, to in enumerate(directions(n)):
            angle = horizon(levels, ys, xs, to, reach, math.hypot(to[0] * t.grid.res_x, to[1] * t.grid.res_y))
            free += np.clip(1 - np.sin(np.maximum(angle, 0.0)) ** (2.0 / light.bias), 0.0, 1.0)
            if i in (low, (low + 1) % n):
                beside[i] = angle
        edge = np.degrees(beside[low] + (beside[(low + 1) % n] - beside[low]) * part) if part else np.degrees(beside[low])
        below, above = light.elevation - light.diameter / 2, light.elevation + light.diameter / 2
        if light.sun <= 0:
            sun = np.zeros(len(ys))
        elif light.diameter <= 0:
            sun = np.where(edge <= light.elevation, 1.0, 0.0)
        else:
            sun = np.clip((above - edge) / (above - below), 0.0, 1.0)
        return free / n, sun

    out = over_tiles(cells, t, kernel, "diffuse", "sun").drop("z")
    return out.select("*", (F.lit(light.ambient) + light.sky * F.col("diffuse") + light.sun * F.col("sun")).alias("v"))
