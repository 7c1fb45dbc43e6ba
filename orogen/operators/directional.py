"""Operators that look along directions: sky view, openness, sky illumination, local dominance.

Spark deals the cells out to tiles with their halo in one shuffle; a kernel works on a tile's matrix, some cells and one direction at a time, and only
the finished numbers of a cell leave it.
"""

from __future__ import annotations

import math
from dataclasses import replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from orogen.operators.grid import Tiling, with_halo

NONE = -1000.0  # slope of a direction without a sample
CELLS = 1 << 18  # cells that a kernel works on at once
NOISE = (0.0, 10.0, 20.0, 40.0)  # percent of the radius that each noise level skips


def least_radius(radius: int, noise: int) -> int:
    return max(math.floor(radius * NOISE[noise] / 100 + 0.5), 1)


class Tile(NamedTuple):
    """Number of a tile, and the place and size of its core in its buffered matrix."""

    number: int
    off_x: int
    off_y: int
    width: int
    height: int


def over_tiles(cells: DataFrame, t: Tiling, kernel, *names: str, finish=None) -> DataFrame:
    """x, y, z and the kernel's columns for the valid core cells of all tiles.

    kernel(matrix, ys, xs, tile): a vector for each name; NaN is missing; ys, xs are places in the matrix. It is called with up to CELLS cells.
    finish: what a tile's whole vectors become. An error in a kernel names its tile.
    """
    area, grid = t.area, t.grid

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        col, row = int(pdf["tile_col"].iloc[0]), int(pdf["tile_row"].iloc[0])
        x, y = area.x + col * t.size, area.y + row * t.size
        w, h = min(t.size, area.end_x - x), min(t.size, area.end_y - y)
        bx, by = max(0, x - t.buffer_x), max(0, y - t.buffer_y)
        bw, bh = min(grid.width, x + w + t.buffer_x) - bx, min(grid.height, y + h + t.buffer_y) - by
        px, py = pdf["x"].to_numpy() - bx, pdf["y"].to_numpy() - by
        inside = (px >= 0) & (px < bw) & (py >= 0) & (py < bh)
        m = np.full((bh, bw), np.nan)
        m[py[inside], px[inside]] = pdf["z"].to_numpy(dtype=np.float64)[inside]
        ys, xs = np.nonzero(~np.isnan(m[y - by : y - by + h, x - bx : x - bx + w]))
        ys, xs = ys + y - by, xs + x - bx
        tile = Tile(row * t.columns + col, x - bx, y - by, w, h)
        try:
            parts = [kernel(m, ys[i : i + CELLS], xs[i : i + CELLS], tile) for i in range(0, len(ys), CELLS)]
            values = [np.concatenate([np.asarray(p[i], np.float64) for p in parts]) if parts else np.zeros(0) for i in range(len(parts[0]) if parts else len(names))]
            values = finish(*values) if finish and parts else values
        except Exception as e:
            raise RuntimeError(f"tile {tile.number}: {e}") from e
        return pd.DataFrame({"x": (xs + bx).astype(np.int32), "y": (ys + by).astype(np.int32), "z": m[ys, xs], **dict(zip(names, values))})

    return with_halo(cells.select("x", "y", "z"), t).groupBy("tile_id").applyInPandas(run, "x int, y int, z double, " + ", ".join(f"{n} double" for n in names))


def steepest(m: np.ndarray, ys: np.ndarray, xs: np.ndarray, step: tuple[float, float], radii: list[int], res_x: float, res_y: float) -> np.ndarray:
    """The largest slope from each cell to a sample at one of the radii along a direction, NONE without any."""
    (dx, dy), centre = step, m[ys, xs]
    best = np.full(len(ys), NONE)
    for r in radii:
        sx, sy = np.floor(xs + dx * r + 0.5).astype(int), np.floor(ys + dy * r + 0.5).astype(int)
        inside = (sx >= 0) & (sx < m.shape[1]) & (sy >= 0) & (sy < m.shape[0])
        sample = np.where(inside, m[np.where(inside, sy, 0), np.where(inside, sx, 0)], np.nan)
        best = np.fmax(best, (sample - centre) / math.hypot(dx * r * res_x, dy * r * res_y))
    return best


def gradient(m: np.ndarray, ys: np.ndarray, xs: np.ndarray, res_x: float, res_y: float) -> tuple[np.ndarray, np.ndarray]:
    """Slope and aspect in radians by central differences; a missing or absent neighbour counts as the centre. The matrix needs a halo of one cell."""
    z = m[ys, xs]

    def near(dy: int, dx: int) -> np.ndarray:
        y, x = ys + dy, xs + dx
        inside = (y >= 0) & (y < m.shape[0]) & (x >= 0) & (x < m.shape[1])
        found = m[np.where(inside, y, 0), np.where(inside, x, 0)]
        return np.where(inside & ~np.isnan(found), found, z)

    dx, dy = (near(0, -1) - near(0, 1)) / 2 / res_x, (near(1, 0) - near(-1, 0)) / 2 / res_y
    return np.arctan(np.sqrt(dx * dx + dy * dy)), np.arctan2(dx, np.where(dy == 0, 1e-8, dy))


def with_margin(t: Tiling) -> Tiling:
    """The tiling with a buffer of one cell at least."""
    return replace(t, buffer_x=max(1, t.buffer_x), buffer_y=max(1, t.buffer_y))


def compass(n: int) -> list[tuple[float, float]]:
    """Unit steps of n directions clockwise from north; y grows downwards."""
    return [(math.sin(math.radians(360.0 / n * i)), -math.cos(math.radians(360.0 / n * i))) for i in range(n)]


def sky_factors(directions: int, radius: int, noise: int, res_x: float, res_y: float, main_direction: float = 315.0, anisotropy: int = 1):
    """Kernel: sky view, its directed form, and openness in degrees."""
    power, least = (4, 0.4) if anisotropy == 1 else (8, 0.1)
    weights = [(1 - least) * math.cos((2 * math.pi / directions * i - math.radians(main_direction)) / 2) ** power + least for i in range(directions)]
    radii = list(range(least_radius(radius, noise), radius + 1))

    def kernel(m, ys, xs, tile):
        free, directed, angles = np.zeros(len(ys)), np.zeros(len(ys)), np.zeros(len(ys))
        for step, weight in zip(compass(directions), weights):
            angle = np.arctan(steepest(m, ys, xs, step, radii, res_x, res_y))
            seen = 1 - np.sin(np.maximum(angle, 0.0))
            free += seen
            directed += seen * weight
            angles += angle
        return free / directions, directed / sum(weights), np.degrees(math.pi / 2 - angles / directions)

    return kernel


def sky_view(cells: DataFrame, t: Tiling, directions: int = 16, radius: int = 10, noise: int = 0, main_direction: float = 315.0, anisotropy: int = 1, invert: bool = False) -> DataFrame:
    """x, y, svf, asvf, openness (degrees) of the valid cells. invert looks at the negated heights (negative openness)."""
    kernel = sky_factors(directions, radius, noise, t.grid.res_x, t.grid.res_y, main_direction, anisotropy)
    turned = (lambda m, ys, xs, tile: kernel(-m, ys, xs, tile)) if invert else kernel
    return over_tiles(cells, t, turned, "svf", "asvf", "openness").drop("z")


def sky_illumination(cells: DataFrame, t: Tiling, model: str = "overcast", directions: int = 32, distance: int = 100, shadow: tuple[float, float] | None = None) -> DataFrame:
    """x, y, v: illumination by a uniform or overcast sky; the overcast part is relative to the tile's largest. shadow: azimuth and elevation of a sun whose shadow counts for a fifth."""
    res_x, res_y, step, radii = t.grid.res_x, t.grid.res_y, math.pi / directions, list(range(1, distance + 1))
    sunny = None if shadow is None else math.floor(shadow[0] / (360.0 / directions) + 0.5) % directions

    def kernel(m, ys, xs, tile):
        slope, aspect = gradient(m, ys, xs, res_x, res_y)
        a, b, c, e = np.zeros((4, len(ys)))
        lit = np.zeros(len(ys))
        for i, to in enumerate(compass(directions)):
            s = steepest(m, ys, xs, to, radii, res_x, res_y)
            h = np.arctan(np.where(s > NONE, np.maximum(s, 0.0), s))
            tilt = -2 * math.sin(step) * np.cos(math.radians(360.0 / directions * i) - aspect)
            cos = np.cos(h)
            a += cos**2
            b += np.maximum(tilt * (math.pi / 4 - h / 2 - np.sin(2 * h) / 4), 0.0)
            c += np.maximum(cos**3, 0.0)
            e += np.maximum(tilt * (2.0 / 3.0 - cos + cos**3 / 3), 0.0)
            if i == sunny:
                lit = np.where(np.degrees(h) < shadow[1], 1.0, 0.0)
        uniform = (step * np.cos(slope) * a + np.sin(slope) * np.minimum(b, math.pi)) / math.pi
        return uniform, 2 * step / 3 * np.cos(slope) * c + np.sin(slope) * e, lit

    def finish(uniform, raw, lit):
        top = raw.max()
        v = uniform if model == "uniform" else 0.33 * uniform + 0.67 * (raw if top == 0 else raw / top)
        return [v if shadow is None else v * 0.8 + lit * 0.2]

    return over_tiles(cells, with_margin(t), kernel, "v", finish=finish).select("x", "y", "v")


def local_dominance(cells: DataFrame, t: Tiling, minimum: int = 10, maximum: int = 20, increment: int = 1, angle: int = 15, observer: float = 1.7) -> DataFrame:
    """x, y, v: how much an observer at a cell looks down on its surroundings, relative to a plane."""
    distances = [minimum + i * increment for i in range((maximum - minimum) // increment + 1)]
    turns = [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in range(0, 360, angle)]
    norm = sum(observer / d * (2.0 * d + increment) for d in distances) * len(turns)

    def kernel(m, ys, xs, tile):
        eye, out = m[ys, xs] + observer, np.zeros(len(ys))
        for dx, dy in turns:
            for r in distances:
                sx, sy = np.floor(xs + dx * r + 0.5).astype(int), np.floor(ys + dy * r + 0.5).astype(int)
                inside = (sx >= 0) & (sx < m.shape[1]) & (sy >= 0) & (sy < m.shape[0])
                sample = np.where(inside, m[np.where(inside, sy, 0), np.where(inside, sx, 0)], np.nan)
                out += np.where(eye > sample, (eye - sample) / r * (2.0 * r + increment), 0.0)
        return (out / norm,)

    return over_tiles(cells, t, kernel, "v").select("x", "y", "v")
