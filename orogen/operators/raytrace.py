"""Sky and sun visibility by rays over columns of the terrain's height."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.functions.lighting import Lighting
from orogen.operators.directional import over_tiles
from orogen.operators.grid import Tiling

EPSILON = 1e-6
SECTORS = 16
RAYS_AT_ONCE = 1 << 16  # rays that a task follows together
# Fixed values of the sampling hash.
GOLDEN, PIXEL, RAY, MIX_1, MIX_2, BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 1423


def _mix(v: np.ndarray) -> np.ndarray:
    v = v + np.uint64(GOLDEN)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(MIX_1)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(MIX_2)
    return v ^ (v >> np.uint64(31))


def uniform(tile: int, pixel: np.ndarray, ray: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on tile, pixel, ray and salt only, so a retried task draws the same rays."""
    one = lambda n, c: _mix((np.asarray(n).astype(np.int64).view(np.uint64) if np.ndim(n) else np.full(1, n, np.uint64)) + np.uint64(c))
    with np.errstate(over="ignore"):
        seed = np.uint64(BASE) ^ one(tile, GOLDEN) ^ one(pixel, PIXEL) ^ one(ray, RAY) ^ _mix(np.full(1, salt, np.uint64))
        u = (_mix(seed) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    return np.where(u == 0, np.finfo(float).eps, u)


def _hemisphere(phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    radial = np.sqrt(np.maximum(0.0, 1 - theta))
    return np.stack([radial * np.cos(2 * math.pi * phi), radial * np.sin(2 * math.pi * phi), np.sqrt(theta)], axis=-1)


def first_rays(tile: int, pixel: np.ndarray, ray: np.ndarray, light: Lighting) -> np.ndarray:
    """Directions of the rays of cells: sectors of azimuth, each with strata of elevation, jittered. pixel and ray are of one shape, or of shapes that NumPy spreads against each other."""
    each = max(1, light.rays // SECTORS)
    theta = (ray % each + uniform(tile, pixel, ray, 0)) / each
    phi = (np.minimum(SECTORS - 1, ray // each) + uniform(tile, pixel, ray, 1)) / SECTORS
    return _hemisphere(phi, theta**light.bias)


def next_rays(tile: int, pixel: np.ndarray, ray: np.ndarray, bounce: int, normal: np.ndarray) -> np.ndarray:
    """Directions after a hit, over the hemisphere around the face's normal."""
    local = _hemisphere(uniform(tile, pixel, ray, 101 + 2 * bounce), uniform(tile, pixel, ray, 100 + 2 * bounce))
    helper = np.where(np.abs(normal[:, 2:]) < 0.999, [[0.0, 0.0, 1.0]], [[1.0, 0.0, 0.0]])
    tangent = np.cross(helper, normal)
    tangent /= np.linalg.norm(tangent, axis=1, keepdims=True)
    other = np.cross(normal, tangent)
    return tangent * local[:, :1] + other * local[:, 1:2] + normal * local[:, 2:]


class Tops(NamedTuple):
    """Largest column tops of blocks of 1, 2, 4, … cells a side, all levels in one vector; a level's block (x, y) is at first[level] + y * across[level] + x."""

    values: np.ndarray
    first: np.ndarray
    across: np.ndarray
    margin: float  # by which the tops are raised, far more than rounding can move a ray


def tops_of(m: np.ndarray) -> Tops:
    """The quadtree of maxima of a matrix of heights; a missing cell has no column, and a column goes up to 0 at least."""
    level = np.where(np.isnan(m), -np.inf, np.maximum(m, 0.0))
    margin = 1e-9 * (1 + np.nanmax(np.abs(m), initial=0.0))
    level, parts, first, across = level + margin, [], [], []
    while True:
        first.append(sum(p.size for p in parts))
        across.append(level.shape[1])
        parts.append(level.ravel())
        if max(level.shape) <= 1:
            return Tops(np.concatenate(parts), np.array(first), np.array(across), margin)
        level = np.pad(level, [(0, n % 2) for n in level.shape], constant_values=-np.inf)
        level = np.maximum(np.maximum(level[::2, ::2], level[1::2, ::2]), np.maximum(level[::2, 1::2], level[1::2, 1::2]))


def _crossed(place: np.ndarray, step: np.ndarray, pace: np.ndarray, slope: np.ndarray, t: np.ndarray, also_at: np.ndarray) -> np.ndarray:
    """The cells along one axis that rays are in at t: all borders crossed before t, and those crossed at t where also_at."""
    cell = np.floor(place + slope * t).astype(np.int64)
    for _ in range(2):  # rounding puts the first guess next to the right cell at most
        entry = np.abs(cell + (step < 0) - place) * pace
        exit_ = np.abs(cell + (step > 0) - place) * pace
        before = (cell + (step < 0) - place) * step > 0  # the border behind the cell is ahead of the start
        back = before & np.where(also_at, entry > t, entry >= t)
        cell = cell + step * (np.where(also_at, exit_ <= t, exit_ < t).astype(np.int64) - back)
    return cell


def nearest_hits(m: np.ndarray, res: tuple[float, float], origin: np.ndarray, direction: np.ndarray, skip: np.ndarray, tops: Tops | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distance to the first column that each ray hits (infinite without one) and its cell (row * width + column, else -1).

    Rays walk over a quadtree of maxima: a block whose highest column a ray stays above is passed in one step, and the next one may be twice as wide; a ray that comes lower looks into
    the block's quarters, in the end at single cells, whose columns span from 0 to their height. Times of crossings depend on the border alone, so the way over blocks
    gives the same numbers as one from cell to cell. skip: the cell each ray starts from, -1 for none. tops: tops_of(m).
    """
    h, w = m.shape
    tops = tops_of(m) if tops is None else tops
    last = len(tops.first) - 1
    low_z, top_z = min(0.0, np.nanmin(m, initial=0.0)), max(0.0, np.nanmax(m, initial=0.0))
    best, hit = np.full(len(origin), np.inf), np.full(len(origin), -1)
    px, py = origin[:, 0] / res[0] + 0.5, origin[:, 1] / res[1] + 0.5
    z, dz = np.ascontiguousarray(origin[:, 2]), np.ascontiguousarray(direction[:, 2])
    gx, gy = direction[:, 0] / res[0], direction[:, 1] / res[1]
    sx, sy = np.where(direction[:, 0] >= 0, 1, -1), np.where(direction[:, 1] >= 0, 1, -1)
    heights = m.ravel()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        ax, ay = np.abs(res[0] / direction[:, 0]), np.abs(res[1] / direction[:, 1])
        cx, cy = np.floor(px).astype(np.int64), np.floor(py).astype(np.int64)
        t, level, ray = np.zeros(len(z)), np.zeros(len(z), np.int64), np.arange(len(z))
        own = np.asarray(skip)
        while len(ray):
            at = z + dz * t
            inside = (cx >= 0) & (cx < w) & (cy >= 0) & (cy < h)
            ahead_x, ahead_y = ((cx >> level) + (sx > 0)) << level, ((cy >> level) + (sy > 0)) << level
            tx, ty = np.abs(ahead_x - px) * ax, np.abs(ahead_y - py) * ay
            by_x = tx <= ty
            t1 = np.where(by_x, tx, ty)
            end = np.where(dz > 0, at > top_z, np.where(dz < 0, at < low_z, (at > top_z) | (at < low_z)))
            if not inside.all():
                end |= ((cx < 0) & (sx < 0)) | ((cx >= w) & (sx > 0)) | ((cy < 0) & (sy < 0)) | ((cy >= h) & (sy > 0))
            block = tops.values[np.where(inside, tops.first[level] + (cy >> level) * tops.across[level] + (cx >> level), 0)]
            over = ~inside | (np.where(dz >= 0, at, z + dz * t1) > block)
            look = np.flatnonzero(~over & ~end & (level == 0))
            if len(look):
                number = cy[look] * w + cx[look]
                height, own_z, own_dz = heights[number], z[look], dz[look]
                bottom, top = np.minimum(0.0, height), np.maximum(0.0, height)
                ta, tb = (bottom - own_z) / own_dz, (top - own_z) / own_dz
                flat, within = own_dz == 0, (own_z >= bottom) & (own_z <= top)
                za = np.where(flat, np.where(within, -np.inf, np.inf), np.minimum(ta, tb))
                zb = np.where(flat, np.where(within, np.inf, -np.inf), np.maximum(ta, tb))
                start, stop = np.maximum(t[look], za), np.minimum(t1[look], zb)
                distance = np.where(start > 1e-9, start, stop)
                met = (start <= stop) & (distance > EPSILON) & (number != own[look])
                found = look[met]
                best[ray[found]], hit[ray[found]] = distance[met], number[met]
                end[found] = True
            go = over | (level == 0)
            end |= go & np.isinf(t1)
            far = np.flatnonzero(go & (level > 0))
            across_x = np.where(by_x, ahead_x - (sx < 0), cx)
            across_y = np.where(by_x, cy, ahead_y - (sy < 0))
            if len(far):
                b = by_x[far]
                x, y = far[~b], far[b]
                across_x[x] = _crossed(px[x], sx[x], ax[x], gx[x], t1[x], np.ones(len(x), bool))
                across_y[y] = _crossed(py[y], sy[y], ay[y], gy[y], t1[y], np.zeros(len(y), bool))
            border = np.where(by_x, ahead_x, ahead_y)
            rise = over & (level < last) & ((border & ((2 << level) - 1)) == 0)
            level = np.where(go, level + rise, level - 1)
            cx, cy, t = np.where(go, across_x, cx), np.where(go, across_y, cy), np.where(go, t1, t)
            if end.any():
                k = np.flatnonzero(~end)
                px, py, z, dz, gx, gy, sx, sy, ax, ay, cx, cy, t, level, ray, own = (v[k] for v in (px, py, z, dz, gx, gy, sx, sy, ax, ay, cx, cy, t, level, ray, own))
    return best, hit


def face_normals(m: np.ndarray, res: tuple[float, float], point: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Outward normal of the column's face nearest to each point."""
    w = m.shape[1]
    x, y = (cell % w) * res[0], (cell // w) * res[1]
    top = m.ravel()[cell]
    gaps = np.stack([point[:, 0] - (x - res[0] / 2), point[:, 0] - (x + res[0] / 2), point[:, 1] - (y - res[1] / 2), point[:, 1] - (y + res[1] / 2), point[:, 2], point[:, 2] - np.maximum(0, top)])
    sides = np.array([[-1, 0, 0], [1, 0, 0], [0, -1, 0], [0, 1, 0], [0, 0, -1], [0, 0, 1]], float)
    return sides[np.abs(gaps).argmin(axis=0)]


def radiance(direction: np.ndarray, light: Lighting) -> np.ndarray:
    """What a free ray brings: the sky's power, and the sun's where the ray meets its disc."""
    if light.sun <= 0:
        return np.full(len(direction), light.sky)
    unit = direction / np.linalg.norm(direction, axis=1, keepdims=True)
    return light.sky + light.sun * (unit @ np.array(light.sun_direction()) >= math.cos(math.radians(light.diameter) / 2))


def occlusion(cells: DataFrame, t: Tiling, light: Lighting, exaggeration: float = 1.0) -> DataFrame:
    """x, y, v of the valid cells: mean light of their rays plus the ambient one. Each tile with its halo is one task's work; the rays depend on the tile."""
    res = t.grid.res_x, t.grid.res_y

    def kernel(m, ys, xs, place):
        m = m * exaggeration
        out, width, tops = np.zeros(len(ys)), m.shape[1], tops_of(m)
        at_once = max(1, RAYS_AT_ONCE // light.rays)
        for i in range(0, len(ys), at_once):
            y, x = ys[i : i + at_once], xs[i : i + at_once]
            pixel, ray = (y - place.off_y) * place.width + (x - place.off_x), np.arange(light.rays)
            d = first_rays(place.number, pixel[:, None], ray[None, :], light).reshape(-1, 3)
            pixel, ray = np.repeat(pixel, light.rays), np.tile(ray, len(y))
            at = np.repeat(np.stack([x * res[0], y * res[1], m[y, x]], axis=1), light.rays, axis=0) + d * EPSILON
            skip = np.repeat(y * width + x, light.rays)
            value, live = np.zeros(len(ray)), np.arange(len(ray))
            for bounce in range(light.bounces + 1):
                far, cell = nearest_hits(m, res, at, d, skip, tops)
                free = cell < 0
                value[live[free]] = radiance(d[free], light)
                if bounce == light.bounces or free.all():
                    break
                live, point, cell = live[~free], at[~free] + d[~free] * far[~free, None], cell[~free]
                d = next_rays(place.number, pixel[live], ray[live], bounce, face_normals(m, res, point, cell))
                at, skip = point + d * EPSILON, np.full(len(live), -1)
            out[i : i + at_once] = value.reshape(len(y), light.rays).mean(axis=1) + light.ambient
        return (out,)

    return over_tiles(cells, t, kernel, "v").select("x", "y", "v")


def fixed_hits(cells: DataFrame, t: Tiling, rays: list[tuple[float, float, float]]) -> DataFrame:
    """x, y, distances: for each of the given directions the distance to the first column, null without one."""
    res = t.grid.res_x, t.grid.res_y

    def kernel(m, ys, xs, place):
        out, tops = [], tops_of(m)
        for dx, dy, dz in rays:
            d = np.tile([dx, dy, dz], (len(ys), 1))
            at = np.stack([xs * res[0], ys * res[1], m[ys, xs]], axis=1) + d * EPSILON
            out.append(nearest_hits(m, res, at, d, ys * m.shape[1] + xs, tops)[0])
        return out

    names = [f"d{i}" for i in range(len(rays))]
    return over_tiles(cells, t, kernel, *names).select("x", "y", F.array(*(F.when(F.col(n) != float("inf"), F.col(n)) for n in names)).alias("distances"))
