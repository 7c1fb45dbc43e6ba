import numpy as np

from orogen.functions.lighting import Lighting
from orogen.operators import raytrace


def walk(m, res, origin, direction, skip):
    """One ray from cell to cell; a border's time depends on the border alone."""
    h, w = m.shape
    place, step = origin[:2] / res + 0.5, np.where(direction[:2] >= 0, 1, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pace = np.abs(np.asarray(res) / direction[:2])
        cell, t, (z, dz) = np.floor(place).astype(int), np.float64(0.0), (origin[2], direction[2])
        low, high = min(0.0, np.nanmin(m, initial=0.0)), max(0.0, np.nanmax(m, initial=0.0))
        while True:
            gone = any((c < 0 and s < 0) or (c >= n and s > 0) for c, s, n in zip(cell, step, (w, h)))
            if gone or (z + dz * t > high and dz >= 0) or (z + dz * t < low and dz <= 0):
                return np.inf, -1
            times = np.abs(cell + (step > 0) - place) * pace
            t1 = times.min()
            if 0 <= cell[0] < w and 0 <= cell[1] < h and not np.isnan(m[cell[1], cell[0]]) and cell[1] * w + cell[0] != skip:
                bottom, top = min(0.0, m[cell[1], cell[0]]), max(0.0, m[cell[1], cell[0]])
                if dz == 0:
                    za, zb = (-np.inf, np.inf) if bottom <= z <= top else (np.inf, -np.inf)
                else:
                    za, zb = sorted(((bottom - z) / dz, (top - z) / dz))
                start, end = max(t, za), min(t1, zb)
                distance = start if start > 1e-9 else end
                if start <= end and distance > raytrace.EPSILON:
                    return distance, cell[1] * w + cell[0]
            if np.isinf(t1):
                return np.inf, -1
            cell[0 if times[0] <= times[1] else 1] += step[0 if times[0] <= times[1] else 1]
            t = t1


def same(m, res, origin, direction, skip):
    got = raytrace.nearest_hits(m, res, origin, direction, skip)
    for i, (o, d, s) in enumerate(zip(origin, direction, skip)):
        assert (got[0][i], got[1][i]) == walk(m, res, o, d, s), (o, d, s)


def test_the_way_over_blocks_equals_the_way_over_cells():
    r = np.random.default_rng(7)
    for shape, res in (((23, 37), (1.0, 1.0)), ((64, 64), (0.5, 2.0)), ((1, 19), (1.0, 1.0)), ((1, 1), (3.0, 3.0)), ((40, 17), (0.1, 0.3))):
        for rough in (0.0, 0.4, 3.0):
            m = np.where(r.random(shape) < 0.05, np.nan, r.normal(0, rough, shape).cumsum(axis=0))
            n = 250
            y, x = r.integers(0, shape[0], n), r.integers(0, shape[1], n)
            d = r.normal(size=(n, 3))
            d[: n // 2, 2] = np.abs(d[: n // 2, 2]) * 0.3
            d[:30, 2] = 0
            d[20:50, 0] = 0
            d[45:70, 1] = 0
            d[60:75] = [1.0, 1.0, 0.05]  # through corners
            z = np.where(np.isnan(m[y, x]), 1.0, m[y, x]) + np.where(r.random(n) < 0.5, 0.0, r.random(n))
            at = np.stack([x * res[0], y * res[1], z], axis=1)
            at[-40:, :2] += r.uniform(-0.49, 0.49, (40, 2)) * res
            at[-5:, 0] -= 3 * res[0]  # from outside
            same(m, res, at, d / np.linalg.norm(d, axis=1, keepdims=True), np.where(r.random(n) < 0.8, y * shape[1] + x, -1))


def test_a_flat_plain_is_passed_in_few_steps(monkeypatch):
    """Rays over low ground look at blocks, not at each of the 512 cells before the far wall."""
    m = np.zeros((4, 512))
    m[:, -1] = 50
    looks = []
    over = np.floor
    monkeypatch.setattr(raytrace.np, "floor", lambda v: looks.append(1) or over(v))
    far, cell = raytrace.nearest_hits(m, (1.0, 1.0), np.array([[1.0, 1.0, 0.5]]), np.array([[1.0, 0.0001, 0.01]]), np.array([-1]))
    assert cell[0] == 512 + 511 and far[0] == 509.5 and len(looks) < 60


def test_rays_of_many_cells_are_those_of_each():
    light = Lighting(rays=64, sun=0.2, azimuth=180.0, elevation=35.0, diameter=5.0)
    pixel, ray = np.array([0, 5, 77]), np.arange(64)
    spread = raytrace.first_rays(9, pixel[:, None], ray[None, :], light).reshape(-1, 3)
    assert (spread == raytrace.first_rays(9, np.repeat(pixel, 64), np.tile(ray, 3), light)).all()
