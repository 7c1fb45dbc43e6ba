import math

import numpy as np
import pandas as pd
import pytest

from orogen.functions.lighting import Lighting
from orogen.operators import directional, focal, horizon, raytrace
from orogen.operators.grid import BBox, Grid, Tiling, Window, counts, keep_tiles, plan
from orogen.plans import products
from tests.helpers import MOUND, matrix, raster


def test_plan_of_a_clipped_buffered_window(spark):
    g = Grid(10, 10, 100, 190)
    w = g.snap(BBox(100.2, 193.7, 104.1, 198.4))
    assert w == Window(0, 1, 5, 6)
    tiles = plan(spark, Tiling(g, 3, 1, 2, w)).orderBy("tile_id").collect()
    assert len(tiles) == 4
    t = tiles[0]
    assert (t.bx, t.by, t.b_width, t.b_height) == (0, 0, 4, 6)
    t = tiles[3]
    assert (t.x, t.y, t.width, t.height) == (3, 4, 2, 3)
    for bad in ("1,2,3", "3,0,1,1", "nan,0,1,1", "a,b,c,d"):
        with pytest.raises(ValueError):
            BBox.parse(bad)
    with pytest.raises(ValueError):
        g.snap(BBox(0, 0, 1, 1))
    assert g.snap(BBox.parse("100, 190, 110, 200")) == g.whole and g.pixels(2.5) == (3, 3)


def test_tiles_without_valid_core_are_skipped(spark):
    cells, g = raster(spark, [[None, None, 5, 5], [None, None, 5, 5], [4, 4, 6, 6], [4, 4, 6, 6]])
    t = Tiling(g, 2, 1, 1)
    assert {r.tile_id for r in keep_tiles(cells, t).collect()} == {1, 2, 3}
    assert {r.tile_id for r in keep_tiles(cells, t, 2).collect()} == {2, 3}
    assert {r.tile_id: r.valid for r in counts(cells, t).collect()} == {0: 0, 1: 4, 2: 4, 3: 4}


def brute_box(m, r):
    out = np.full(m.shape, np.nan)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            w = m[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]
            if (~np.isnan(w)).any():
                out[y, x] = np.nanmean(w)
    return out


def test_slope_and_boxes(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(9, 13)) * 10
    m[rng.random(m.shape) < 0.2] = np.nan
    cells, g = raster(spark, [[None if np.isnan(v) else v for v in row] for row in m])
    for r in (0, 1, 4, 30):
        want = m - brute_box(m, r) if r else np.where(np.isnan(m), np.nan, 0)
        np.testing.assert_allclose(matrix(focal.slrm(cells, r)), want, atol=1e-9)
    first, last, n = focal.msrm_radii(1, 20, 2, 1)
    want = (brute_box(m, first) - brute_box(m, last)) / n
    np.testing.assert_allclose(matrix(focal.msrm(cells)), want, atol=1e-9)
    slope = matrix(focal.slope_aspect(cells, 2.0, 0.5, 3.0), "slope")
    y, x = next((y, x) for y in range(1, 8) for x in range(1, 12) if not np.isnan(m[y - 1 : y + 2, x - 1 : x + 2]).any())
    dx, dy = (m[y, x - 1] - m[y, x + 1]) * 3 / 2 / 2.0, (m[y + 1, x] - m[y - 1, x]) * 3 / 2 / 0.5
    assert slope[y, x] == pytest.approx(math.atan(math.hypot(dx, dy)))
    assert (np.isnan(slope) == np.isnan(m)).all()


def test_products_do_not_depend_on_tiles(spark):
    cells, g = raster(spark, MOUND)
    for name, p in (("svf", products.SkyView(8, 3)), ("negative-openness", products.SkyView(8, 3)), ("local-dominance", products.LocalDominance(1, 2, 1, 90)), ("vat", products.Vat("general"))):
        one, many = (matrix(products.render(name, cells, products.tiling_for(name, g, size, p), p), shape=(6, 6)) for size in (6, 2))
        np.testing.assert_allclose(one, many)
        assert not np.isnan(one).any()
    assert products.render("multi-hillshade", cells, products.tiling_for("multi-hillshade", g, 6), products.MultiHillshade(4)).columns == ["x", "y", "b0", "b1", "b2", "b3"]
    assert products.render("mstp", cells, products.tiling_for("mstp", g, 6), as_bytes=True).columns == ["x", "y", "red", "green", "blue"]
    assert matrix(products.render("sky-illumination", cells, products.tiling_for("sky-illumination", g, 3), as_bytes=True)).max() == 255
    flat, g = raster(spark, [[5.0] * 5] * 5)
    assert matrix(products.render("svf", flat, products.tiling_for("svf", g, 5))).min() == 1.0
    assert products.tiling_for("slrm", g, 5, products.Slrm(7), buffer=3).buffer_x == 7
    with pytest.raises(ValueError, match="Unsupported product"):
        products.choose("none")
    for bad in (lambda: products.SkyView(noise=4), lambda: products.Hillshade(361), lambda: products.Mstp(local=(5, 1, 1)), lambda: products.Vat("x"), lambda: products.SkyIllumination("blue"), lambda: products.Msrm(5, 1), lambda: products.LocalDominance(angle=0)):
        with pytest.raises(ValueError):
            bad()


def test_horizon(spark):
    cells, g = raster(spark, [[5.0] * 3] * 3)
    out = matrix(horizon.visibility(cells, Tiling(g, 3, 3, 3), Lighting(sky=1, sun=1), 8))
    assert out[1, 1] == pytest.approx(2.0, abs=1e-4)
    z = math.tan(math.radians(30))
    cells, g = raster(spark, [[0, z, 0], [0, 0, 0], [0, 0, 0]])
    out = matrix(horizon.visibility(cells, Tiling(g, 3, 3, 3), Lighting(sky=0, sun=1, azimuth=0, elevation=30, diameter=10), 4))
    assert out[1, 1] == pytest.approx(0.5, abs=0.05)
    rows = [[0.0] * 5 for _ in range(5)]
    rows[0][2] = rows[1][2] = 4.0
    cells, g = raster(spark, rows)
    t = Tiling(g, 5, 5, 5)
    near = matrix(horizon.visibility(cells, t, Lighting(), 32))[2, 2]
    exact = matrix(raytrace.occlusion(cells, t, Lighting(rays=256)))[2, 2]
    assert abs(near - exact) < 0.2
    cells, g = raster(spark, MOUND)
    six, two = (matrix(horizon.visibility(cells, Tiling(g, s, 4, 4), Lighting(), 8, 2.0)) for s in (6, 2))
    np.testing.assert_allclose(six, two)


def test_rays(spark):
    m = np.array([[1.0, 1.0]])
    d = np.array([[1.0, 0.0, 0.0]])
    far, cell = raytrace.nearest_hits(m, (1, 1), np.array([[0.0, 0.0, 1.0]]) + d * 1e-6, d, np.array([0]))
    assert cell[0] == 1 and far[0] == pytest.approx(0.5, abs=1e-5)
    assert raytrace.face_normals(m, (1, 1), np.array([[0.5, 0.0, 1.0]]), cell)[0].tolist() == [-1, 0, 0]
    down = np.array([[0.0, 0.0, -1.0]])
    assert raytrace.nearest_hits(np.array([[1.0]]), (1, 1), np.array([[0.0, 0.0, 1.0]]), down, np.array([0]))[1][0] == -1
    assert raytrace.radiance(np.array([[1.0, 0, 0]]), Lighting(sky=1.5, sun=2.0, azimuth=90, elevation=0, diameter=45))[0] == 3.5
    one = raytrace.first_rays(3, np.array([5, 5]), np.array([0, 1]), Lighting(rays=32))
    assert (one == raytrace.first_rays(3, np.array([5, 5]), np.array([0, 1]), Lighting(rays=32))).all() and (one[:, 2] >= 0).all()
    cells, g = raster(spark, [[1, 2, 3, 4], [1, 2, 3, 4], [2, 3, 4, 5], [2, 3, 4, 5]])
    t = Tiling(g, 4)
    again = [matrix(raytrace.occlusion(cells.repartition(n), t, Lighting(rays=16, bounces=b))) for n in (1, 4) for b in (0, 2)]
    assert (again[0] == again[2]).all() and (again[1] == again[3]).all() and (again[1] >= again[0]).all()
    cells, g = raster(spark, [[None, None, 1, 1], [None, None, 1, 1]])
    assert raytrace.occlusion(cells, Tiling(g, 2, 2, 2, Window(0, 0, 2, 2)), Lighting(rays=16)).count() == 0
    for bad in ({"rays": 0}, {"bounces": -1}, {"sky": -1}, {"azimuth": 400}):
        with pytest.raises(ValueError):
            Lighting(**bad)


def test_missing_direction_sample(spark):
    cells, g = raster(spark, [[1.0]])
    out = directional.sky_view(cells, Tiling(g, 1), 8, 3).first()
    assert out.svf == 1.0 and out.openness == pytest.approx(math.degrees(math.pi / 2 - math.atan(-1000)))


def test_box_statistics_keep_their_precision_on_wide_rasters(spark):
    """High ground with 5 cm of noise: the local band of the last columns of a wide raster is that of the same cells alone."""
    r = np.random.default_rng(2)
    z = 2000 + r.normal(0, 0.05, (5, 20_000))
    wide = spark.createDataFrame(pd.DataFrame({"x": np.tile(np.arange(20_000), 5).astype(np.int32), "y": np.repeat(np.arange(5), 20_000).astype(np.int32), "z": z.ravel()}))
    small = dict(local=(1, 2, 1), meso=(3, 6, 3), broad=(10, 20, 10))
    got = {(a.x, a.y): (a.red, a.green, a.blue) for a in focal.mstp(wide, **small).where("x >= 19900").collect()}
    assert len(got) == 500
    for y, x in ((0, 19_999), (2, 19_950), (4, 19_930)):
        for band, radii in zip(got[x, y], ((10, 20), (3, 6), (1, 2))):
            deviations = []
            for q in radii:
                box = z[max(0, y - q) : y + q + 1, max(0, x - q) : x + q + 1]
                deviations.append(abs(z[y, x] - box.mean()) / (box.std() + 1e-6))
            assert abs(band - (1 - math.exp(-0.9 * max(deviations)))) < 1e-6


def test_boxes_of_tiles_equal_plain_means(spark, monkeypatch):
    """Radii over and under the tile's width, missing cells, cells on tile borders."""
    r = np.random.default_rng(3)
    rows = [[None if r.random() < 0.2 else float(v) for v in line] for line in r.integers(0, 9, (70, 530))]
    cells, _ = raster(spark, rows)
    z = np.array([[np.nan if v is None else v for v in line] for line in rows])
    got = matrix(focal.slrm(cells, 3))
    for y in range(0, 70, 7):
        for x in [0, 1, 509, 511, 512, 513, 515, 529]:
            want = z[y, x] - np.nanmean(z[max(0, y - 3) : y + 4, max(0, x - 3) : x + 4])
            assert np.isnan(want) and np.isnan(got[y, x]) or abs(want - got[y, x]) < 1e-9


def test_an_error_names_its_tile(spark):
    cells, g = raster(spark, [[1, 2, 3, 4]] * 4)

    def kernel(m, ys, xs, tile):
        if tile.number == 3:
            raise ValueError("bad cell")
        return (m[ys, xs],)

    with pytest.raises(Exception, match="tile 3: bad cell"):
        directional.over_tiles(cells, Tiling(g, 2), kernel, "v").collect()


def test_errors_of_box_statistics_name_their_tile(spark):
    cells, _ = raster(spark, [[1.0, 2.0], [3.0, 4.0]])
    with pytest.raises(Exception, match=r"tile 0,0 of 512 cells: .*zero"):
        focal.over_boxes(cells, 3, lambda z, core: 1 / 0, "v").collect()
