import json

import numpy as np
import pytest

from orogen.operators import align
from orogen.operators.compose import Layer, Stop, as_bytes, compose, hex_color, legacy, parse_color
from orogen.operators.grid import Grid, Window
from orogen.plans.render import layered
from orogen.sources import style
from orogen.sources.style import read_style
from tests.helpers import BASE, matrix, raster

GREEN = legacy("z", 0.0, 1.0, "#CBEA9A", "#1F6B2A")


def bands(df, names=("red", "green", "blue")):
    return [matrix(df, n)[0].astype(int).tolist() for n in names]


def test_base_ramp_bytes(spark):
    cells, _ = raster(spark, BASE)
    assert bands(as_bytes(compose(cells, [GREEN]))) == [[203, 117, 31, 117], [234, 170, 107, 170], [154, 98, 42, 98]]
    assert parse_color("#1f6B2a") == (31, 107, 42) and hex_color((31, 107, 42)) == "#1F6B2A"


def test_blends(spark):
    one = spark.createDataFrame([(0, 0, 1.0)], "x int, y int, z double")
    white, green = legacy("z", 0.0, 1.0, "#FFFFFF", "#FFFFFF"), legacy("z", 0.0, 1.0, "#00FF00", "#00FF00", opacity=0.5)
    assert [v[0] for v in bands(as_bytes(compose(one, [white, green])))] == [128, 255, 128]
    assert [v[0] for v in bands(as_bytes(compose(one, [legacy("z", 0.0, 1.0, "#FFFFFF", "#FFFFFF", blend="multiply")])))] == [0, 0, 0]
    grey = lambda c, mode="normal": legacy("z", 0.0, 1.0, c, c, blend=mode)
    for mode in ("screen", "softlight", "soft-light"):
        out = compose(one, [grey("#333333"), grey("#B3B3B3", mode)]).first()
        to = lambda v: v / 12.92 if v <= 0.04045 else ((v + 0.055) / 1.055) ** 2.4
        s, b = to(179 / 255), to(51 / 255)
        lin = 1 - (1 - s) * (1 - b) if mode == "screen" else (b - (1 - 2 * s) * b * (1 - b) if s <= 0.5 else None)
        back = 12.92 * lin if lin <= 0.0031308 else 1.055 * lin ** (1 / 2.4) - 0.055
        assert out.red == pytest.approx(back, abs=1e-5)


def test_stops_alpha_and_missing(spark):
    cells = spark.createDataFrame([(0, 0, -5.0, 1.0), (1, 0, 5.0, 0.5), (2, 0, 10.0, None), (3, 0, None, 1.0), (4, 0, 25.0, 2.0)], "x int, y int, z double, w double")
    layer = Layer("z", (Stop(0.0, "#000000", 0.0), Stop(10.0, "#FF0000", 0.5), Stop(20.0, "#00FF00", 1.0)), alpha="w", opacity=0.8)
    out = {r.x: r for r in compose(cells, [layer]).collect()}
    assert out[0].alpha == 0 and out[1].alpha == pytest.approx(0.25 * 0.8 * 0.5) and out[2].alpha == 0 and out[3].alpha == 0 and out[4].alpha == pytest.approx(0.8)
    assert out[1].red == pytest.approx(0.5) and out[4].green == pytest.approx(1.0)


def test_block_max(spark):
    fine, g = raster(spark, [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]], 0.5)
    coarse = Grid(2, 2, 0, 0, 1, 1)
    assert matrix(align.align_grid(fine, g, coarse), "z").ravel().tolist() == [5, 7, 13, 15]
    holes, g = raster(spark, [[None, None, 2, 3], [None, None, 6, 7], [8, 9, None, None], [12, 1, None, None]], 0.5)
    np.testing.assert_equal(matrix(align.align_grid(holes, g, coarse), "z").ravel(), [np.nan, 7, 12, np.nan])
    bad = {"CRS": Grid(4, 4, 0, 0, 0.5, 0.5, "EPSG:3857"), "finer": Grid(4, 4, 0, 0, 2, 2), "integer": Grid(4, 4, 0, 0, 0.3, 0.3), "dimensions": Grid(3, 4, 0, 0, 0.5, 0.5), "minX": Grid(4, 4, 0.25, 0, 0.5, 0.5), "maxY": Grid(4, 4, 0, 0.25, 0.5, 0.5), "extent": Grid(2, 2, 0, 0, 0.5, 0.5)}
    for word, grid in bad.items():
        with pytest.raises(ValueError, match=word):
            align.align_grid(fine, grid, coarse)


def test_bilinear_and_nearest(spark):
    cells, g = raster(spark, [[0, 0.25, 0.75, 1]] * 4, 0.5)
    coarse = Grid(2, 2, 0, 0, 1, 1)
    out = matrix(align.bilinear(cells, g, coarse), "z")
    assert np.floor(out * 255 + 0.5).ravel().tolist() == [32, 223, 32, 223]
    np.testing.assert_allclose(matrix(align.bilinear(cells, g, g), "z"), [[0, 0.25, 0.75, 1]] * 4)
    assert np.isnan(matrix(align.bilinear(cells, g, Grid(2, 2, 50, 50, 1, 1)), "z")).all()
    assert matrix(align.nearest(cells, g, coarse), "z")[0].tolist() == [0.25, 1]


def test_layers_are_joined_on_the_first_grid(spark):
    base, g = raster(spark, [[1.0] * 4] * 4)
    over, h = raster(spark, [[1.0] * 2] * 2, 1.0, 0.0, 2.0)
    white, green = legacy("", 0.0, 1.0, "#FFFFFF", "#FFFFFF"), legacy("", 0.0, 1.0, "#00FF00", "#00FF00", opacity=0.5, resampling="max")
    table, layers, _ = layered({"a": (base, g), "b": (over, h)}, [("a", None, white), ("b", "b", green)])
    red = matrix(as_bytes(compose(table, layers)), "red")
    assert red[:2, :2].tolist() == [[128, 128]] * 2 and red[2:].min() == 255 and red[:, 2:].min() == 255
    with pytest.raises(ValueError, match="minX is not aligned"):
        layered({"a": (base, g), "b": (over, Grid(2, 2, 0.25, 2, 1, 1))}, [("a", None, white), ("b", None, green)])
    with pytest.raises(ValueError, match="CRS"):
        layered({"a": (base, g), "b": (over, Grid(2, 2, 0, 2, 1, 1, "EPSG:3857"))}, [("a", None, white), ("b", None, green)])


def test_style_checks(tmp_path):
    good = {"input": "a.tif", "valueMin": 0, "valueMax": 1, "colorFrom": "#000000", "colorTo": "#FFFFFF", "blendMode": "soft-light", "opacity": 0.5}
    stops = {k: good[k] for k in ("input", "blendMode", "opacity")}
    cases = [
        ({"colorFrom": "red"}, "RRGGBB"), ({"valueMin": 2}, "valueMin must be < valueMax"), ({"opacity": 1.5}, "opacity"), ({"blendMode": "add"}, "Unsupported blendMode"), ({"resampling": "cubic"}, "Unsupported resampling"),
        ({"stops": []}, "not both"), ({"colorTo": None}, "Legacy color ramps"), ({"input": " "}, "input is required"), ({"blendMode": None}, "blendMode is required"),
    ]
    path = tmp_path / "s.json"
    for change, word in cases:
        path.write_text(json.dumps({"layers": [good | change]}))
        with pytest.raises(ValueError, match=word):
            read_style(path)
    for own, word in (([{"value": 0, "color": "#000000"}], "two entries"), ([{"value": 1, "color": "#000000"}, {"value": 1, "color": "#000000"}], "increasing"), ([{"value": 0, "color": "#000000", "alpha": 2}, {"value": 1, "color": "#000000"}], "alpha")):
        path.write_text(json.dumps({"layers": [stops | {"stops": own}]}))
        with pytest.raises(ValueError, match=word):
            read_style(path)
    path.write_text("{")
    with pytest.raises(ValueError, match="Invalid render style JSON"):
        read_style(path)
    path.write_text(json.dumps({"layers": [good | {"alphaInput": "b.tif"}]}))
    source, alpha, layer = read_style(path)[0]
    assert (source, alpha, layer.blend, layer.resampling) == ("a.tif", "b.tif", "softlight", "bilinear")


def by_hand(m, own, target, how):
    """Cell by cell, as the definitions say it."""
    out = np.full((target.height, target.width), np.nan)
    for y in range(target.height):
        for x in range(target.width):
            u = (target.min_x + (x + 0.5) * target.res_x - own.min_x) / own.res_x
            v = (own.max_y - (target.max_y - (y + 0.5) * target.res_y)) / own.res_y
            if how == "max":
                part = [m[j, i] for j in range(own.height) for i in range(own.width) if int((own.min_x + (i + 0.5) * own.res_x - target.min_x) // target.res_x) == x and int((target.max_y - own.max_y + (j + 0.5) * own.res_y) // target.res_y) == y]
                out[y, x] = np.nanmax(part) if len(part) and not np.isnan(part).all() else np.nan
            elif how == "nearest":
                i, j = int(np.floor(u)), int(np.floor(v))
                out[y, x] = m[j, i] if 0 <= i < own.width and 0 <= j < own.height else np.nan
            elif 0 <= u <= own.width and 0 <= v <= own.height:
                u, v = min(max(u - 0.5, 0), own.width - 1), min(max(v - 0.5, 0), own.height - 1)
                i, j, total = int(u), int(v), 0.0
                for b in (0, 1):
                    for a in (0, 1):
                        w = (u - i if a else 1 - u + i) * (v - j if b else 1 - v + j)
                        total += w * m[j + b, i + a] if w > 0 else 0.0
                out[y, x] = total
    return out


def test_tiles_meet_all_layers_in_one_exchange(spark, monkeypatch):
    r = np.random.default_rng(5)
    monkeypatch.setattr(align, "TILE", 4)
    monkeypatch.setattr(align, "HELD", 12)
    target = Grid(13, 11, 100.0, 50.0, 2.0, 2.0)
    own = {"same": target, "max": Grid(12, 20, 102.0, 52.0, 1.0, 1.0), "nearest": Grid(9, 7, 97.0, 48.5, 3.0, 3.0), "bilinear": Grid(40, 30, 99.3, 51.1, 0.7, 0.9), "far": Grid(3, 3, 0.0, 0.0, 2.0, 2.0), "bilinear2": Grid(5, 4, 101.0, 51.0, 5.0, 5.0), "much": Grid(52, 44, 100.0, 50.0, 0.5, 0.5), "block": Grid(26 * 13, 22, 100.0, 50.0, 1 / 13, 1.0)}
    own["block"] = Grid(13 * 16, 11 * 2, 100.0, 50.0, 0.125, 1.0)
    how = {"far": "nearest", "bilinear2": "bilinear", "much": "max", "block": "max"}
    rasters = {}
    for n, g in own.items():
        m = np.where(r.random((g.height, g.width)) < 0.1, np.nan, r.normal(0, 1, (g.height, g.width)))
        df = spark.createDataFrame([(x, y, None if np.isnan(m[y, x]) else float(m[y, x])) for y in range(g.height) for x in range(g.width)], "x int, y int, z double")
        rasters[n] = (m, g, align.Source(df, g, how.get(n, n), n))
    some = {n: s for n, (_, _, s) in rasters.items() if n != "block"}
    table = align.on_grid(some, target)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    for n in some:
        m, g, s = rasters[n]
        want = m if n == "same" else by_hand(m, g, target, s.how)
        np.testing.assert_allclose(matrix(table, n, (13, 11)), want, rtol=1e-12, err_msg=n)
    m, g, s = rasters["block"]  # one target cell takes more source cells than a tile holds
    np.testing.assert_allclose(matrix(align.on_grid({"z": s}, target), "z", (13, 11)), by_hand(m, g, target, "max"))
    part = align.on_grid(some, target, Window(3, 2, 7, 6)).collect()
    assert {(x.x, x.y) for x in part} == {(x, y) for x in range(3, 10) for y in range(2, 8)}
    whole = matrix(table, "bilinear", (13, 11))
    assert all((x.bilinear is None and np.isnan(whole[x.y, x.x])) or x.bilinear == whole[x.y, x.x] for x in part)


def test_styles_that_are_no_styles():
    good = {"input": "a.tif", "blendMode": "normal", "opacity": 1.0, "stops": [{"value": 0, "color": "#000000"}, {"value": 1, "color": "#ffffff"}]}
    style.read_layer(good)
    for bad in ({"stops": [{"color": "#000000"}, {"value": 1, "color": "#ffffff"}]}, {"stops": 5}, {"stops": [1, 2]}, {"stops": [{"value": "0", "color": "#000000"}] * 2}, {"stops": [{"value": 0}, {"value": 1}]}, {"stops": None, "valueMin": "0", "valueMax": 1, "colorFrom": "#000000", "colorTo": "#ffffff"}, {"input": 5}, {"blendMode": 1}, {"opacity": "1"}, {"opacity": True}, {"resampling": []}):
        with pytest.raises(ValueError):
            style.read_layer(good | bad)
