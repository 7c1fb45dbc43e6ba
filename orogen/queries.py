"""The registered queries of the raster operators, and their SQL for DuckDB."""

from __future__ import annotations

import functools
import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.functions.lighting import Lighting
from orogen.functions.numbers import fixed, stretch, to_byte
from orogen.operators import align, compose, directional, focal, horizon, raytrace, vat, zonal
from orogen.operators.grid import BBox, Grid, Tiling, clip, counts, keep_tiles, plan, tile_of
from orogen.shipping import ship
from orogen.plans import products, render
from orogen.sources import geotiff, sink, style
from orogen.sources.derived import embedding_raster, part_raster, shipping_raster, unit_range, with_holes
from orogen.work import new_folder

TILE = 64
SUN = Lighting(sky=0.7, sun=0.5, azimuth=200.0, elevation=35.0, diameter=30.0, ambient=0.1)
RAYS = [(math.cos(e) * math.sin(a), -math.cos(e) * math.cos(a), math.sin(e)) for e in (0.2, 0.6) for a in (i * math.pi / 4 + 0.1 for i in range(8))]
BOX = BBox(10.2, 20.5, 50.7, 300.25)
RAMP = (compose.Stop(0.1, "#204060", 0.25), compose.Stop(0.4, "#80FF10", 0.75), compose.Stop(0.8, "#F0C0A0", 1.0))
BASE = compose.legacy("z", 0.0, 1.0, "#CBEA9A", "#1F6B2A")
VEIL = compose.legacy("w", 0.0, 50.0, "#FFEECC", "#331100", opacity=0.7, alpha="z")


def emb(spark, sf_dir):
    return embedding_raster(ship(spark), sf_dir)


def hole(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return with_holes(cells), g


def tiling(g: Grid, buffer: int = 0, size: int = TILE) -> Tiling:
    return Tiling(g, size, buffer, buffer)


def _out(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("x", "y", *(fixed(F.col(c)).alias(c) for c in columns or ("v",)))


def bbox_clip(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return _out(clip(cells, g.snap(BOX)), "z")


def tile_plan(spark, sf_dir):
    _, g = hole(spark, sf_dir)
    return plan(spark, Tiling(g, 16, 3, 5, g.snap(BOX)))


def tile_skip(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return counts(cells, tiling(g, 0, 3)).where("valid > 7")


def start_tile(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return _out(keep_tiles(cells, tiling(g, 0, 16), start=5).withColumnRenamed("tile_id", "t"), "z")


def slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, _ = hole(spark, sf_dir)
    return _out(focal.slope_aspect(cells).select("x", "y", F.degrees("slope").alias("v")))


def aspect(spark, sf_dir):
    cells, _ = emb(spark, sf_dir)
    return _out(focal.slope_aspect(cells).select("x", "y", F.col("aspect").alias("v")))


def hillshade(spark, sf_dir):
    cells, _ = emb(spark, sf_dir)
    return _out(focal.slope_aspect(cells, exaggeration=0.05).select("x", "y", focal.shade(315, 35).alias("v")))


def multi_hillshade(spark, sf_dir):
    cells, _ = emb(spark, sf_dir)
    return _out(focal.multi_hillshade(cells, 4, 35.0, exaggeration=0.05), "b0", "b1", "b2", "b3")


def slrm(spark, sf_dir):
    return _out(focal.slrm(hole(spark, sf_dir)[0], 5))


def msrm(spark, sf_dir):
    return _out(focal.msrm(hole(spark, sf_dir)[0]))


def mstp(spark, sf_dir):
    return _out(focal.mstp(hole(spark, sf_dir)[0]), "red", "green", "blue")


def _sky(column: str, raster=emb, **parameters):
    def run(spark, sf_dir):
        cells, g = raster(spark, sf_dir)
        return _out(directional.sky_view(cells, tiling(g, 10), **parameters).select("x", "y", F.col(column).alias("v")))

    return run


svf = _sky("svf")
svf_hole = _sky("svf", hole)
svf_noise = _sky("svf", noise=3)
asvf = _sky("asvf")
asvf_strong = _sky("asvf", anisotropy=2)
openness_pos = _sky("openness")
openness_neg = _sky("openness", invert=True)


def _illumination(model: str, shadow=None):
    def run(spark, sf_dir):
        cells, g = emb(spark, sf_dir)
        return _out(directional.sky_illumination(cells, tiling(g, 20), model, 16, 20, shadow))

    return run


sky_uniform, sky_overcast, sky_shadow = _illumination("uniform"), _illumination("overcast"), _illumination("overcast", (315.0, 85.0))


def local_dominance(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return _out(directional.local_dominance(cells, tiling(g, 20)))


def _vat(terrain: str):
    def run(spark, sf_dir):
        cells, g = emb(spark, sf_dir)
        return _out(vat.vat(cells, tiling(g, 20), terrain))

    return run


vat_general, vat_flat, vat_combined = _vat("general"), _vat("flat"), _vat("combined")


def stretch_value(spark, sf_dir):
    cells, _ = shipping_raster(ship(spark), sf_dir)
    return _out(cells.select("x", "y", stretch(F.col("z"), 40.0, 49.5).alias("v")))


def stretch_percent(spark, sf_dir):
    cells, g = shipping_raster(ship(spark), sf_dir)
    return _out(zonal.stretch_percent(cells.withColumn("tile_id", tile_of(tiling(g, 0, 16))), "tile_id", 5.0, 10.0))


def byte_encode(spark, sf_dir):
    cells, _ = shipping_raster(ship(spark), sf_dir)
    return cells.select("x", "y", to_byte(F.col("z") / 50).alias("v"))


def part_slope(spark, sf_dir):
    cells, _ = part_raster(ship(spark), sf_dir)
    return _out(focal.slope_aspect(cells).select("x", "y", F.degrees("slope").alias("v")))


def _layers(spark, sf_dir):
    """The embedding raster from 0 to 1, and the shipping raster under it by repetition."""
    cells, _ = emb(spark, sf_dir)
    ship_cells, _ = shipping_raster(spark, sf_dir)
    both = unit_range(cells).withColumn("k", F.col("y") % 64)
    return both.join(ship_cells.select("x", F.col("y").alias("k"), F.col("z").alias("w")), ["x", "k"], "left").select("x", "y", "z", "w")


def ramp_legacy(spark, sf_dir):
    return compose.as_bytes(compose.compose(_layers(spark, sf_dir), [BASE]))


def ramp_stops(spark, sf_dir):
    return compose.as_bytes(compose.compose(_layers(spark, sf_dir), [compose.Layer("z", RAMP)]), with_alpha=True)


def _composed(mode: str):
    def run(spark, sf_dir):
        layers = [BASE, compose.Layer("w", VEIL.stops, mode, 0.7)]
        return compose.as_bytes(compose.compose(_layers(spark, sf_dir), layers))

    return run


compose_normal, compose_multiply, compose_screen, compose_softlight = map(_composed, compose.BLENDS)


def compose_alpha(spark, sf_dir):
    return compose.as_bytes(compose.compose(_layers(spark, sf_dir), [VEIL]), with_alpha=True)


def _half(g: Grid) -> Grid:
    return Grid(g.width // 2, g.height // 2, g.min_x, g.min_y, 2.0, 2.0)


def align_max(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return _out(align.align_grid(cells, g, _half(g)), "z")


def align_nearest(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return _out(align.nearest(cells, g, _half(g)), "z")


def align_bilinear(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return _out(align.bilinear(cells, g, Grid(g.width // 2 - 1, g.height // 2, g.min_x + 0.5, g.min_y, 2.0, 2.0)), "z")


def align_overlap(spark, sf_dir):
    cells, g = hole(spark, sf_dir)
    return _out(align.block_max(cells, g, Grid(40, g.height // 2 + 8, g.min_x - 4, g.min_y - 10, 2.0, 2.0)), "z")


def horizon_pyramid(spark, sf_dir):
    cells, _ = hole(spark, sf_dir)
    return horizon.pyramid_cells(cells, 3).select("level", "x", "y", fixed(F.col("z")).alias("z"))


def horizon_diffuse(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return _out(horizon.visibility(cells, tiling(g, 40), SUN, 16, 32.0).select("x", "y", F.col("diffuse").alias("v")))


def horizon_sun(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return _out(horizon.visibility(cells, tiling(g, 40), SUN, 16, 32.0, 0.05), "sun", "v")


def anyhit_fixed_rays(spark, sf_dir):
    cells, g = shipping_raster(ship(spark), sf_dir, 16)
    return raytrace.fixed_hits(cells.withColumn("z", F.col("z") * 0.2), tiling(g), RAYS).select("x", "y", F.size(F.filter("distances", lambda d: d.isNotNull())).alias("hits"))


def nearest_hit_fixed_rays(spark, sf_dir):
    cells, g = shipping_raster(ship(spark), sf_dir, 16)
    hit = raytrace.fixed_hits(cells.withColumn("z", (F.col("x") * 5 + F.col("y") * 3) % 7), tiling(g), RAYS)
    return hit.select("x", "y", F.posexplode("distances").alias("ray", "d")).select("x", "y", "ray", fixed(F.col("d")).alias("d"))


def occlusion_exact(spark, sf_dir):
    cells, g = shipping_raster(ship(spark), sf_dir, 16)
    return _out(raytrace.occlusion(cells, tiling(g, 4, 8), Lighting(rays=64, sun=0.3, azimuth=180.0, elevation=35.0), 0.2))


def occlusion_bounces(spark, sf_dir):
    cells, g = shipping_raster(ship(spark), sf_dir, 16)
    return _out(raytrace.occlusion(cells, tiling(g, 4, 8), Lighting(rays=32, bounces=2), 0.2))


def mosaic_roundtrip(spark, sf_dir):
    cells, g = emb(spark, sf_dir)
    return _out(directional.over_tiles(cells, tiling(g, 7), lambda m, ys, xs, tile: (m[ys, xs],), "v"))


def _file(spark: SparkSession, sf_dir: str) -> tuple[str, Grid]:
    """The raster with holes, written as one GeoTIFF."""
    cells, g = hole(spark, sf_dir)
    g = replace(g, nodata=-9999.0)
    return sink.write_single(cells, Tiling(g, 48), ["z"], f"{new_folder(spark, 'raster')}/raster.tif", nodata_tag=-9999.0), g


def geotiff_single(spark, sf_dir):
    return _out(geotiff.load(spark, _file(spark, sf_dir)[0])[0], "z")


def geotiff_bbox(spark, sf_dir):
    return _out(geotiff.load(spark, _file(spark, sf_dir)[0], BOX)[0], "z")


def geotiff_metadata(spark, sf_dir):
    return geotiff.load(spark, _file(spark, sf_dir)[0])[1].describe(spark).drop("source")


def geotiff_tiles(spark, sf_dir):
    """Every written tile read again as one raster, in one scan."""
    cells, g = hole(spark, sf_dir)
    g, folder = replace(g, nodata=-9999.0), new_folder(spark, "tiles")
    sink.write_tiles(cells, Tiling(g, 200), ["z"], folder, nodata_tag=-9999.0)
    return _out(geotiff.load_tiles(spark, folder)[0], "z")


def geotiff_filter(spark, sf_dir):
    """Bounds on x and y in a where(): the reader takes them, so only the blocks between them are read."""
    path, g = _file(spark, sf_dir)
    w = g.snap(BOX)
    cells = geotiff.load(spark, path)[0].where((F.col("x") >= w.x) & (F.col("x") < w.end_x) & (F.col("y") > w.y - 1) & (F.col("y") <= w.end_y - 1))
    return _out(cells, "z")


def geotiff_big(spark, sf_dir):
    """The raster as a BigTIFF, read again."""
    cells, g = hole(spark, sf_dir)
    path = sink.write_single(cells, Tiling(replace(g, nodata=-9999.0), 48), ["z"], f"{new_folder(spark, 'raster')}/big.tif", nodata_tag=-9999.0, big=True)
    return _out(geotiff.load(spark, path)[0], "z")


def geotiff_bytes(spark, sf_dir):
    """Tiles of bytes, read again as one raster."""
    cells, g = shipping_raster(ship(spark), sf_dir)
    folder = new_folder(spark, "bytes")
    sink.write_tiles(cells.select("x", "y", to_byte(F.col("z") / 50).alias("v")), Tiling(g, 16), ["v"], folder, as_bytes=True)
    return _out(geotiff.load_tiles(spark, folder)[0], "z")


def render_files(spark, sf_dir):
    """Two layers from files, by a style, met on the first one's grid and composed."""
    both, (_, g) = _layers(spark, sf_dir), emb(spark, sf_dir)
    t, folder = Tiling(replace(g, nodata=-9999.0), 64), new_folder(spark, "layers")
    paths = [sink.write_single(both, t, [c], f"{folder}/{c}.tif", nodata_tag=-9999.0) for c in ("z", "w")]
    looks = [{"valueMin": 0, "valueMax": 1, "colorFrom": "#CBEA9A", "colorTo": "#1F6B2A", "blendMode": "normal", "opacity": 1.0}, {"valueMin": 0, "valueMax": 50, "colorFrom": "#FFEECC", "colorTo": "#331100", "blendMode": "multiply", "opacity": 0.7, "resampling": "nearest"}]
    return render.render(spark, [style.read_layer({"input": p} | look) for p, look in zip(paths, looks)])[0]


def product_bytes(spark, sf_dir):
    """A product as the commands give it: with its own buffer, stretched to bytes by its table entry."""
    cells, g = hole(spark, sf_dir)
    return products.render("slope", cells, products.tiling_for("slope", g, 100), as_bytes=True)


def geotiff_slope(spark, sf_dir):
    """Slope of the cells of a window, read with a margin of one cell."""
    path, g = _file(spark, sf_dir)
    w = g.snap(BOX)
    cells, _ = geotiff.load(spark, path, window=geotiff.widened(w, 1, 1, g))
    return _out(clip(focal.slope_aspect(cells).select("x", "y", F.degrees("slope").alias("v")), w))


def queries() -> dict:
    names = """geotiff_single geotiff_big geotiff_filter geotiff_bytes render_files product_bytes asvf_strong geotiff_bbox geotiff_metadata geotiff_tiles geotiff_slope bbox_clip tile_plan tile_skip start_tile slope aspect hillshade multi_hillshade slrm msrm mstp svf svf_hole svf_noise asvf openness_pos openness_neg
    sky_uniform sky_overcast sky_shadow local_dominance vat_general vat_flat vat_combined stretch_value stretch_percent byte_encode part_slope ramp_legacy ramp_stops
    compose_normal compose_multiply compose_screen compose_softlight compose_alpha align_max align_nearest align_bilinear align_overlap horizon_pyramid horizon_diffuse
    horizon_sun anyhit_fixed_rays nearest_hit_fixed_rays occlusion_exact occlusion_bounces mosaic_roundtrip""".split()
    return {n: globals()[n] for n in names}
