"""Command line: occlusion exact|horizon, rvt <product>, render compose|align-grid."""

from __future__ import annotations

import argparse
import logging
import math
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orogen.functions.lighting import Lighting
from orogen.functions.numbers import to_byte
from orogen.operators import align, horizon, raytrace
from orogen.operators.grid import BBox, Grid, Tiling
from orogen.plans import products, render
from orogen.sources import geotiff, sink, style

LOG = logging.getLogger("orogen")


def choice(name: str, *allowed: str):
    def read(text: str) -> str:
        if text.strip().lower() not in allowed:
            raise argparse.ArgumentTypeError(f"Unsupported {name}: {text} (expected: {' or '.join(allowed)})")
        return text.strip().lower()

    return read


def scale(text: str) -> tuple[int, int, int]:
    parts = text.split(",")
    if len(parts) != 3:
        raise argparse.ArgumentTypeError("scale must be min,max,step")
    return tuple(int(p) for p in parts)


def common(p: argparse.ArgumentParser, raster: bool = True) -> None:
    if raster:
        p.add_argument("--input", required=True)
        p.add_argument("--output-data-type", type=choice("output data type", "float32", "uint8"), default="float32")
        p.add_argument("--buffer-px", type=int)
        p.add_argument("--buffer-m", type=float)
    p.add_argument("--bbox", required=True, type=BBox.parse)
    p.add_argument("--output-mode", type=choice("output mode", "single-file", "tile-files"), default="tile-files")
    p.add_argument("--output")
    p.add_argument("--start-tile", type=int, default=0)
    running(p)


def running(p: argparse.ArgumentParser) -> None:
    p.add_argument("--tile-size", type=int, default=2000)
    p.add_argument("--threads", type=int, default=0, help="cores of a local session; 0: all")
    p.add_argument("--info", action="store_true")
    p.add_argument("--verbose", action="store_true")


#: Options of each product: flag, parameter, type.
OPTIONS = {
    "hillshade": [("--sun-azimuth", "sun_azimuth", float), ("--sun-elevation", "sun_elevation", float)],
    "multi-hillshade": [("--directions", "directions", int), ("--sun-elevation", "sun_elevation", float)],
    "slrm": [("--radius", "radius", int)],
    "svf": [("--directions", "directions", int), ("--radius", "radius", int), ("--noise", "noise", int)],
    "asvf": [("--directions", "directions", int), ("--radius", "radius", int), ("--noise", "noise", int), ("--anisotropy-direction", "anisotropy_direction", float), ("--anisotropy-level", "anisotropy_level", int)],
    "sky-illumination": [("--sky-model", "sky_model", str), ("--directions", "directions", int), ("--shadow-distance", "shadow_distance", int), ("--shadow", "shadow", bool), ("--shadow-azimuth", "shadow_azimuth", float), ("--shadow-elevation", "shadow_elevation", float)],
    "local-dominance": [("--min-radius", "min_radius", int), ("--max-radius", "max_radius", int), ("--radius-increment", "increment", int), ("--angular-resolution", "angle", int), ("--observer-height", "observer_height", float)],
    "msrm": [("--feature-min", "feature_min", float), ("--feature-max", "feature_max", float), ("--scaling-factor", "scaling", int)],
    "mstp": [("--local-scale", "local", scale), ("--meso-scale", "meso", scale), ("--broad-scale", "broad", scale), ("--lightness", "lightness", float)],
    "vat": [("--terrain", "terrain", str), ("--general-opacity", "opacity", float)],
}
OPTIONS["positive-openness"] = OPTIONS["negative-openness"] = OPTIONS["svf"]
LIGHT = [("-r", "rays", int), ("-B", "bounces", int), ("--bias", "bias", float), ("--ambient-power", "ambient", float), ("--sky-power", "sky", float), ("--sun-power", "sun", float), ("--sun-azimuth", "azimuth", float), ("--sun-elevation", "elevation", float), ("--sun-angular-diam", "diameter", float)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orogen")
    families = top.add_subparsers(dest="family", required=True)
    occlusion = families.add_parser("occlusion").add_subparsers(dest="command", required=True)
    for name in ("exact", "horizon"):
        p = occlusion.add_parser(name)
        common(p)
        for flag, dest, kind in LIGHT:
            p.add_argument(flag, dest=dest, type=kind, default=getattr(Lighting, dest))
        p.add_argument("-e", dest="exaggeration", type=float, default=1.0)
        if name == "horizon":
            p.add_argument("--horizon-directions", type=int, default=32)
            p.add_argument("--horizon-radius-m", type=float)
    rvt = families.add_parser("rvt").add_subparsers(dest="command", required=True)
    for name, product in products.PRODUCTS.items():
        p = rvt.add_parser(name)
        common(p)
        p.add_argument("-e", dest="exaggeration", type=float, default=1.0)
        for flag, dest, kind in OPTIONS.get(name, []):
            p.add_argument(flag, dest=dest, **({"action": "store_true"} if kind is bool else {"type": kind, "default": getattr(product.parameters, dest)}))
    rendering = families.add_parser("render").add_subparsers(dest="command", required=True)
    p = rendering.add_parser("compose")
    p.add_argument("--style", required=True)
    common(p, raster=False)
    p.add_argument("--with-alpha", action="store_true")
    p = rendering.add_parser("align-grid")
    for flag in ("--input", "--reference", "--output"):
        p.add_argument(flag, required=True)
    running(p)
    return top


def session(a: argparse.Namespace) -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.master(os.environ.get("SPARK_MASTER", f"local[{a.threads or '*'}]")).appName("orogen").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def write(df, t: Tiling, bands: list[str], a: argparse.Namespace, as_bytes: bool, tile_tag: float | None, single_tag: float | None) -> None:
    output = a.output or ("output.tif" if a.output_mode == "single-file" else "output_tiles")
    if a.output_mode == "single-file":
        sink.write_single(df, t, bands, output, as_bytes, single_tag)
        LOG.info("wrote %s", output)
    else:
        n = sink.write_tiles(df, t, bands, output, as_bytes, tile_tag, a.start_tile)
        LOG.info("wrote %d tiles to %s", n, output)


def buffer_of(a: argparse.Namespace, grid: Grid) -> int | None:
    products.require(a.buffer_px is None or a.buffer_m is None, "Use either --buffer-px or --buffer-m, not both")
    products.require((a.buffer_px or 0) >= 0, "bufferPixelsOverride must be >= 0")
    products.require((a.buffer_m or 0) >= 0, "bufferMetersOverride must be >= 0")
    return max(grid.pixels(a.buffer_m)) if a.buffer_m is not None else a.buffer_px


def run_raster(a: argparse.Namespace) -> None:
    spark = session(a)
    grid = geotiff.read_header(a.input).grid
    if a.info:
        print("\n".join(f"{k}: {v}" for k, v in grid.describe(spark).first().asDict().items()))
    window, buffer = grid.snap(a.bbox), buffer_of(a, grid)
    as_bytes = a.output_data_type == "uint8"
    products.require(a.exaggeration > 0, "exaggeration must be > 0")
    if a.family == "rvt":
        product = products.choose(a.command)
        p = product.parameters(**{d: getattr(a, d) for _, d, _ in OPTIONS.get(a.command, [])})
        t = products.tiling_for(a.command, grid, a.tile_size, p, buffer, window)
        cells, _ = geotiff.load(spark, a.input, window=geotiff.widened(window, max(t.buffer_x, 1), max(t.buffer_y, 1), grid))
        out = products.render(a.command, cells, t, p, a.exaggeration, as_bytes)
        write(out, t, product.bands(p), a, as_bytes, 0.0 if as_bytes else grid.nodata, grid.nodata)
        return
    light = Lighting(**{d: getattr(a, d) for _, d, _ in LIGHT})
    products.require(not as_bytes or a.output_mode == "tile-files", "occlusion uint8 output is only supported in tile-files mode")
    buffer = a.tile_size // 3 if buffer is None else buffer
    if a.command == "horizon":
        products.require(light.bounces == 0, "horizon supports only maxBounces=0")
        products.require(a.horizon_directions > 0, "horizonDirections must be > 0")
        if a.horizon_radius_m is not None:
            products.require(a.horizon_radius_m >= 0, "horizonRadiusMeters must be >= 0")
            buffer = max(buffer, *grid.pixels(a.horizon_radius_m))
        t = Tiling(grid, a.tile_size, buffer, buffer, window)
        cells, _ = geotiff.load(spark, a.input, window=geotiff.widened(window, buffer, buffer, grid))
        out = horizon.visibility(cells, t, light, a.horizon_directions, a.horizon_radius_m, a.exaggeration).select("x", "y", "v")
    else:
        t = Tiling(grid, a.tile_size, buffer, buffer, window)
        cells, _ = geotiff.load(spark, a.input, window=geotiff.widened(window, buffer, buffer, grid))
        out = raytrace.occlusion(cells, t, light, a.exaggeration)
    out = out.withColumn("v", to_byte(F.col("v"))) if as_bytes else out
    write(out, t, ["v"], a, as_bytes, 0.0 if as_bytes else grid.nodata, grid.nodata)


def run_render(a: argparse.Namespace) -> None:
    spark = session(a)
    if a.command == "align-grid":
        fine, g = geotiff.load(spark, a.input)
        _, coarse = geotiff.load(spark, a.reference)
        needed = render.needed(g, coarse, coarse.whole)
        if needed:  # the reader takes these bounds, so blocks beside the reference are not read
            fine = fine.where(F.col("x").between(needed.x, needed.end_x - 1) & F.col("y").between(needed.y, needed.end_y - 1))
        out = align.align_grid(fine, g, coarse)
        target = Grid(coarse.width, coarse.height, coarse.min_x, coarse.min_y, coarse.res_x, coarse.res_y, coarse.crs, g.nodata)
        sink.write_single(out.withColumnRenamed("z", "v"), Tiling(target, a.tile_size), ["v"], a.output, False, g.nodata)
        return
    layers = style.read_style(a.style)
    out, grid, window = render.render(spark, layers, a.bbox, True)
    names = ["red", "green", "blue"] + (["alpha"] if a.with_alpha else [])
    if a.output_mode == "tile-files":  # fully transparent tiles are not written
        out = out.select("x", "y", *(F.when(F.col("alpha") > 0, F.col(n)).alias(n) for n in names))
    write(out, Tiling(grid, a.tile_size, 0, 0, window), names, a, True, math.nan, math.nan)


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        (run_render if a.family == "render" else run_raster)(a)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
