"""A combined view for archaeology: hillshade, slope, openness and sky view blended."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions.numbers import stretch
from orogen.operators.directional import gradient, over_tiles, sky_factors, with_margin
from orogen.operators.focal import shade
from orogen.operators.grid import Tiling


@dataclass(frozen=True)
class Preset:
    sun: tuple[float, float]
    slope: tuple[float, float]
    svf: tuple[float, float]
    radius: int
    noise: int
    openness: tuple[float, float]


GENERAL = Preset((315.0, 35.0), (0.0, 50.0), (0.7, 1.0), 10, 0, (68.0, 93.0))
FLAT = Preset((315.0, 15.0), (0.0, 15.0), (0.9, 1.0), 20, 3, (85.0, 93.0))


def over(active: Column, background: Column, opacity: float) -> Column:
    return active * opacity + background * (1 - opacity)


def overlay(active: Column, background: Column) -> Column:
    return F.when(background > 0.5, 1 - (1 - 2 * (background - 0.5)) * (1 - active)).otherwise(2 * background * active)


def blended(preset: Preset, name: str) -> Column:
    """Slope over hillshade by half, openness overlaid by half, sky view multiplied by a quarter; the columns svf and openness end in name."""
    v = over(stretch(F.degrees("slope"), *preset.slope), stretch(shade(*preset.sun), 0.0, 1.0), 0.5)
    v = over(overlay(stretch(F.col(f"openness_{name}"), *preset.openness), v), v, 0.5)
    return over(stretch(F.col(f"svf_{name}"), *preset.svf) * v, v, 0.25)


def vat(cells: DataFrame, t: Tiling, terrain: str = "combined", opacity: float = 50.0) -> DataFrame:
    """x, y, v for terrain general, flat, or both mixed by the general one's opacity in percent. A tile gives slope, aspect and the sky of each preset at once."""
    used = {k: p for k, p in (("general", GENERAL), ("flat", FLAT)) if terrain in (k, "combined")}
    res = t.grid.res_x, t.grid.res_y
    skies = [sky_factors(16, p.radius, p.noise, *res) for p in used.values()]

    def kernel(m, ys, xs, tile):
        out = [*gradient(m, ys, xs, *res)]
        for sky in skies:
            svf, _, openness = sky(m, ys, xs, tile)
            out += [svf, openness]
        return out

    seen = over_tiles(cells, with_margin(t), kernel, "slope", "aspect", *(f"{n}_{k}" for k in used for n in ("svf", "openness")))
    values = [blended(p, k) for k, p in used.items()]
    return seen.select("x", "y", (values[0] if len(values) == 1 else over(values[0], values[1], opacity / 100)).alias("v"))
