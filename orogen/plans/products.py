"""The products by name: their parameters with checks, the buffer each needs, and how it is computed and stretched."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.operators import directional, focal, vat, zonal
from orogen.operators.grid import Grid, Tiling


def require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Slope:
    pass


@dataclass(frozen=True)
class Hillshade:
    sun_azimuth: float = 315.0
    sun_elevation: float = 35.0

    def __post_init__(self):
        require(0 <= self.sun_azimuth <= 360, "sun azimuth must be in [0, 360]")
        require(0 <= self.sun_elevation <= 90, "sun elevation must be in [0, 90]")


@dataclass(frozen=True)
class MultiHillshade:
    directions: int = 16
    sun_elevation: float = 35.0

    def __post_init__(self):
        require(self.directions > 0, "directions must be > 0")
        require(0 <= self.sun_elevation <= 90, "sun elevation must be in [0, 90]")


@dataclass(frozen=True)
class Slrm:
    radius: int = 20

    def __post_init__(self):
        require(self.radius > 0, "radius must be > 0")


@dataclass(frozen=True)
class SkyView:
    directions: int = 16
    radius: int = 10
    noise: int = 0
    anisotropy_direction: float = 315.0
    anisotropy_level: int = 1

    def __post_init__(self):
        require(self.directions > 0, "directions must be > 0")
        require(self.radius > 0, "radius must be > 0")
        require(0 <= self.noise <= 3, "noise level must be in [0, 3]")
        require(0 <= self.anisotropy_direction <= 360, "anisotropy direction must be in [0, 360]")
        require(self.anisotropy_level in (1, 2), "anisotropy level must be 1 or 2")


@dataclass(frozen=True)
class SkyIllumination:
    sky_model: str = "overcast"
    directions: int = 32
    shadow_distance: int = 100
    shadow: bool = False
    shadow_azimuth: float = 315.0
    shadow_elevation: float = 35.0

    def __post_init__(self):
        require(self.sky_model in ("overcast", "uniform"), "sky model must be overcast or uniform")
        require(self.directions > 0, "directions must be > 0")
        require(self.shadow_distance > 0, "shadow distance must be > 0")
        require(0 <= self.shadow_azimuth <= 360, "sun azimuth must be in [0, 360]")
        require(0 <= self.shadow_elevation <= 90, "sun elevation must be in [0, 90]")


@dataclass(frozen=True)
class LocalDominance:
    min_radius: int = 10
    max_radius: int = 20
    increment: int = 1
    angle: int = 15
    observer_height: float = 1.7

    def __post_init__(self):
        require(0 < self.min_radius <= self.max_radius, "local dominance radius range is invalid")
        require(self.increment > 0, "radius increment must be > 0")
        require(0 < self.angle <= 180, "angular resolution must be in (0, 180]")
        require(self.observer_height >= 0, "observer height must be >= 0")


@dataclass(frozen=True)
class Msrm:
    feature_min: float = 1.0
    feature_max: float = 20.0
    scaling: int = 2

    def __post_init__(self):
        require(0 < self.feature_min < self.feature_max, "msrm feature range is invalid")
        require(self.scaling > 0, "scaling factor must be > 0")


@dataclass(frozen=True)
class Mstp:
    local: tuple[int, int, int] = (1, 5, 1)
    meso: tuple[int, int, int] = (5, 50, 5)
    broad: tuple[int, int, int] = (50, 500, 50)
    lightness: float = 0.9

    def __post_init__(self):
        for low, high, step in (self.local, self.meso, self.broad):
            require(0 < low <= high, "invalid MSTP radius range")
            require(step > 0, "step must be > 0")
        require(self.lightness > 0, "lightness must be > 0")


@dataclass(frozen=True)
class Vat:
    terrain: str = "combined"
    opacity: float = 50.0

    def __post_init__(self):
        require(self.terrain in ("general", "flat", "combined"), "terrain must be general, flat or combined")
        require(0 <= self.opacity <= 100, "opacity must be in [0, 100]")


@dataclass(frozen=True)
class Product:
    parameters: type
    buffer: Callable  # (parameters, grid) -> pixels at least
    run: Callable  # (cells, tiling, parameters, exaggeration) -> DataFrame with x, y and the bands
    bands: Callable = lambda p: ["v"]


def _sky(column: str, invert: bool = False):
    return lambda c, t, p, e: directional.sky_view(c, t, p.directions, p.radius, p.noise, p.anisotropy_direction, p.anisotropy_level, invert).select("x", "y", F.col(column).alias("v"))


def _terrain(value):
    return lambda c, t, p, e: focal.slope_aspect(c, t.grid.res_x, t.grid.res_y, e).select("x", "y", value(p).alias("v"))


def _shadow(p: SkyIllumination):
    return (p.shadow_azimuth, p.shadow_elevation) if p.shadow else None


PRODUCTS = {
    "slope": Product(Slope, lambda p, g: 1, _terrain(lambda p: F.degrees("slope"))),
    "hillshade": Product(Hillshade, lambda p, g: 1, _terrain(lambda p: focal.shade(p.sun_azimuth, p.sun_elevation))),
    "multi-hillshade": Product(MultiHillshade, lambda p, g: 1, lambda c, t, p, e: focal.multi_hillshade(c, p.directions, p.sun_elevation, res_x=t.grid.res_x, res_y=t.grid.res_y, exaggeration=e), lambda p: [f"b{i}" for i in range(p.directions)]),
    "slrm": Product(Slrm, lambda p, g: p.radius, lambda c, t, p, e: focal.slrm(c, p.radius)),
    "svf": Product(SkyView, lambda p, g: p.radius, _sky("svf")),
    "asvf": Product(SkyView, lambda p, g: p.radius, _sky("asvf")),
    "positive-openness": Product(SkyView, lambda p, g: p.radius, _sky("openness")),
    "negative-openness": Product(SkyView, lambda p, g: p.radius, _sky("openness", True)),
    "sky-illumination": Product(SkyIllumination, lambda p, g: p.shadow_distance, lambda c, t, p, e: directional.sky_illumination(c, t, p.sky_model, p.directions, p.shadow_distance, _shadow(p))),
    "local-dominance": Product(LocalDominance, lambda p, g: p.max_radius, lambda c, t, p, e: directional.local_dominance(c, t, p.min_radius, p.max_radius, p.increment, p.angle, p.observer_height)),
    "msrm": Product(Msrm, lambda p, g: max(math.ceil(p.feature_max / min(g.res_x, g.res_y)), focal.msrm_radii(p.feature_min, p.feature_max, p.scaling, (g.res_x + g.res_y) / 2)[1]), lambda c, t, p, e: focal.msrm(c, p.feature_min, p.feature_max, p.scaling, (t.grid.res_x + t.grid.res_y) / 2)),
    "mstp": Product(Mstp, lambda p, g: p.broad[1], lambda c, t, p, e: focal.mstp(c, p.local, p.meso, p.broad, p.lightness), lambda p: ["red", "green", "blue"]),
    "vat": Product(Vat, lambda p, g: {"general": 10}.get(p.terrain, 20), lambda c, t, p, e: vat.vat(c, t, p.terrain, p.opacity)),
}


def choose(name: str) -> Product:
    found = PRODUCTS.get(name.strip().lower())
    if not found:
        raise ValueError(f"Unsupported product: {name} (expected: {', '.join(PRODUCTS)})")
    return found


def tiling_for(name: str, grid: Grid, size: int, parameters=None, buffer: int | None = None, window=None) -> Tiling:
    """A tiling whose buffer is what the product needs, or a larger one that was asked for."""
    product = choose(name)
    least = product.buffer(parameters or product.parameters(), grid)
    return Tiling(grid, size, max(least, buffer or 0), max(least, buffer or 0), window)


def render(name: str, cells: DataFrame, t: Tiling, parameters=None, exaggeration: float = 1.0, as_bytes: bool = False) -> DataFrame:
    """x, y and the product's bands in the tiling's area, as numbers or stretched to bytes."""
    from orogen.operators.grid import clip, tile_of

    product = choose(name)
    p = parameters or product.parameters()
    out = clip(product.run(cells, t, p, exaggeration), t.area)
    if not as_bytes:
        return out
    bands = product.bands(p)
    return zonal.product_bytes(out.withColumn("tile_id", tile_of(t)), name.strip().lower(), bands).select("x", "y", *bands)


def parameter_names(name: str) -> list[str]:
    return [f.name for f in fields(choose(name).parameters)]
