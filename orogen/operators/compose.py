"""Colour ramps and layer compositing, cell by cell in single precision."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.functions.numbers import to_byte

BLENDS = ("normal", "multiply", "screen", "softlight")
RESAMPLINGS = ("bilinear", "nearest", "max")
_COLOR = re.compile(r"#([0-9a-fA-F]{2})([0-9a-fA-F]{2})([0-9a-fA-F]{2})")


def parse_color(text: str) -> tuple[int, int, int]:
    m = _COLOR.fullmatch(text or "")
    if not m:
        raise ValueError(f"Invalid color '{text}': expected #RRGGBB.")
    return tuple(int(p, 16) for p in m.groups())


def hex_color(rgb: tuple[int, int, int]) -> str:
    return "#%02X%02X%02X" % tuple(rgb)


@dataclass(frozen=True)
class Stop:
    value: float
    color: str
    alpha: float = 1.0

    def __post_init__(self):
        parse_color(self.color)
        if not 0 <= self.alpha <= 1:
            raise ValueError("Stop alpha must be between 0 and 1.")


@dataclass(frozen=True)
class Layer:
    """A layer of a style: its ramp, blend mode, opacity and resampling. column and alpha name the cells' columns."""

    column: str
    stops: tuple[Stop, ...]
    blend: str = "normal"
    opacity: float = 1.0
    alpha: str | None = None
    resampling: str = "bilinear"

    def __post_init__(self):
        blend = {"soft-light": "softlight"}.get(self.blend.strip().lower(), self.blend.strip().lower())
        object.__setattr__(self, "blend", blend)
        if blend not in BLENDS:
            raise ValueError(f"Unknown blend mode '{self.blend}'. Allowed: {', '.join(BLENDS)}.")
        if self.resampling not in RESAMPLINGS:
            raise ValueError(f"Unknown resampling '{self.resampling}'. Allowed: {', '.join(RESAMPLINGS)}.")
        if not 0 <= self.opacity <= 1:
            raise ValueError("Opacity must be between 0 and 1.")
        if len(self.stops) < 2:
            raise ValueError("A ramp needs at least two stops.")
        if any(a.value >= b.value for a, b in zip(self.stops, self.stops[1:])):
            raise ValueError("Stop values must be strictly increasing.")


def legacy(column: str, low: float, high: float, start: str, end: str, **more) -> Layer:
    """A layer whose ramp runs from one colour to another between two values."""
    return Layer(column, (Stop(low, start), Stop(high, end)), **more)


def _f(x: Column | float) -> Column:
    """Back to single precision: the reference result depends on it at exact halves."""
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _channels(s: Stop) -> list[float]:
    return [c / 255 for c in parse_color(s.color)] + [s.alpha]


def ramp(value: Column, stops: tuple[Stop, ...], channel: int) -> Column:
    """The ramp's red, green, blue or alpha (channel 0 to 3) at a value; before the first and after the last stop theirs."""
    v, at = _f(value), [_f(_channels(s)[channel]) for s in stops]
    out = F.when(v <= _f(stops[0].value), at[0])
    for (a, b), (low, high) in zip(zip(stops, stops[1:]), zip(at, at[1:])):
        width = _f(_f(b.value) - _f(a.value))
        t = _f(_f(v - _f(a.value)) / width)
        out = out.when(v < _f(b.value), _f(low + _f(_f(high - low) * t))).when(v == _f(b.value), high)
    return out.otherwise(at[-1])


def _unit(c: Column) -> Column:
    return F.greatest(_f(0.0), F.least(_f(1.0), c))


def to_linear(v: Column) -> Column:
    c = _unit(v)
    curve = F.pow(_f(_f(c + _f(0.055)) / _f(1.055)).cast("double"), _f(2.4).cast("double"))
    return F.when(c <= _f(0.04045), _f(c / _f(12.92))).otherwise(_f(curve))


def to_srgb(v: Column) -> Column:
    c = _unit(v)
    power = _f(_f(1.0) / _f(2.4)).cast("double")
    curve = _f(1.055).cast("double") * F.pow(c.cast("double"), power) - _f(0.055).cast("double")
    return F.when(c <= _f(0.0031308), _f(_f(12.92) * c)).otherwise(_f(curve))


def blend(mode: str, s: Column, b: Column) -> Column:
    """The blended colour of a channel, before opacity: of encoded values, or for screen and soft light of linear ones."""
    if mode == "normal":
        return s
    if mode == "multiply":
        return _f(s * b)
    one, two = _f(1.0), _f(2.0)
    if mode == "screen":
        return _f(one - _f(_f(one - s) * _f(one - b)))
    dark = _f(b - _f(_f(_f(one - _f(two * s)) * b) * _f(one - b)))
    d = F.when(b <= _f(0.25), _f(_f(_f(_f(_f(_f(16.0) * b) - _f(12.0)) * b) + _f(4.0)) * b)).otherwise(_f(F.sqrt(b.cast("double"))))
    light = _f(b + _f(_f(_f(two * s) - one) * _f(d - b)))
    return F.when(s <= _f(0.5), dark).otherwise(light)


def compose(cells: DataFrame, layers: list[Layer]) -> DataFrame:
    """x, y, red, green, blue, alpha (floats from 0 to 1): the layers one over another in order, over nothing.

    A missing value leaves its layer out; a missing alpha hides it; the blended colour is not weighted by what lies below.
    """
    one = _f(1.0)
    d = cells.select("*", *(_f(0.0).alias(f"_{c}") for c in "rgba"))
    for layer in layers:
        v = F.col(layer.column)
        a = _f(ramp(v, layer.stops, 3) * _f(layer.opacity))
        if layer.alpha:
            a = F.when(F.col(layer.alpha).isNull(), _f(0.0)).otherwise(_f(a * _unit(_f(F.col(layer.alpha)))))
        # A projection per step, so that no step's expression is spelled out again inside the next one's.
        d = d.select("*", F.when(v.isNotNull(), a).otherwise(_f(0.0)).alias("_sa"), *(ramp(v, layer.stops, i).alias(f"_s{c}") for i, c in enumerate("rgb")))
        if layer.blend in ("screen", "softlight"):
            d = d.select("*", *(to_linear(F.col(f"_s{c}")).alias(f"_l{c}") for c in "rgb"), *(to_linear(F.col(f"_{c}")).alias(f"_d{c}") for c in "rgb"))
            d = d.select("*", *(blend(layer.blend, F.col(f"_l{c}"), F.col(f"_d{c}")).alias(f"_k{c}") for c in "rgb"))
            d = d.select("*", *(to_srgb(F.col(f"_k{c}")).alias(f"_m{c}") for c in "rgb"))
        else:
            d = d.select("*", *(blend(layer.blend, F.col(f"_s{c}"), F.col(f"_{c}")).alias(f"_m{c}") for c in "rgb"))
        sa, da = F.col("_sa"), F.col("_a")
        rest = _f(one - sa)
        d = d.select("*", _f(sa + _f(da * rest)).alias("_oa"))
        new = {}
        for c in "rgb":
            dst = F.col(f"_{c}")
            value = _f(_f(_f(F.col(f"_m{c}") * sa) + _f(_f(dst * da) * rest)) / F.col("_oa"))
            new[c] = F.when(sa <= 0, dst).otherwise(value)
        new["a"] = F.when(sa <= 0, da).otherwise(F.col("_oa"))
        d = d.select(*cells.columns, *(v.alias(f"_{c}") for c, v in new.items()))
    return d.select("x", "y", *(_unit(F.col(f"_{c}")).alias(n) for c, n in zip("rgba", ("red", "green", "blue", "alpha"))))


def as_bytes(composed: DataFrame, with_alpha: bool = False) -> DataFrame:
    """The composed bands as bytes."""
    names = ["red", "green", "blue"] + (["alpha"] if with_alpha else [])
    return composed.select("x", "y", *(to_byte(F.col(n)).alias(n) for n in names))
