"""Light of sky and sun."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class Lighting:
    """Powers of ambient light, sky and sun; the sun's place and angular diameter in degrees; rays per cell, bounces and the bias of their elevation."""

    rays: int = 1024
    bounces: int = 0
    bias: float = 1.0
    ambient: float = 0.0
    sky: float = 1.0
    sun: float = 0.0
    azimuth: float = 0.0
    elevation: float = 45.0
    diameter: float = 11.4

    def __post_init__(self):
        if self.rays <= 0 or self.bounces < 0 or self.bias <= 0:
            raise ValueError("Rays and bias must be positive and bounces not negative.")
        if min(self.ambient, self.sky, self.sun) < 0:
            raise ValueError("Light powers must not be negative.")
        if not 0 <= self.azimuth <= 360 or not 0 <= self.elevation <= 90 or self.diameter < 0:
            raise ValueError("Sun azimuth must lie in 0..360, elevation in 0..90, and its diameter not be negative.")

    def sun_direction(self) -> tuple[float, float, float]:
        az, el = math.radians(self.azimuth), math.radians(self.elevation)
        return math.cos(el) * math.sin(az), -math.cos(el) * math.cos(az), math.sin(el)
