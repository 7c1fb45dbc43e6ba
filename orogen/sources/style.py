"""Style documents: JSON to layers, with the checks and messages of the format."""

from __future__ import annotations

import json
import math
from pathlib import Path

from orogen.operators.compose import BLENDS, RESAMPLINGS, Layer, Stop
from orogen.plans.products import require

FIELDS = {"input", "alphaInput", "valueMin", "valueMax", "colorFrom", "colorTo", "stops", "blendMode", "opacity", "resampling"}


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def read_layer(spec: dict) -> tuple[str, str | None, Layer]:
    """Input, alpha input and layer of one entry; the layer's columns are to be named by the caller."""
    require(isinstance(spec, dict) and not set(spec) - FIELDS, f"Unknown layer fields: {sorted(set(spec) - FIELDS) if isinstance(spec, dict) else spec}")
    for k in ("input", "alphaInput", "colorFrom", "colorTo", "blendMode", "resampling"):
        require(spec.get(k) is None or isinstance(spec[k], str), f"{k} must be text")
    source = (spec.get("input") or "").strip()
    require(bool(source), "input is required")
    old = [spec.get(k) for k in ("valueMin", "valueMax", "colorFrom", "colorTo")]
    some, full, stops = any(v is not None for v in old), all(v is not None for v in old), spec.get("stops")
    require(not (some and stops is not None), "Layer must define either valueMin/valueMax/colorFrom/colorTo or stops, not both")
    require(some or stops is not None, "Layer must define either valueMin/valueMax/colorFrom/colorTo or stops")
    require(not some or full, "Legacy color ramps require valueMin, valueMax, colorFrom and colorTo")
    if some:
        low, high, start, end = old
        require(_number(low) and _number(high), "valueMin and valueMax must be numbers")
        require(math.isfinite(low) and math.isfinite(high), "valueMin and valueMax must be finite")
        require(low < high, "valueMin must be < valueMax")
        ramp = (Stop(low, start), Stop(high, end))
    else:
        require(isinstance(stops, list), "stops must be a list")
        require(len(stops) >= 2, "stops must contain at least two entries")
        require(all(s is not None for s in stops), "stops must not contain null entries")
        require(all(isinstance(s, dict) and _number(s.get("value")) and isinstance(s.get("color"), str) and (s.get("alpha") is None or _number(s["alpha"])) for s in stops), "stops must have a number as value, a color and, if any, a number as alpha")
        require(all(a["value"] < b["value"] for a, b in zip(stops, stops[1:])), "stop values must be strictly increasing")
        ramp = tuple(Stop(s["value"], s["color"], 1.0 if s.get("alpha") is None else s["alpha"]) for s in stops)
    mode = spec.get("blendMode")
    require(mode is not None, "blendMode is required")
    require(mode.strip().lower() in (*BLENDS, "soft-light"), f"Unsupported blendMode: {mode} (expected: normal, multiply, screen or softlight)")
    opacity = spec.get("opacity", 0.0)
    require(_number(opacity) and 0 <= opacity <= 1, "opacity must be in [0,1]")
    resampling = (spec.get("resampling") or "bilinear").strip().lower()
    require(resampling in RESAMPLINGS, f"Unsupported resampling: {spec.get('resampling')} (expected: bilinear, nearest or max)")
    alpha = (spec.get("alphaInput") or "").strip() or None
    return source, alpha, Layer("", ramp, mode, opacity, None, resampling)


def read_style(path: str) -> list[tuple[str, str | None, Layer]]:
    try:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ValueError(f"Invalid render style JSON: {e.msg}") from e
    layers = doc.get("layers") if isinstance(doc, dict) else None
    require(bool(layers) and isinstance(layers, list), "layers must contain at least one entry")
    return [read_layer(x) for x in layers]
