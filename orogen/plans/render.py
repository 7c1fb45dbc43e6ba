"""Layers of a style brought onto the first one's grid, met by tiles, and composed."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from orogen.operators import align, compose
from orogen.operators.grid import BBox, Grid, Window
from orogen.sources.geotiff import load, read_header, widened


def layered(rasters: dict[str, tuple[DataFrame, Grid]], style: list[tuple[str, str | None, compose.Layer]], window: Window | None = None) -> tuple[DataFrame, list[compose.Layer], Grid]:
    """All layers' cells as columns of one table on the first layer's grid, met in one exchange, and the layers naming these columns. Each (input, resampling) is aligned once."""
    target = rasters[style[0][0]][1]
    names: dict[tuple[str, str], str] = {}
    sources: dict[str, align.Source] = {}

    def column(source: str, resampling: str, label: str) -> str:
        cells, own = rasters[source]
        key = (source, "same" if align.same_grid(own, target) else resampling)
        if key not in names:
            names[key] = f"l{len(names)}"
            sources[names[key]] = align.Source(cells, own, key[1], label)
        return names[key]

    layers = []
    for i, (source, alpha, layer) in enumerate(style):
        value = column(source, layer.resampling, f"Layer {i} input")
        layers.append(replace(layer, column=value, alpha=column(alpha, layer.resampling, f"Layer {i} alpha input") if alpha else None))
    return align.on_grid(sources, target, window), layers, target


def needed(own: Grid, target: Grid, window: Window) -> Window | None:
    """The cells of a raster that the target's window can be made of; None for all, where the two do not meet."""
    try:
        return widened(own.snap(target.envelope(widened(window, 2, 2, target))), 2, 2, own)
    except ValueError:
        return None


def render(spark: SparkSession, style: list[tuple[str, str | None, compose.Layer]], box: BBox | None = None, with_alpha: bool = False) -> tuple[DataFrame, Grid, Window]:
    """Bytes of the composed bands (null in no cell), the grid they are on and the window of the box. Each file is opened once."""
    first = read_header(style[0][0]).grid
    window = first.snap(box) if box else first.whole
    rasters = {p: load(spark, p, window=needed(read_header(p).grid, first, window) if box else None) for p in dict.fromkeys(x for s in style for x in s[:2] if x)}
    table, layers, grid = layered(rasters, style, window)
    return compose.as_bytes(compose.compose(table, layers), with_alpha), grid, window
