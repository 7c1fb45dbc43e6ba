"""GeoTIFF as a Spark source, and the format's bytes; the sink is in sink.py. Blocks are read by tasks, the header by the driver.

Read: one band, tiles or strips, uncompressed, Deflate, LZW, PackBits or ZSTD, integers or floats of any usual width, full resolution only, from a path or
by HTTP ranges. Written: tiled, Deflate, float32 or uint8, any number of bands, with 64-bit offsets where 32 do not do.
"""

from __future__ import annotations

import http.client
import itertools
import json
import math
import random
import re
import struct
import time
import urllib.request
import zlib
from dataclasses import asdict, dataclass, replace
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from orogen.operators.grid import BBox, Grid, Window
from orogen.sources.codecs import KNOWN, decompress

# Fixed values of the format: tag numbers, and by type number the size and struct code of a value.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, SAMPLE_FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
SCALE, TIEPOINT, TRANSFORM, KEYS, PARAMETERS, ASCII_KEYS, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
# EPSG codes of projected systems in feet (state planes of NAD83, of NAD83(HARN) and of NAD27, Michigan's of NAD27, and NAD27's offshore zones).
FOOT_SYSTEMS = ((2222, 2289), (2867, 2930), (26729, 26799), (26801, 26803), (32001, 32058), (32064, 32067))
ATTEMPTS, DELAY = 3, 1.0
LARGEST = 1 << 32  # bytes that a file with 32-bit offsets can have
GROUP = 1 << 22  # cells of the neighbouring blocks that one task reads at most
TASKS = 256  # up to so many blocks each are a task of their own


def is_remote(path: str) -> bool:
    return urlparse(path).scheme in ("http", "https")


def read_range(path: str, start: int, size: int, sleep=time.sleep) -> bytes:
    """Bytes of a file; of a remote one by a range request, tried three times with growing, jittered delays."""
    if not is_remote(path):
        with open(urlparse(path).path if path.startswith("file:") else path, "rb") as f:
            f.seek(start)
            return f.read(size)
    for attempt in range(1, ATTEMPTS + 1):
        try:
            ask = urllib.request.Request(path, headers={"Range": f"bytes={start}-{start + size - 1}"})
            with urllib.request.urlopen(ask, timeout=60) as r:
                data = r.read()
                return data if r.status == 206 else data[start : start + size]
        except (OSError, http.client.HTTPException):
            if attempt == ATTEMPTS:
                raise
            sleep(DELAY * 2 ** (attempt - 1) * random.uniform(0.75, 1.25))
    raise AssertionError


@dataclass(frozen=True)
class Header:
    """A raster's grid and the layout of its blocks in the file."""

    grid: Grid
    order: str
    block_width: int
    block_height: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    dtype: str
    compression: int
    predictor: int
    tiled: bool

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.block_width)


def read_header(path: str) -> Header:
    """Parse and check the first directory of a file."""
    head = read_range(path, 0, 1 << 16)
    order = {b"II": "<", b"MM": ">"}.get(head[:2])
    if not order:
        raise ValueError(f"Not a TIFF file: {path}")
    magic = struct.unpack_from(order + "H", head, 2)[0]
    big = magic == 43

    def at(offset: int, size: int) -> bytes:
        return head[offset : offset + size] if offset + size <= len(head) else read_range(path, offset, size)

    first = struct.unpack(order + ("Q" if big else "I"), at(8 if big else 4, 8 if big else 4))[0]
    n = struct.unpack(order + ("Q" if big else "H"), at(first, 8 if big else 2))[0]
    step, inline = (20, 8) if big else (12, 4)
    table = at(first + (8 if big else 2), n * step)
    tags: dict[int, tuple] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + ("HHQ" if big else "HHI"), table, i * step)
        if kind not in TYPES:
            continue
        size = TYPES[kind][0] * count
        where = i * step + step - inline
        raw = table[where : where + size] if size <= inline else at(struct.unpack_from(order + ("Q" if big else "I"), table, where)[0], size)
        tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + TYPES[kind][1] * count, raw)

    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("Only single-band DSM rasters are supported.")
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        if m[1] or m[4]:
            raise ValueError("Rotated or sheared rasters are not supported.")
        res_x, res_y, left, top = m[0], -m[5], m[3], m[7]
    elif SCALE in tags and TIEPOINT in tags:
        res_x, res_y = tags[SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT][:6]
        left, top = x - i * res_x, y + j * res_y
    else:
        raise ValueError("Raster has no georeference.")
    if res_x <= 0 or res_y <= 0:
        raise ValueError("Only north-up rasters with positive X and negative Y scale are supported.")
    keys = tags.get(KEYS, ())
    geo = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    if 3072 not in geo:
        raise ValueError("Only projected rasters with metre units are supported." if 2048 in geo else "Raster CRS is missing or invalid.")
    said = tags.get(ASCII_KEYS, ("",))[0]
    feet = any(low <= geo[3072] <= high for low, high in FOOT_SYSTEMS) or re.search(r"foot|feet|\bft", said, re.IGNORECASE)
    if geo.get(3076, 9001) != 9001 or 3076 not in geo and feet:
        raise ValueError("Only projected rasters with metre units are supported.")
    if geo.get(1025) == 2:  # the tie is a cell's centre
        left, top = left - res_x / 2, top + res_y / 2
    crs = f"EPSG:{geo[3072]}" if geo[3072] != 32767 else f"USER:{zlib.crc32(repr((sorted(geo.items()), said, tags.get(PARAMETERS))).encode())}"
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    tiled = TILES in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (width, min(height, tags.get(ROWS_PER_STRIP, (height,))[0]))
    bits, form = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    compression = tags.get(COMPRESSION, (1,))[0]
    if bits not in (8, 16, 32, 64) or form not in (1, 2, 3) or compression not in KNOWN:
        raise ValueError(f"Unsupported sample layout or compression ({bits} bits, format {form}, compression {compression}).")
    try:
        nodata = float(tags[NODATA][0].strip()) if NODATA in tags else math.nan
    except ValueError:
        nodata = math.nan
    grid = Grid(width, height, left, top - height * res_y, res_x, res_y, crs, nodata, path)
    return Header(grid, order, bw, bh, tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], f"{order}{'?uif'[form]}{bits // 8}", compression, tags.get(PREDICTOR, (1,))[0], tiled)


def read_block(h: Header, number: int, offset: int | None = None, size: int | None = None) -> tuple[Window, np.ndarray]:
    """A block's window in the raster and its values as float32, NaN where missing. offset and size: its place in the file, if the header has been sent without."""
    offset, size = h.offsets[number] if offset is None else offset, h.sizes[number] if size is None else size
    x, y = number % h.across * h.block_width, number // h.across * h.block_height
    w, rows = min(h.block_width, h.grid.width - x), min(h.block_height, h.grid.height - y)
    stored = h.block_height if h.tiled else rows
    kind = np.dtype(h.dtype)
    if size:
        raw = read_range(h.grid.source, offset, size)
        raw = decompress(raw, h.compression, stored * h.block_width * kind.itemsize)
        if h.predictor == 3:
            planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(stored, -1), axis=1, dtype=np.uint8).reshape(stored, kind.itemsize, h.block_width)
            data = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{kind.itemsize}")[:, :, 0]
        else:
            data = np.frombuffer(raw, kind)[: stored * h.block_width].reshape(stored, h.block_width)
            data = np.cumsum(data, axis=1, dtype=data.dtype) if h.predictor == 2 else data
    else:
        data = np.full((stored, h.block_width), h.grid.nodata)
    values = data[:rows, :w].astype(np.float32)
    if h.grid.nodata == h.grid.nodata:
        values[np.abs(values - np.float64(h.grid.nodata)) <= 1e-6] = np.nan
    return Window(x, y, w, rows), values


class RasterSource(DataSource):
    """spark.read.format("georaster"): x, y, z of a GeoTIFF, or of all GeoTIFFs of a folder as one raster (option mosaic: its grid, as load_tiles gives it).

    Option bbox keeps the pixels that a box touches, option window those of a window (x,y,width,height); bounds on x and y in a where() do the same if
    spark.sql.python.filterPushdown.enabled is set (load sets it). Only blocks that are in all of these are read. Writing: see orogen.sources.sink.
    """

    @classmethod
    def name(cls) -> str:
        return "georaster"

    def schema(self) -> str:
        return "x int, y int, z double"

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(self.options["path"], self.options.get("bbox"), self.options.get("window"), self.options.get("mosaic"))

    def writer(self, schema, overwrite):
        from orogen.sources import sink

        return sink.RasterWriter(self.options["path"], sink.Layout.from_json(self.options["layout"]))


def narrowed(w: Window, f: Filter) -> Window | None:
    """The part of a window that a bound on x or y leaves, which may have no cell; None where the filter is another one."""
    if getattr(f, "attribute", None) not in (("x",), ("y",)) or not isinstance(getattr(f, "value", None), (int, float)):
        return None
    low, high = -math.inf, math.inf
    match f:
        case EqualTo():
            low = high = f.value
        case GreaterThan():
            low = math.floor(f.value) + 1
        case GreaterThanOrEqual():
            low = math.ceil(f.value)
        case LessThan():
            high = math.ceil(f.value) - 1
        case LessThanOrEqual():
            high = math.floor(f.value)
        case _:
            return None
    if f.attribute == ("x",):
        start, end = max(w.x, low), min(w.end_x - 1, high)
        return replace(w, x=int(min(start, w.end_x)), width=int(max(0, end - start + 1)))
    start, end = max(w.y, low), min(w.end_y - 1, high)
    return replace(w, y=int(min(start, w.end_y)), height=int(max(0, end - start + 1)))


def _cells(h: Header, w: Window, number: int, offset: int, size: int, dx: int = 0, dy: int = 0):
    """Cells of a block that are in a window, moved by dx and dy."""
    at, values = read_block(h, number, offset, size)
    x0, x1, y0, y1 = max(at.x, w.x), min(at.end_x, w.end_x), max(at.y, w.y), min(at.end_y, w.end_y)
    part = values[y0 - at.y : y1 - at.y, x0 - at.x : x1 - at.x].astype(np.float64).ravel()
    ys, xs = np.divmod(np.arange(part.size), max(1, x1 - x0))
    z = pa.array(part, mask=np.isnan(part))
    return pa.RecordBatch.from_arrays([pa.array((xs + x0 + dx).astype(np.int32)), pa.array((ys + y0 + dy).astype(np.int32)), z], ["x", "y", "z"])


def _blocks(h: Header, w: Window) -> list[tuple[int, int, int]]:
    """Number, offset and size of the blocks that a window touches."""
    if w.width <= 0 or w.height <= 0:
        return []
    numbers = [r * h.across + c for r in range(w.y // h.block_height, -(-w.end_y // h.block_height)) for c in range(w.x // h.block_width, -(-w.end_x // h.block_width))]
    return [(n, h.offsets[n], h.sizes[n]) for n in numbers]


class RasterReader(DataSourceReader):
    def __init__(self, path: str, bbox: str | None, window: str | None = None, mosaic: str | None = None):
        self.path, self.header = path, None if mosaic else read_header(path)
        self.grid = Grid(**json.loads(mosaic)) if mosaic else self.header.grid
        self.window = self.grid.snap(BBox.parse(bbox)) if bbox else Window(*map(int, window.split(","))) if window else self.grid.whole

    def pushFilters(self, filters):
        for f in filters:
            left = narrowed(self.window, f)
            if left is None:
                yield f
            else:
                self.window = left

    def partitions(self):
        if self.header is None:
            from orogen.sources.sink import tile_files

            names = tile_files(self.path) if self.window.width > 0 and self.window.height > 0 else []
            each = max(1, len(names) // TASKS)
            return [InputPartition([f"{self.path.rstrip('/')}/{n}" for n in names[i : i + each]]) for i in range(0, len(names), each)] or [InputPartition([])]
        blocks = _blocks(self.header, self.window)
        at_once = max(1, min(GROUP // (self.header.block_width * self.header.block_height), len(blocks) // TASKS))
        self.header = replace(self.header, offsets=(), sizes=())  # each task gets the places of its own blocks only
        return [InputPartition(blocks[i : i + at_once]) for i in range(0, len(blocks), at_once)] or [InputPartition([])]

    def read(self, partition):
        w = self.window
        for item in partition.value:
            if self.header is not None:
                yield _cells(self.header, w, *item)
                continue
            h = read_header(item)
            dx, dy = (round(v) for v in ((h.grid.min_x - self.grid.min_x) / self.grid.res_x, (self.grid.max_y - h.grid.max_y) / self.grid.res_y))
            x, y = max(0, w.x - dx), max(0, w.y - dy)
            own = Window(x, y, min(h.grid.width, w.end_x - dx) - x, min(h.grid.height, w.end_y - dy) - y)
            for block in _blocks(h, own):
                yield _cells(h, own, *block, dx, dy)


def _reader(spark: SparkSession):
    from orogen.shipping import ship

    ship(spark).dataSource.register(RasterSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("georaster")


def load_tiles(spark: SparkSession, folder: str) -> tuple[DataFrame, Grid]:
    """Cells and grid of a folder of GeoTIFFs with one resolution, system and sentinel, as one raster; one scan however many files there are. Tasks read the files' headers."""
    from orogen.sources.sink import tile_files

    names = tile_files(folder)
    if not names:
        raise ValueError(f"No GeoTIFF in {folder}")

    def run(batches):
        for b in batches:
            grids = [read_header(f"{folder.rstrip('/')}/{n}").grid for n in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"min_x": g.min_x, "min_y": g.min_y, "max_x": g.min_x + g.width * g.res_x, "max_y": g.max_y, "like": json.dumps([g.res_x, g.res_y, g.crs, g.nodata])} for g in grids], pa.schema([(k, pa.float64()) for k in ("min_x", "min_y", "max_x", "max_y")] + [("like", pa.string())]))

    reader = _reader(spark)
    found = spark.createDataFrame([(n,) for n in names], "name string").mapInArrow(run, "min_x double, min_y double, max_x double, max_y double, like string")
    r = found.agg(F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.min("like").alias("like"), F.max("like").alias("other")).first()
    if r.like != r.other:
        raise ValueError(f"The files of {folder} differ in resolution, system or sentinel.")
    res_x, res_y, crs, nodata = json.loads(r.like)
    grid = Grid(round((r.max_x - r.min_x) / res_x), round((r.max_y - r.min_y) / res_y), r.min_x, r.min_y, res_x, res_y, crs, nodata, folder)
    return reader.option("mosaic", json.dumps(asdict(grid))).load(folder), grid


def load(spark: SparkSession, path: str, bbox: BBox | None = None, window: Window | None = None) -> tuple[DataFrame, Grid]:
    """Cells and grid of a GeoTIFF; places count from the whole raster's corner, with or without a box or a window."""
    reader = _reader(spark)
    if bbox:
        reader = reader.option("bbox", f"{bbox.min_x},{bbox.min_y},{bbox.max_x},{bbox.max_y}")
    if window:
        reader = reader.option("window", f"{window.x},{window.y},{window.width},{window.height}")
    return reader.load(path), read_header(path).grid


def widened(w: Window, x: int, y: int, grid: Grid) -> Window:
    """A window with a margin, within the raster."""
    low_x, low_y = max(0, w.x - x), max(0, w.y - y)
    return Window(low_x, low_y, min(grid.width, w.end_x + x) - low_x, min(grid.height, w.end_y + y) - low_y)


def compress_block(part: np.ndarray, side: int) -> bytes:
    tile = np.zeros((side, side), part.dtype)
    tile[: part.shape[0], : part.shape[1]] = part
    return zlib.compress(tile.astype(tile.dtype.newbyteorder("<")).tobytes())


def block_side(size: int, width: int, height: int) -> int:
    """Side of the written blocks: the tile size, or what holds the raster, as a multiple of 16."""
    return max(16, -(-min(size, max(width, height)) // 16) * 16)


def front(grid: Grid, n: int, as_bytes: bool, nodata: float | None, side: int, sizes: list[int], lies: list[int] | None = None, big: bool = False) -> tuple[bytes, list[int]]:
    """All of a file before its blocks, given their compressed sizes band by band and row by row, and where each lies after it (one after another without); and the blocks' offsets.

    A file that 32-bit offsets cannot address gets a 64-bit directory (BigTIFF), and any other one if big.
    """
    lies = list(itertools.accumulate(sizes, initial=0))[:-1] if lies is None else lies
    epsg = int(grid.crs.split(":")[-1]) if grid.crs.startswith("EPSG:") else 32767
    form, bits = (1, 8) if as_bytes else (3, 32)
    entries: list[tuple[int, int, list]] = [
        (WIDTH, 4, [grid.width]), (HEIGHT, 4, [grid.height]), (BITS, 3, [bits] * n), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [2 if n >= 3 and as_bytes else 1]), (SAMPLES, 3, [n]), (PLANAR, 3, [2 if n > 1 else 1]),
        (TILE_WIDTH, 3, [side]), (TILE_HEIGHT, 3, [side]), (TILES, 4, [0] * len(sizes)), (TILE_BYTES, 4, sizes), (SAMPLE_FORMAT, 3, [form] * n),
        (SCALE, 12, [grid.res_x, grid.res_y, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, grid.min_x, grid.max_y, 0.0]), (KEYS, 3, [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]),
    ]
    if n == 4 and as_bytes:
        entries.append((338, 3, [2]))
    if nodata is not None and nodata == nodata:
        entries.append((NODATA, 2, [f"{nodata:g}\0".encode()]))
    entries.sort(key=lambda e: e[0])
    wide = lambda tag, kind: 16 if big and tag == TILES else kind
    for big in (True,) if big else (False, True):
        first, step, inline = (16, 20, 8) if big else (8, 12, 4)
        extra_at = first + (8 if big else 2) + step * len(entries) + (8 if big else 4)
        size = sum((len(v[0]) if k == 2 else TYPES[wide(t, k)][0] * len(v)) + 7 for t, k, v in entries) + 8
        offsets = [extra_at + size + at for at in lies]
        if max((o + s for o, s in zip(offsets, sizes)), default=0) < LARGEST:
            break
    table, extra = b"", b""
    for tag, kind, values in entries:
        kind, values = wide(tag, kind), offsets if tag == TILES else values
        raw = values[0] if kind == 2 else struct.pack("<" + TYPES[kind][1] * len(values), *values)
        count = len(raw) if kind == 2 else len(values)
        table += struct.pack("<HHQ" if big else "<HHI", tag, kind, count)
        if len(raw) <= inline:
            table += raw.ljust(inline, b"\0")
        else:
            extra += b"\0" * (-len(extra) % 8)
            table += struct.pack("<Q" if big else "<I", extra_at + len(extra))
            extra += raw
    start = b"II" + struct.pack("<HHHQQ", 43, 8, 0, first, len(entries)) if big else b"II" + struct.pack("<HIH", 42, first, len(entries))
    return start + table + bytes(8 if big else 4) + extra.ljust(size, b"\0"), offsets


def encode(bands: np.ndarray, grid: Grid, nodata: float | None, size: int = 256) -> bytes:
    """A GeoTIFF file of bands (n, height, width), float32 or uint8, in Deflate tiles."""
    n, height, width = bands.shape
    side = block_side(size, width, height)
    blobs = [compress_block(bands[b, y : y + side, x : x + side], side) for b in range(n) for y in range(0, height, side) for x in range(0, width, side)]
    return front(grid, n, bands.dtype == np.uint8, nodata, side, list(map(len, blobs)))[0] + b"".join(blobs)


def tile_name(number: int, column: int, row: int) -> str:
    return f"{number:08d}_tile_{column:05d}_{row:05d}.tif"
