"""The GeoTIFF sink of the `georaster` format: tasks write parts beside the target, a commit makes them the result, an abort leaves nothing.

Cells come grouped by block (save() does that), so a task holds one block at a time. Every attempt of a task writes under names of its own, and only the attempts that Spark
commits count; whatever the others left goes with the folder of parts.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from dataclasses import asdict, dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from orogen.operators.grid import Grid, Tiling, Window, clip, tile_of
from orogen.sources import geotiff

COPIED = 1 << 24  # bytes of a part that are in memory at once


def is_local(path: str) -> bool:
    """Is path on a mounted file system, where places within a file can be written?"""
    return urlparse(path).scheme in ("", "file")


def file_system(path: str) -> tuple[FileSystem, str]:
    if is_local(path):
        return LocalFileSystem(), os.path.abspath(urlparse(path).path if path.startswith("file:") else path)
    return FileSystem.from_uri(path)


def remove(path: str) -> None:
    """Remove a file or folder, if it is there."""
    files, inner = file_system(path)
    kind = files.get_file_info(inner).type
    if kind == FileType.Directory:
        files.delete_dir(inner)
    elif kind == FileType.File:
        files.delete_file(inner)


@dataclass(frozen=True)
class Layout:
    """What is written: one file, or a file for each tile of side cells that has a value. by_tasks: parts are placed by save(), not by the commit. token: part of all names that do not stay."""

    grid: Grid
    area: Window
    side: int
    names: tuple[str, ...]
    single: bool
    as_bytes: bool = False
    nodata: float | None = None
    by_tasks: bool = False
    big: bool = False
    token: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def across(self) -> int:
        return -(-self.area.width // self.side)

    @property
    def down(self) -> int:
        return -(-self.area.height // self.side)

    def window(self, number: int) -> Window:
        """A block of a file has its full size, a tile ends with the area."""
        row, col = divmod(number, self.across)
        x, y = self.area.x + col * self.side, self.area.y + row * self.side
        return Window(x, y, self.side, self.side) if self.single else Window(x, y, min(self.side, self.area.end_x - x), min(self.side, self.area.end_y - y))

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Layout:
        spec = json.loads(text)
        return Layout(**spec | {"grid": Grid(**spec["grid"]), "area": Window(**spec["area"]), "names": tuple(spec["names"])})


@dataclass
class Written(WriterCommitMessage):
    """What one attempt of a task has written: a part file with numbers and sizes of its blocks in order, or tile files."""

    part: str
    blocks: list[tuple[int, int]]
    tiles: list[str]


def _place(grid: Grid, w: Window) -> Grid:
    e = grid.envelope(w)
    return Grid(w.width, w.height, e.min_x, e.min_y, grid.res_x, grid.res_y, grid.crs, grid.nodata)


def _bands(pdf: pd.DataFrame, names: tuple[str, ...], w: Window, as_bytes: bool, nodata: float) -> np.ndarray:
    out = np.full((len(names), w.height, w.width), 0 if as_bytes else nodata, np.uint8 if as_bytes else np.float32)
    for i, n in enumerate(names):
        v = pdf[n].to_numpy(dtype=np.float64)
        v = np.where(np.isnan(v), 0 if as_bytes else nodata, v)
        out[i, pdf["y"].to_numpy() - w.y, pdf["x"].to_numpy() - w.x] = v
    return out


def by_block(batches):
    """(number, cells) of every block of batches that are sorted by block."""
    held, number, done = [], None, set()
    for batch in batches:
        own = batch.column("block").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
        for start, end in zip(edges, edges[1:]):
            if end > start:
                if held and own[start] != number:
                    yield number, pa.Table.from_batches(held).to_pandas()
                    done.add(number)
                    held = []
                number = int(own[start])
                if number in done:
                    raise ValueError(f"tile {number}: its cells do not stand together")
                held.append(batch.slice(start, end - start))
    if held:
        yield number, pa.Table.from_batches(held).to_pandas()


class RasterWriter(DataSourceArrowWriter):
    """Writer of cells (block, x, y and the layout's names). path: a file, or the folder of tiles."""

    def __init__(self, path: str, layout: Layout):
        self.path, self.layout = path.rstrip("/"), layout
        self.parts = f"{self.path}.{layout.token}.parts" if layout.single else f"{self.path}/.{layout.token}"
        self.spare = f"{self.path}.{layout.token}.new"

    def write(self, iterator) -> Written:
        lay, at = self.layout, f"{self.parts}/{uuid.uuid4().hex}"
        files, inner = file_system(at)
        files.create_dir(os.path.dirname(inner) if lay.single else inner, recursive=True)
        said = Written(at, [], [])
        out = files.open_output_stream(inner) if lay.single else None
        try:
            for number, cells in by_block(iterator):
                try:
                    w = lay.window(number)
                    if lay.single:
                        for i, band in enumerate(_bands(cells, lay.names, w, lay.as_bytes, lay.grid.nodata)):
                            blob = geotiff.compress_block(band, lay.side)
                            out.write(blob)
                            said.blocks.append((i * lay.across * lay.down + number, len(blob)))
                    elif not cells[list(lay.names)].isna().all(axis=None):
                        row, col = divmod(number, lay.across)
                        name = geotiff.tile_name(number, col, row)
                        with files.open_output_stream(f"{inner}/{name}") as f:
                            f.write(geotiff.encode(_bands(cells, lay.names, w, lay.as_bytes, lay.grid.nodata), _place(lay.grid, w), lay.nodata))
                        said.tiles.append(name)
                except Exception as e:
                    raise RuntimeError(f"tile {number}: {e}") from e
        finally:
            if out:
                out.close()
        return said

    def commit(self, messages) -> None:
        (self.commit_single if self.layout.single else self.commit_tiles)([m for m in messages if m is not None])

    def commit_tiles(self, messages: list[Written]) -> None:
        names = [(m.part, n) for m in messages for n in m.tiles]
        self._refuse_twice([n for _, n in names])
        files, folder = file_system(self.path)
        files.create_dir(folder, recursive=True)
        for part, name in names:
            files.move(f"{file_system(part)[1]}/{name}", f"{folder}/{name}")
        remove(self.parts)

    def commit_single(self, messages: list[Written]) -> None:
        """Header and parts one after another; blocks without cells share one of sentinels. Where tasks are to place the parts, the header only and a list of what is to be placed where."""
        lay, sizes, lies, parts, at = self.layout, {}, {}, [], 0
        self._refuse_twice([n for m in messages for n, _ in m.blocks])
        for m in messages:
            parts.append((m.part, at, sum(s for _, s in m.blocks)))
            for number, size in m.blocks:
                sizes[number], lies[number] = size, at
                at += size
        total = lay.across * lay.down * len(lay.names)
        blank = b""
        if len(sizes) < total:
            blank = geotiff.compress_block(np.full((lay.side, lay.side), 0 if lay.as_bytes else lay.grid.nodata, np.uint8 if lay.as_bytes else np.float32), lay.side)
        numbers = range(total)
        head = geotiff.front(_place(lay.grid, lay.area), len(lay.names), lay.as_bytes, lay.nodata, lay.side, [sizes.get(n, len(blank)) for n in numbers], [lies.get(n, at) for n in numbers], lay.big)[0]
        files, spare = file_system(self.spare)
        if lay.by_tasks:
            with open(spare, "wb") as f:
                f.write(head)
                f.seek(len(head) + at)
                f.write(blank)
                f.truncate(len(head) + at + len(blank))
            with files.open_output_stream(f"{file_system(self.parts)[1]}/list") as f:
                f.write(json.dumps([(part, len(head) + start, size) for part, start, size in parts if size]).encode())
            return
        with files.open_output_stream(spare) as out:
            out.write(head)
            for part, _, size in parts:
                with files.open_input_stream(file_system(part)[1]) as f:
                    while data := f.read(COPIED):
                        out.write(data)
            out.write(blank)
        files.move(spare, file_system(self.path)[1])
        remove(self.parts)

    def _refuse_twice(self, numbers: list) -> None:
        if len(set(numbers)) < len(numbers):
            self.abort([])
            raise ValueError("cells of one block came in several tasks: deal them out by block")

    def abort(self, messages) -> None:
        remove(self.parts)
        remove(self.spare)


def put(part: str, place: str, at: int) -> None:
    """Copy a part to its place within a file; to do so twice changes nothing."""
    with open(file_system(part)[1], "rb") as source, open(place, "r+b") as f:
        f.seek(at)
        shutil.copyfileobj(source, f, COPIED)


def _placed_by_tasks(spark: SparkSession, writer: RasterWriter) -> None:
    files, spare = file_system(writer.spare)
    folder = file_system(writer.parts)[1]
    with files.open_input_stream(f"{folder}/list") as f:
        parts = json.loads(f.read())

    def run(batches):
        for b in batches:
            for part, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                put(part, spare, at)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    if parts:
        where = spark.createDataFrame([tuple(p[:2]) for p in parts], "part string, at long").repartition(len(parts))
        where.mapInArrow(run, "n long").agg(F.sum("n")).first()
    os.replace(spare, file_system(writer.path)[1])
    remove(writer.parts)


def save(cells: DataFrame, layout: Layout, path: str) -> None:
    """Write cells (x, y and the layout's names) as GeoTIFF at path, dealt out by block.

    One file: each task compresses the blocks it holds into a part beside the target, and their sizes give every part its place; on a mounted file system tasks put the parts there,
    elsewhere the commit streams them one after another. The target is not touched before all is done. Sizes over 4 GB make a BigTIFF.
    """
    spark = cells.sparkSession
    register(spark)
    block = (F.floor((F.col("y") - layout.area.y) / layout.side) * layout.across + F.floor((F.col("x") - layout.area.x) / layout.side)).cast("long").alias("block")
    placed = clip(cells, layout.area).select(block, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *(F.col(n).cast("double").alias(n) for n in layout.names))
    files, inner = file_system(path)
    files.create_dir(os.path.dirname(inner) if layout.single else inner, recursive=True)
    writer = RasterWriter(path, layout)
    try:
        placed.repartition("block").sortWithinPartitions("block").write.format("georaster").option("layout", layout.to_json()).mode("append").save(path)
        if layout.by_tasks:
            _placed_by_tasks(spark, writer)
    except BaseException:
        writer.abort([])
        raise


def register(spark: SparkSession) -> SparkSession:
    from orogen.shipping import ship

    ship(spark).dataSource.register(geotiff.RasterSource)
    return spark


def write_tiles(cells: DataFrame, t: Tiling, names: list[str], folder: str, as_bytes: bool = False, nodata_tag: float | None = None, start: int = 0) -> int:
    """One GeoTIFF for each tile that has a value, from tile number start on; returns how many files the folder has under such names then."""
    layout = Layout(t.grid, t.area, t.size, tuple(names), False, as_bytes, nodata_tag)
    save(clip(cells, t.area).withColumn("_tile", tile_of(t)).where(f"_tile >= {start}").drop("_tile") if start else cells, layout, folder)
    return len(tile_files(folder))


def tile_files(folder: str) -> list[str]:
    """Names of the GeoTIFFs of a folder."""
    files, inner = file_system(folder)
    return sorted(i.base_name for i in files.get_file_info(FileSelector(inner)) if i.type == FileType.File and i.base_name.lower().endswith((".tif", ".tiff")))


def write_single(cells: DataFrame, t: Tiling, names: list[str], path: str, as_bytes: bool = False, nodata_tag: float | None = None, big: bool = False) -> str:
    """One GeoTIFF of the whole area; returns its path. big: a BigTIFF whatever its size."""
    side = geotiff.block_side(t.size, t.area.width, t.area.height)
    save(cells, Layout(t.grid, t.area, side, tuple(names), True, as_bytes, nodata_tag, is_local(path), big), path)
    return path
