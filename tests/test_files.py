import http.server
import json
import struct
import threading
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual

from orogen import cli
from orogen.operators.grid import BBox, Grid, Tiling, Window
from orogen.sources import codecs, geotiff, sink
from tests.helpers import BASE, MOUND, matrix


def put(path, rows, res=1.0, min_x=0.0, min_y=0.0, nodata=-9999.0, crs="EPSG:2056", size=16):
    m = np.array(rows, np.float32)
    path.write_bytes(geotiff.encode(m[None], Grid(m.shape[1], m.shape[0], min_x, min_y, res, res, crs, nodata), nodata, size))
    return str(path)


def all_bands(path):
    """Bands of a written file: the reader takes one, so each plane is read by hand."""
    data = open(path, "rb").read()
    import struct
    import zlib

    n = struct.unpack_from("<H", data, 8)[0]
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from("<HHI", data, 10 + 12 * i)
        size, code = geotiff.TYPES[kind]
        at = 10 + 12 * i + 8 if size * count <= 4 else struct.unpack_from("<I", data, 10 + 12 * i + 8)[0]
        tags[tag] = struct.unpack_from("<" + code * count, data, at) if kind != 2 else data[at : at + count]
    w, h, side, k = tags[256][0], tags[257][0], tags[322][0], tags[277][0]
    across, down = -(-w // side), -(-h // side)
    out = np.zeros((k, down * side, across * side), "<f4" if tags[258][0] == 32 else "u1")
    for i, (o, s) in enumerate(zip(tags[324], tags[325])):
        b, r = divmod(i, across * down)
        y, x = divmod(r, across)
        out[b, y * side : y * side + side, x * side : x * side + side] = np.frombuffer(zlib.decompress(data[o : o + s]), out.dtype).reshape(side, side)
    return out[:, :h, :w], tags


def test_round_trip_and_windows(spark, tmp_path):
    rows = np.arange(40 * 50, dtype=float).reshape(40, 50)
    rows[3, 4] = -9999
    path = put(tmp_path / "a.tif", rows, 2.0, 1000, 2000)
    cells, grid = geotiff.load(spark, path)
    assert (grid.width, grid.height, grid.min_x, grid.max_y, grid.res_x, grid.crs, grid.nodata) == (50, 40, 1000, 2080, 2.0, "EPSG:2056", -9999)
    rows[3, 4] = np.nan
    np.testing.assert_equal(matrix(cells, "z"), rows)
    part, _ = geotiff.load(spark, path, BBox(1011, 2003, 1019, 2041))
    got = part.collect()
    assert {(r.x, r.y) for r in got} == {(x, y) for x in range(5, 10) for y in range(19, 39)} and all(r.z == rows[r.y, r.x] for r in got)
    assert part.rdd.getNumPartitions() == 2
    (tmp_path / "two.tif").write_bytes(geotiff.encode(np.zeros((2, 3, 3), np.float32), grid, None))
    with pytest.raises(ValueError, match="single-band"):
        geotiff.read_header(str(tmp_path / "two.tif"))
    (tmp_path / "no.tif").write_bytes(b"nothing")
    with pytest.raises(ValueError, match="Not a TIFF"):
        geotiff.read_header(str(tmp_path / "no.tif"))


def test_ranges_with_retries(spark, tmp_path):
    put(tmp_path / "r.tif", [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14, 15, 16]])
    data, fails = (tmp_path / "r.tif").read_bytes(), [0]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            if fails[0]:
                fails[0] -= 1
                self.send_error(503)
                return
            a, b = map(int, self.headers["Range"][6:].split("-"))
            part = data[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, waits = f"http://127.0.0.1:{server.server_port}/r.tif", []
    cells, _ = geotiff.load(spark, url, BBox(1, 1, 3, 3))
    assert sorted(r.z for r in cells.collect()) == [6, 7, 10, 11]
    fails[0] = 2
    assert geotiff.read_range(url, 0, 4, waits.append) == data[:4]
    assert 0.75 <= waits[0] <= 1.25 and 1.5 <= waits[1] <= 2.5
    fails[0] = 3
    with pytest.raises(OSError):
        geotiff.read_range(url, 0, 4, waits.append)
    server.shutdown()


def test_commands(spark, tmp_path):
    mound = put(tmp_path / "m.tif", MOUND, size=16)
    box = ["--bbox", "0,0,6,6"]
    leaves = [["occlusion", "exact", "-r", "16"], ["occlusion", "horizon", "--horizon-directions", "8", "--horizon-radius-m", "2"], *(["rvt", p] for p in cli.products.PRODUCTS)]
    for leaf in leaves:
        extra = ["--broad-scale", "2,4,2", "--meso-scale", "2,3,1"] if leaf[1] == "mstp" else ["--shadow-distance", "3"] if leaf[1] == "sky-illumination" else []
        out = tmp_path / ("_".join(leaf[:2]) + ".tif")
        assert cli.main([*leaf, *extra, "--input", mound, *box, "--output-mode", "single-file", "--output", str(out), "--tile-size", "16"]) == 0
        bands, _ = all_bands(out)
        assert bands.shape == ({"multi-hillshade": 16, "mstp": 3}.get(leaf[1], 1), 6, 6) and np.isfinite(bands).all()
    tiles = tmp_path / "tiles"
    assert cli.main(["rvt", "slope", "--input", mound, *box, "--output", str(tiles), "--tile-size", "3", "--start-tile", "1", "--output-data-type", "uint8", "--info"]) == 0
    assert sorted(p.name for p in tiles.iterdir()) == [geotiff.tile_name(i, i % 2, i // 2) for i in (1, 2, 3)]
    whole, _ = all_bands(tmp_path / "rvt_slope.tif")
    one, tags = all_bands(tiles / geotiff.tile_name(3, 1, 1))
    np.testing.assert_array_equal(one[0], np.floor(np.clip(whole[0, 3:, 3:] / 51, 0, 1) * 255 + 0.5))
    assert tags[geotiff.NODATA] == b"0\0"
    for bad in (["--bbox", "90,90,99,99"], ["--bbox", "0,0,6,6", "--buffer-px", "1", "--buffer-m", "1"]):
        assert cli.main(["rvt", "slope", "--input", mound, *bad, "--output", str(tiles)]) == 1
    assert cli.main(["occlusion", "horizon", "-B", "1", "--input", mound, *box, "--output", str(tiles)]) == 1
    with pytest.raises(SystemExit):
        cli.main(["rvt"])


def test_render_commands(spark, tmp_path):
    base = put(tmp_path / "b.tif", BASE)
    spec = {"layers": [{"input": base, "valueMin": 0, "valueMax": 1, "colorFrom": "#CBEA9A", "colorTo": "#1F6B2A", "blendMode": "normal", "opacity": 1.0}]}
    (tmp_path / "s.json").write_text(json.dumps(spec))
    out = tmp_path / "c.tif"
    assert cli.main(["render", "compose", "--style", str(tmp_path / "s.json"), "--bbox", "0,0,4,4", "--output-mode", "single-file", "--output", str(out)]) == 0
    bands, _ = all_bands(out)
    assert bands[:, 0].tolist() == [[203, 117, 31, 117], [234, 170, 107, 170], [154, 98, 42, 98]]
    hidden = put(tmp_path / "h.tif", [[0, 0, 1, 1]] * 2 + [[1, 1, 1, 1]] * 2)
    spec["layers"][0]["alphaInput"] = hidden
    (tmp_path / "s.json").write_text(json.dumps(spec))
    assert cli.main(["render", "compose", "--style", str(tmp_path / "s.json"), "--bbox", "0,0,4,4", "--output", str(tmp_path / "ct"), "--tile-size", "2", "--with-alpha"]) == 0
    assert sorted(p.name for p in (tmp_path / "ct").iterdir()) == [geotiff.tile_name(i, i % 2, i // 2) for i in (1, 2, 3)]
    assert all_bands(tmp_path / "ct" / geotiff.tile_name(1, 1, 0))[0].shape[0] == 4
    fine = put(tmp_path / "f.tif", np.arange(16).reshape(4, 4), 0.5)
    coarse = put(tmp_path / "g.tif", [[0, 0], [0, 0]])
    assert cli.main(["render", "align-grid", "--input", fine, "--reference", coarse, "--output", str(tmp_path / "al.tif")]) == 0
    assert all_bands(tmp_path / "al.tif")[0].ravel().tolist() == [5, 7, 13, 15]
    assert cli.main(["render", "align-grid", "--input", fine, "--reference", put(tmp_path / "k.tif", [[0, 0], [0, 0]], crs="EPSG:3857"), "--output", str(tmp_path / "al.tif")]) == 1


def lzw(data):
    """Compress by the format's LZW."""
    table, out, bits, have, width, prefix = {bytes([i]): i for i in range(256)}, bytearray(), 0, 0, 9, b""
    count = 258

    def put(code):
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    for b in data:
        word = prefix + bytes([b])
        if word in table:
            prefix = word
            continue
        put(table[prefix])
        table[word], count = count, count + 1
        if count == 4094:
            put(256)
            table, count, width = {bytes([i]): i for i in range(256)}, 258, 9
        elif count == 1 << width:
            width += 1
        prefix = bytes([b])
    put(table[prefix])
    put(257)
    return bytes(out) + (bytes([bits << (8 - have) & 255]) if have else b"")


def test_lzw_blocks():
    r = np.random.default_rng(1)
    for data in (b"a", b"a" * 5000, r.integers(0, 256, 20_000, np.uint8).tobytes(), np.arange(9000, dtype="<f4").tobytes(), b"abcabcabd" * 3000):
        assert codecs.unlzw(lzw(data)) == data


def test_point_rasters_lie_half_a_cell_aside_and_feet_are_refused(tmp_path):
    g = Grid(4, 3, 100.0, 200.0, 2.0, 2.0, "EPSG:2056", -9999.0)
    data = geotiff.encode(np.zeros((1, 3, 4), np.float32), g, -9999.0)
    area, point, feet = (tmp_path / n for n in ("a.tif", "p.tif", "f.tif"))
    area.write_bytes(data)
    keys = struct.pack("<8H", 1024, 0, 1, 1, 1025, 0, 1, 1)
    assert keys in data
    point.write_bytes(data.replace(keys, struct.pack("<8H", 1024, 0, 1, 1, 1025, 0, 1, 2)))
    feet.write_bytes(data.replace(struct.pack("<4H", 1025, 0, 1, 1), struct.pack("<4H", 3076, 0, 1, 9002)))
    a, p = geotiff.read_header(str(area)).grid, geotiff.read_header(str(point)).grid
    assert (p.min_x, p.max_y) == (a.min_x - 1.0, a.max_y + 1.0)
    with pytest.raises(ValueError, match="metre"):
        geotiff.read_header(str(feet))


@pytest.mark.parametrize("code, metres", [(2263, False), (2927, False), (26741, False), (32037, False), (32067, False), (2056, True), (26918, True), (32632, True), (2290, True), (32061, True)])
def test_units_by_the_code_of_the_system(tmp_path, code, metres):
    """Without a citation or a unit key, feet are known by the code."""
    path = tmp_path / "f.tif"
    path.write_bytes(geotiff.encode(np.zeros((1, 3, 4), np.float32), Grid(4, 3, 0.0, 0.0, 1.0, 1.0, f"EPSG:{code}", -9999.0), -9999.0))
    if metres:
        assert geotiff.read_header(str(path)).grid.crs == f"EPSG:{code}"
        return
    with pytest.raises(ValueError, match="metre"):
        geotiff.read_header(str(path))


def test_a_window_reads_its_blocks_only(tmp_path, monkeypatch):
    path = tmp_path / "w.tif"
    path.write_bytes(geotiff.encode(np.arange(64 * 96, dtype=np.float32).reshape(1, 64, 96), Grid(96, 64, 0.0, 0.0, 1.0, 1.0, "EPSG:2056", -9999.0), -9999.0, 16))
    reader = geotiff.RasterReader(str(path), None, "20,10,30,20")
    parts = reader.partitions()
    ranges, read = [], geotiff.read_range
    monkeypatch.setattr(geotiff, "read_range", lambda p, start, size: ranges.append(start) or read(p, start, size))
    cells = [(x, y, z) for part in parts for b in reader.read(part) for x, y, z in zip(*(c.to_pylist() for c in b.columns))]
    assert len(parts) == 6 and len(ranges) == 6 and sorted(cells) == sorted((x, y, float(96 * y + x)) for x in range(20, 50) for y in range(10, 30))
    assert not reader.header.offsets  # tasks get the places of their own blocks
    monkeypatch.setattr(geotiff, "TASKS", 2)
    assert [len(p.value) for p in geotiff.RasterReader(str(path), None).partitions()] == [12, 12]  # 24 blocks


def packbits(data):
    """Literal runs and repeats by the format's rule."""
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[i]])
        else:
            while n < 128 and i + n < len(data) and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


@pytest.mark.parametrize("number, packed", [(codecs.NONE, bytes), (codecs.LZW, lzw), (codecs.PACKBITS, packbits), (codecs.ZSTD, lambda b: pa.compress(b, codec="zstd", asbytes=True)), (codecs.DEFLATE_OLD, zlib.compress)])
def test_equal_rasters_of_each_codec(tmp_path, monkeypatch, number, packed):
    m = np.round(np.random.default_rng(2).normal(0, 1, (50, 70)).cumsum(axis=0) + 500, 1).astype(np.float32)
    monkeypatch.setattr(geotiff, "compress_block", lambda part, side: packed(np.pad(part, [(0, side - n) for n in part.shape]).tobytes()))
    data = geotiff.encode(m[None], Grid(70, 50, 0.0, 0.0, 1.0, 1.0, "EPSG:2056", -9999.0), -9999.0, 32)
    plain = struct.pack("<HHIH", geotiff.COMPRESSION, 3, 1, 8)
    assert plain in data
    (tmp_path / "c.tif").write_bytes(data.replace(plain, struct.pack("<HHIH", geotiff.COMPRESSION, 3, 1, number)))
    h, out = geotiff.read_header(str(tmp_path / "c.tif")), np.zeros_like(m)
    for n in range(len(h.offsets)):
        w, v = geotiff.read_block(h, n)
        out[w.y : w.end_y, w.x : w.end_x] = v
    np.testing.assert_array_equal(out, m)


def test_damaged_lzw_is_refused():
    with pytest.raises(ValueError, match="LZW"):
        codecs.unlzw(bytes([0b10000000, 0b01111111, 0b11000000]))


def test_offsets_beyond_four_gigabytes(tmp_path):
    g = Grid(64, 32, 0.0, 0.0, 1.0, 1.0, "EPSG:2056", -9999.0)
    head, offsets = geotiff.front(g, 1, False, None, 16, [1 << 30] * 8)
    assert struct.unpack_from("<HHHQ", head, 2) == (43, 8, 0, 16) and offsets == [len(head) + (i << 30) for i in range(8)]
    (tmp_path / "h.tif").write_bytes(head)
    h = geotiff.read_header(str(tmp_path / "h.tif"))
    assert list(h.offsets) == offsets and h.sizes == (1 << 30,) * 8 and (h.grid.width, h.grid.height) == (64, 32)
    assert geotiff.front(g, 1, False, None, 16, [1 << 20] * 8)[0][2] == 42


def cells_of(spark, m):
    return spark.createDataFrame([(x, y, None if np.isnan(m[y, x]) else float(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], "x int, y int, z double")


def left_in(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


@pytest.mark.parametrize("by_tasks", [True, False])
@pytest.mark.parametrize("big", [True, False])
def test_one_file_by_a_commit(spark, tmp_path, by_tasks, big):
    m = np.arange(50 * 70, dtype=float).reshape(50, 70)
    m[3, 5] = np.nan
    lay = sink.Layout(Grid(70, 50, 10.0, 20.0, 1.0, 1.0, "EPSG:2056", -9999.0), Window(0, 0, 70, 50), 16, ("z",), True, False, -9999.0, by_tasks, big)
    path = tmp_path / "f.tif"
    path.write_bytes(b"old")
    sink.save(cells_of(spark, m).where("x < 16 or x >= 32"), lay, str(path))  # a column of blocks has no cell
    m[:, 16:32] = np.nan
    cells, grid = geotiff.load(spark, str(path))
    np.testing.assert_equal(matrix(cells, "z"), m)
    assert (grid.width, grid.min_x, grid.max_y) == (70, 10.0, 70.0) and left_in(tmp_path) == ["f.tif"]
    h = geotiff.read_header(str(path))
    assert len(h.offsets) == 20 and len(set(h.offsets)) == 17 and path.read_bytes()[2] == (43 if big else 42)


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    m = np.ones((40, 40))
    (tmp_path / "f.tif").write_bytes(b"old")
    broken = cells_of(spark, m).withColumn("z", F.when(F.col("x") * F.col("y") == 39 * 39, F.raise_error(F.lit("no luck")).cast("double")).otherwise(F.col("z")))
    grid = Grid(40, 40, 0.0, 0.0, 1.0, 1.0, "EPSG:2056", -9999.0)
    for single in (True, False):
        with pytest.raises(Exception, match="no luck"):
            sink.save(broken, sink.Layout(grid, grid.whole, 16, ("z",), single, by_tasks=single), str(tmp_path / ("f.tif" if single else "tiles")))
    assert left_in(tmp_path) == ["f.tif"] and (tmp_path / "f.tif").read_bytes() == b"old"
    outside = cells_of(spark, m).withColumn("z", F.lit("x"))
    with pytest.raises(Exception):
        sink.save(outside, sink.Layout(grid, grid.whole, 16, ("z", "none"), True), str(tmp_path / "g.tif"))
    assert left_in(tmp_path) == ["f.tif"]


def batch(block, side=16, value=1.0):
    n = side * side
    return pa.RecordBatch.from_pydict({"block": np.full(n, block), "x": np.arange(n, dtype=np.int32) % side + block * side, "y": (np.arange(n) // side).astype(np.int32), "z": np.full(n, value)})


@pytest.mark.parametrize("single", [True, False])
def test_only_committed_attempts_count(tmp_path, single):
    """Two attempts of one task, as after a lost executor or by speculation: one is committed; then cells of a block in two tasks."""
    grid = Grid(48, 16, 0.0, 0.0, 1.0, 1.0, "EPSG:2056", -9999.0)
    path = tmp_path / ("f.tif" if single else "tiles")
    writer = sink.RasterWriter(str(path), sink.Layout(grid, grid.whole, 16, ("z",), single))
    lost = writer.write(iter([batch(0, value=7.0), batch(1, value=7.0)]))
    first, second = writer.write(iter([batch(0), batch(1)])), writer.write(iter([batch(2, value=2.0)]))
    assert lost.part != first.part
    writer.commit([first, second])
    if single:
        h = geotiff.read_header(str(path))
        assert [geotiff.read_block(h, n)[1].max() for n in range(3)] == [1.0, 1.0, 2.0] and left_in(tmp_path) == ["f.tif"]
    else:
        assert left_in(path) == [geotiff.tile_name(i, i, 0) for i in range(3)]
    again = sink.RasterWriter(str(path), sink.Layout(grid, grid.whole, 16, ("z",), single))
    with pytest.raises(ValueError, match="several tasks"):
        again.commit([again.write(iter([batch(0)])), again.write(iter([batch(0)]))])
    with pytest.raises(ValueError, match="tile 0"):
        again.write(iter([batch(0), batch(1), batch(0)]))
    again.abort([])
    with pytest.raises(RuntimeError, match="tile 1"):
        again.write(iter([batch(1).set_column(1, "x", pa.array(np.full(256, 500, np.int32)))]))
    again.abort([])
    assert not [p for p in left_in(tmp_path) if again.layout.token in p]


def test_a_folder_of_tiles_is_one_scan(spark, tmp_path):
    m = np.arange(50 * 70, dtype=float).reshape(50, 70)
    grid = Grid(70, 50, 10.0, 20.0, 0.5, 0.5, "EPSG:2056", -9999.0)
    assert sink.write_tiles(cells_of(spark, m), Tiling(grid, 20), ["z"], str(tmp_path / "t"), nodata_tag=-9999.0) == 12
    cells, own = geotiff.load_tiles(spark, str(tmp_path / "t"))
    np.testing.assert_equal(matrix(cells, "z"), m)
    assert (own.width, own.height, own.min_x, own.max_y, own.res_x, own.nodata) == (70, 50, 10.0, 45.0, 0.5, -9999.0)
    part = cells.where("x >= 15 and x < 42 and y = 30").collect()
    assert sorted((r.x, r.y, r.z) for r in part) == [(x, 30, m[30, x]) for x in range(15, 42)]
    put(tmp_path / "t" / "odd.tif", [[1.0]], 3.0)
    with pytest.raises(ValueError, match="differ"):
        geotiff.load_tiles(spark, str(tmp_path / "t"))
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError, match="No GeoTIFF"):
        geotiff.load_tiles(spark, str(tmp_path / "none"))


def test_bounds_reach_the_reader(spark, tmp_path, monkeypatch):
    path = put(tmp_path / "w.tif", np.arange(64 * 96).reshape(64, 96))
    reader = geotiff.RasterReader(path, None)
    rest = list(reader.pushFilters([GreaterThan(("x",), 19), LessThanOrEqual(("x",), 49), GreaterThanOrEqual(("y",), 10), LessThan(("y",), 30), EqualTo(("z",), 5.0), In(("x",), (1, 2))]))
    assert [type(f).__name__ for f in rest] == ["EqualTo", "In"] and reader.window == Window(20, 10, 30, 20)
    ranges, read = [], geotiff.read_range
    monkeypatch.setattr(geotiff, "read_range", lambda p, start, size: ranges.append(start) or read(p, start, size))
    parts = reader.partitions()
    got = [(x, y) for part in parts for b in reader.read(part) for x, y in zip(*(c.to_pylist() for c in b.columns[:2]))]
    assert len(ranges) == 6 and sorted(got) == sorted((x, y) for x in range(20, 50) for y in range(10, 30))
    cells, _ = geotiff.load(spark, path)
    some = cells.where("x > 19.5 and x <= 49 and y >= 10 and y < 30 and z % 2 = 0")
    assert some.count() == 300 and some.rdd.getNumPartitions() == 6
    for nothing in ("x < 0", "x > 10 and x < 11", "y = 64", "x = 5000000000", "x is null"):
        assert cells.where(nothing).count() == 0
    assert cells.where("x = 3 or y = 7").count() == 64 + 96 - 1 and cells.where("x <> 3").count() == 64 * 95
