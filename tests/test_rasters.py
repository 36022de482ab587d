"""Files of every layout, ranges of blocks, projections and warps."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvispark.functions import projection
from fluvispark.sources import prepare, raster, tiff
from fluvispark.sources.grids import GridInfo


def lzw(data: bytes) -> bytes:
    """A plain LZW writer, as TIFF wants it."""
    out, held, bits = bytearray(), 0, 0

    def put(code, width):
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1

    table, width, word = {bytes([k]): k for k in range(256)}, 9, b""
    put(256, 9)
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        put(table[word], width)
        table[more] = len(table) + 2
        if table[more] == 4094:
            put(256, width)
            table, width = {bytes([k]): k for k in range(256)}, 9
        elif table[more] == (1 << width) - 1:
            width += 1
        word = data[k : k + 1]
    put(table[word], width)
    put(257, width)
    put(0, 7)
    return bytes(out)


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: lambda b: b"".join(bytes([len(b[k : k + 100]) - 1]) + b[k : k + 100] for k in range(0, len(b), 100))}


def predicted(a: np.ndarray, predictor: int, order: str) -> bytes:
    """The bytes of h x w x bands values after a predictor."""
    h, w, s = a.shape
    kind = a.dtype.newbyteorder(order)
    if predictor == 2:
        whole = a.astype(kind).view(np.dtype(f"{order}u{a.dtype.itemsize}"))
        return np.diff(whole.astype(f"u{a.dtype.itemsize}"), axis=1, prepend=np.zeros((h, 1, s), f"u{a.dtype.itemsize}")).astype(f"{order}u{a.dtype.itemsize}").tobytes()
    if predictor == 3:
        split = a.reshape(h, w * s).astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(h, w * s, a.dtype.itemsize).transpose(0, 2, 1).reshape(h, -1, s)
        return np.diff(split, axis=1, prepend=np.zeros((h, 1, s), np.uint8)).tobytes()
    return a.astype(kind).tobytes()


def written(z: np.ndarray, info: GridInfo, order="<", tile=None, strip=None, compression=1, predictor=1, planar=1, big=False, nodata=None) -> bytes:
    """A file of rows x cols x bands values, laid out as asked."""
    rows, cols, bands = z.shape
    h, w = (tile, tile) if tile else (strip, cols)
    blocks = []
    for plane in [z[:, :, b : b + 1] for b in range(bands)] if planar == 2 else [z]:
        for r in range(0, rows, h):
            for c in range(0, cols, w):
                part = plane[r : r + h, c : c + w]
                if tile:
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)))
                blocks.append(PACK[compression](predicted(part, predictor, order)))
    entries = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [8 * z.dtype.itemsize] * bands), (259, 3, [compression]), (277, 3, [bands]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[z.dtype.kind]] * bands)]
    entries += [(322, 3, [tile]), (323, 3, [tile])] if tile else [(278, 3, [strip])]
    entries += [(33550, 12, [info.cw, info.ch, 0.0]), (33922, 12, [0.0, 0.0, 0.0, info.x0, info.y0, 0.0])] + ([(42113, 2, f"{nodata:g}")] if nodata is not None else [])
    at, counts = (324, 325) if tile else (273, 279)
    letters = {3: "H", 4: "I", 12: "d", 16: "Q"}
    inline, long = (8, "Q") if big else (4, "I")
    entries = sorted([*entries, (at, 16 if big else 4, [0] * len(blocks)), (counts, 16 if big else 4, [len(b) for b in blocks])])
    start = 16 if big else 8

    def directory(offsets):
        head, extra = struct.pack(order + ("Q" if big else "H"), len(entries)), b""
        extra_at = start + len(head) + len(entries) * (12 + (8 if big else 0)) + inline
        for tag, kind, values in entries:
            values = offsets if tag == at else values
            body = values.encode() + b"\0" if kind == 2 else struct.pack(f"{order}{len(values)}{letters[kind]}", *values)
            n = len(body) if kind == 2 else len(values)
            head += struct.pack(order + "HH" + long, tag, kind, n)
            if len(body) <= inline:
                head += body.ljust(inline, b"\0")
            else:
                head += struct.pack(order + long, extra_at + len(extra))
                extra += body
        return head + struct.pack(order + long, 0) + extra

    at_first = start + len(directory([0] * len(blocks)))
    offsets = (at_first + np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1]))).astype(int).tolist()
    mark = {"<": b"II", ">": b"MM"}[order]
    return mark + (struct.pack(order + "HHHQ", 43, 8, 0, 16) if big else struct.pack(order + "HI", 42, 8)) + directory(offsets) + b"".join(blocks)


INFO = GridInfo(37, 53, 100.0, 900.0, 2.0, 3.0)
LAYOUTS = [
    {"strip": 10}, {"strip": 37, "compression": 5, "order": ">"}, {"tile": 16, "compression": 5, "predictor": 2}, {"tile": 16, "compression": 8, "predictor": 3, "planar": 2}, {"tile": 16, "compression": 5, "predictor": 3, "order": ">"},
    {"strip": 5, "compression": 8, "predictor": 2, "planar": 2, "order": ">"}, {"tile": 32, "big": True, "compression": 32773}, {"strip": 7, "big": True, "order": ">", "compression": 5, "predictor": 2, "planar": 2},
]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("kind", ["<f4", "<i2", "u1", "<f8"])
@pytest.mark.parametrize("bands", [1, 3])
def test_layouts(layout, kind, bands):
    if layout.get("predictor") == 3 and kind[-2] != "f":
        pytest.skip("a predictor of floating point")
    rng = np.random.default_rng(3)
    z = np.round(rng.random((37, 53, bands)) * 60, 1).astype(kind)
    t = tiff.Tiff(written(z, INFO, **layout))
    assert t.info == INFO and t.samples == bands
    whole = np.zeros(z.shape)
    for k in t.within():
        r, c, own = t.block(k, tuple(range(1, bands + 1)))
        for b, a in enumerate(own):
            whole[r : r + a.shape[0], c : c + a.shape[1], b] = a
    assert (whole == z.astype(float)).all()


def test_lzw_over_full_tables():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 5000, rng.integers(0, 256, 60_000, np.uint8).tobytes(), rng.integers(0, 3, 100_000, np.uint8).tobytes()):
        assert tiff.unlzw(lzw(data) if data else b"\x80\x40\x40\x00") == data
    assert tiff.unpackbits(bytes([2, 1, 2, 3, 254, 7, 128, 0, 9])) == bytes([1, 2, 3, 7, 7, 7, 9])
    with pytest.raises(tiff.RasterError):
        tiff.unlzw(b"\x80\x7f\xff\xff")


def test_a_file_is_many_partitions(spark, tmp_path):
    z = np.arange(230.0 * 160).reshape(230, 160, 1).astype("<f4")
    z = np.concatenate([z, -z], axis=2)
    z[5, 7, 0] = -1.0
    path = tmp_path / "a b.tif"
    path.write_bytes(written(z, GridInfo(230, 160, 0.0, 0.0, 1.0, 1.0), tile=16, compression=5, predictor=3, nodata=-1.0))
    head = raster.headers(spark, f"file://{tmp_path}").first()
    assert (head.rows, head.cols, head.bands, head.blocks) == (230, 160, 2, 150)
    cells = raster.cells_of(spark, [head.path], (1, 2), run_bytes=16 * 1024)
    assert cells.rdd.getNumPartitions() > 10
    got = {(r.band, r.r, r.c): r.z for r in cells.collect()}
    assert len(got) == 2 * 230 * 160 - 2 and got[2, 229, 159] == -36799 and (1, 5, 7) not in got and (2, 0, 1) not in got
    part, _ = raster.read_grid(spark, f"file://{tmp_path}", window=(100, 120, 30, 41))
    assert sorted((r.r, r.c, r.z) for r in part.collect()) == sorted((i, j, float(z[i, j, 0])) for i in range(100, 120) for j in range(30, 41))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert raster.cells_of(spark, [head.path], (1, 2)).filter("r >= 200 and c < 16 and band = 2").count() == 30 * 16
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(tiff.RasterError):
        tiff.Tiff(path.read_bytes()).block(0, (3,))


def test_only_the_asked_blocks_are_read(tmp_path):
    z = np.zeros((64, 64, 1), "<f4")
    (tmp_path / "z.tif").write_bytes(written(z, GridInfo(64, 64, 0.0, 0.0, 1.0, 1.0), tile=16))
    options = {"paths": f'["{tmp_path}/z.tif"]', "run_bytes": "1"}
    count = lambda reader: sum(len(p.blocks) for p in reader.partitions())
    assert count(tiff.TiffReader(options)) == 16
    assert count(tiff.TiffReader({**options, "window": "0,17,0,16"})) == 2
    reader = tiff.PushedReader(options)
    pushed = [tiff.GreaterThanOrEqual(("r",), 48), tiff.LessThan(("c",), 20), tiff.EqualTo(("band",), 1)]
    assert list(reader.pushFilters(pushed)) == pushed and count(reader) == 2
    list(reader.pushFilters([tiff.EqualTo(("band",), 2)]))
    assert count(reader) == 0


def test_folders_of_written_pieces(spark, tmp_path):
    z = np.round(np.random.default_rng(2).random((50, 70)) * 10, 2).astype(np.float32).astype(float)
    info = GridInfo(50, 70, 500000.0, 9900600.0, 10.0, 10.0)
    cells = spark.createDataFrame([(i, j, float(z[i, j])) for i in range(50) for j in range(70) if (i + j) % 7], "r int, c int, z double")
    files = raster.write_folder(cells, info, "z", f"file://{tmp_path}/out", size=32, epsg=32737, tile=16)
    assert files.count() == 6
    got, back = raster.read_grid(spark, f"file://{tmp_path}/out")
    assert back == info and sorted(map(tuple, got.select("r", "c", "z").collect())) == sorted(map(tuple, cells.collect()))


@pytest.mark.parametrize("whole", [False, True])
def test_cells_of_the_value_that_stands_for_nodata_are_kept(spark, tmp_path, whole):
    z = {(i, j): float([-9999, -9998, -2147483648, 7][(i + j) % 4]) for i in range(20) for j in range(20) if (i * j) % 5}
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "r int, c int, z double")
    raster.write_folder(cells, GridInfo(20, 20, 0.0, 0.0, 1.0, 1.0), "z", f"file://{tmp_path}/out", size=16, tile=16, whole=whole)
    got, _ = raster.read_grid(spark, f"file://{tmp_path}/out")
    assert {(r, c): v for r, c, v in got.select("r", "c", "z").collect()} == z


def test_overlaps():
    assert not raster.overlapping([(0, 0, 10, 10), (0, 10, 10, 10), (10, 0, 5, 20)])
    assert raster.overlapping([(0, 0, 10, 10), (9, 9, 10, 10)]) and raster.overlapping([(0, 0, 5, 50), (2, 10, 1, 3)])
    (one,) = [[(0, 0, 4, 4)]]
    assert not raster.overlapping(one)


# --- projections --------------------------------------------------------------------------------------


def test_projection_there_and_back():
    rng = np.random.default_rng(1)
    for epsg in (32601, 32637, 32737, 32760):
        p = projection.system(epsg)
        lon = p.meridian + rng.uniform(-4, 4, 500)
        lat = rng.uniform(0, 84, 500) * (1 if epsg // 100 == 326 else -1)
        x, y = p.from_degrees(lon, lat)
        back = p.to_degrees(x, y)
        assert np.abs(back[0] - lon).max() < 1e-9 and np.abs(back[1] - lat).max() < 1e-9
        again = p.from_degrees(*back)
        assert np.hypot(again[0] - x, again[1] - y).max() < 1e-4


def test_projection_against_the_meridian_arc_and_known_points():
    e2 = projection.ECCENTRICITY**2
    nodes, weights = np.polynomial.legendre.leggauss(60)
    for lat in (10.0, 45.0, 80.0):
        phi = np.radians(lat) / 2 * (nodes + 1)
        arc = np.radians(lat) / 2 * (weights * projection.RADIUS * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5).sum()
        x, y = projection.system(32633).from_degrees(15.0, lat)
        assert abs(x - 500000) < 1e-6 and abs(y - 0.9996 * arc) < 1e-4
    x, y = projection.system(32737).from_degrees(36.8, -1.3)  # conformal: the scale is alike in all directions
    h = 1e-5
    dx, dy = [np.array(projection.system(32737).from_degrees(36.8 + a, -1.3 + b)) - (x, y) for a, b in ((h, 0), (0, h))]
    w = 1 - e2 * np.sin(np.radians(-1.3)) ** 2
    east, north = projection.RADIUS * np.cos(np.radians(-1.3)) / np.sqrt(w), projection.RADIUS * (1 - e2) / w**1.5
    scales = [np.hypot(*dx) / east, np.hypot(*dy) / north]
    assert abs(scales[0] / scales[1] - 1) < 1e-7 and abs(dx @ dy) < 1e-6 * np.hypot(*dx) * np.hypot(*dy)
    with pytest.raises(ValueError):
        projection.system(None)
    with pytest.raises(ValueError):
        projection.system(3857)
    assert [projection.utm_of(*p) for p in ((36.8, -1.3), (5.0, 60.0), (10.0, 78.0), (0.0, 85.0))] == [32737, 32632, 32633, 32661]


def test_projection_on_columns(spark):
    p = projection.system(32737)
    df = spark.createDataFrame([(36.8, -1.3), (39.0, -4.0), (41.5, -0.1)], "lon double, lat double")
    x, y = p.from_degrees(F.col("lon"), F.col("lat"))
    lon, lat = p.to_degrees(F.col("x"), F.col("y"))
    for r in df.withColumns({"x": x, "y": y}).withColumns({"lon2": lon, "lat2": lat}).collect():
        assert np.allclose((r.x, r.y), p.from_degrees(r.lon, r.lat), atol=1e-6, rtol=0) and abs(r.lon - r.lon2) < 1e-10 and abs(r.lat - r.lat2) < 1e-10


# --- warps -----------------------------------------------------------------------------------------------


def cells(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])], "r int, c int, z double")


def plain_warp(z, source, target, back, method):
    """A cell at a time, from the definition."""
    out = {}
    for r in range(target.rows):
        for c in range(target.cols):
            x, y = back(target.x0 + (c + 0.5) * target.cw, target.y0 - (r + 0.5) * target.ch)
            fr, fc = (source.y0 - y) / source.ch - 0.5, (x - source.x0) / source.cw - 0.5
            i, j = int(np.floor(fr + 0.5)), int(np.floor(fc + 0.5))
            ok = lambda a, b: 0 <= a < source.rows and 0 <= b < source.cols and not np.isnan(z[a, b])
            if not ok(i, j):
                continue
            if method == "near":
                out[r, c] = z[i, j]
                continue
            total = weight = 0.0
            for a in range(int(np.floor(fr)) - 3, int(np.floor(fr)) + 5):
                for b in range(int(np.floor(fc)) - 3, int(np.floor(fc)) + 5):
                    if ok(a, b):
                        k = prepare.cubic if method == "cubic" else prepare.tent
                        w = float(k(np.array(a - fr)) * k(np.array(b - fc)))
                        total, weight = total + w * z[a, b], weight + w
            if weight > 1e-9:
                out[r, c] = total / weight
    return out


@pytest.mark.parametrize("method", ["near", "bilinear", "cubic"])
@pytest.mark.parametrize("tile", [5, 256])
def test_warps_between_zones(spark, method, tile):
    rng = np.random.default_rng(4)
    z = rng.random((40, 45)) * 100
    z[rng.random(z.shape) < 0.08] = np.nan
    source = GridInfo(40, 45, 172000.0, 9860000.0, 30.0, 30.0)
    a, b = projection.system(32737), projection.system(32736)
    box = raster.transform_bounds(prepare.bounds(source), lambda x, y: projection.carry(a, b)(x, y))
    target = prepare.aligned(box, 30.0)
    got = {(r.r, r.c): r.z for r in prepare.warp_between(cells(spark, z), source, target, 32737, 32736, method, tile).collect()}
    want = plain_warp(z, source, target, projection.carry(b, a), method)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_coarser_grids_leave_no_cell_out(spark):
    z = np.add.outer(np.arange(40.0), 3 * np.arange(40.0)) + np.where(np.indices((40, 40)).sum(axis=0) % 2, 50.0, -50.0)
    source, target = GridInfo(40, 40, 0.0, 400.0, 10.0, 10.0), GridInfo(10, 10, 0.0, 400.0, 40.0, 40.0)
    for r in prepare.warp(cells(spark, z), source, target).filter("r between 1 and 8 and c between 1 and 8").collect():
        assert abs(r.z - (4 * r.r + 1.5 + 3 * (4 * r.c + 1.5))) < 1e-9
    with pytest.raises(ValueError):
        prepare.warp(cells(spark, z), source, target, method="average")


def test_preparing(spark, tmp_path):
    lon, lat = 36.79 + 0.0003 * np.arange(60), -1.30 - 0.0003 * np.arange(50)
    z = 1500 + 2e4 * np.add.outer(lat + 1.3, 2 * (lon - 36.79))
    info = GridInfo(50, 60, 36.79 - 0.00015, -1.30 + 0.00015, 0.0003, 0.0003)
    (tmp_path / "in").mkdir()
    for k, (a, b) in enumerate(((0, 30), (30, 60))):
        part = GridInfo(50, b - a, info.x0 + a * 0.0003, info.y0, 0.0003, 0.0003)
        data = raster.encode(z[:, a:b], part, tile=16)
        (tmp_path / "in" / f"{k}.tif").write_bytes(data)
    path = f"file://{tmp_path}/in"
    with pytest.raises(ValueError, match="no coordinate system"):
        prepare.prepare(spark, path)
    for k, (a, b) in enumerate(((0, 30), (30, 60))):
        part = GridInfo(50, b - a, info.x0 + a * 0.0003, info.y0, 0.0003, 0.0003)
        (tmp_path / "in" / f"{k}.tif").write_bytes(raster.encode(z[:, a:b], part, tile=16, epsg=4326))
    got = prepare.prepare(spark, path)
    assert got.epsg == 32737 and got.log["cell_m"] == 33.4 and got.log["zones"] == 1 and not got.log["damaged_before"]
    assert abs(got.info.x0 / 33.4 - round(got.info.x0 / 33.4)) < 1e-6
    p = projection.system(32737)
    for r in got.cells.collect():
        x, y = p.to_degrees(got.info.x0 + (r.c + 0.5) * 33.4, got.info.y0 - (r.r + 0.5) * 33.4)
        inside = info.x0 + 0.0003 < x < info.x0 + 59 * 0.0003 and info.y0 - 49 * 0.0003 < y < info.y0 - 0.0003
        assert not inside or abs(r.z - (1500 + 2e4 * (y + 1.3 + 2 * (x - 36.79)))) < 0.02
    clip = prepare.prepare(spark, path, clip=(36.795, -1.305, 36.797, -1.303), buffer_m=100.0, cell_m=20.0, audits=False)
    assert clip.info.rows * 20 < 222 + 200 + 60 and clip.cells.count() == clip.info.rows * clip.info.cols
    with pytest.raises(ValueError, match="degrees"):
        prepare.prepare(spark, path, target=4326)
    with pytest.raises(ValueError, match="nearest"):
        prepare.prepare(spark, path, method="near")
    same, note = prepare.warp_to_grid(spark, path, clip.info, 32737)
    assert note == "in (resampled bilinear to the grid)" and same.count() == clip.cells.count()
    x, y = prepare.native_cell_m(GridInfo(1, 1, 0, 0, 1.0, 1.0), 4326, 45.0)
    assert abs(x - 78846.8) < 1 and abs(y - 111131.8) < 1
