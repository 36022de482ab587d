"""Grids in TIFF files: cell tables from them, files from cell tables, and other grids on this one.

Files are read by ``tiff.TiffCells``, a source whose partitions are runs of a file's blocks; files in a store that only Spark reaches are read whole, a file a task.
"""

from __future__ import annotations

import json
import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import GridInfo
from .tiff import KINDS, RasterError, Stored, Tiff, TiffCells, placed, store_of, valid

HEADER = "path string, rows int, cols int, bands int, blocks int, x0 double, y0 double, cw double, ch double, nodata double, epsg int, projected boolean, tags map<string,string>"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files at ``path``: a file, a folder or a pattern, in any store Spark reads; their content is not."""
    return spark.read.format("binaryFile").load(path).select("path", "length").select("path")


def _reached(path: str) -> bool:
    """Whether tasks can read ranges of the file themselves."""
    try:
        store_of(path)
    except Exception:  # no file system of Arrow's for it
        return False
    return True


def headers(spark: SparkSession, path: str) -> DataFrame:
    """A row a file: its size, bands, blocks, georeference, NoData value, coordinate system and tags; only the files' directories are read."""
    files = listing(spark, path)
    first = files.first()
    ranges = first is not None and _reached(first.path)
    files = files if ranges else spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for k, p in enumerate(pdf.path.tolist()):
                t = Tiff(Stored(p) if ranges else bytes(pdf.content.iloc[k]))
                i = t.info
                rows.append({"path": p, "rows": i.rows, "cols": i.cols, "bands": t.samples, "blocks": t.across * t.down, "x0": i.x0, "y0": i.y0, "cw": i.cw, "ch": i.ch, "nodata": t.nodata, "epsg": t.epsg, "projected": t.projected, "tags": t.tags})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return files.mapInPandas(run, HEADER)


def cells_of(spark: SparkSession, paths: list[str], bands: tuple[int, ...] = (1,), window: tuple[int, int, int, int] | None = None, origin: tuple[float, float] | None = None, nodata: float | None = None, run_bytes: int = 32 << 20) -> DataFrame:
    """(path, band, r, c, z) of the valid cells of files, read by their blocks; see ``tiff.TiffCells``."""
    spark.dataSource.register(TiffCells)
    options = {"paths": json.dumps(paths), "bands": ",".join(map(str, bands)), "run_bytes": str(run_bytes), "push": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}
    if window is not None:
        options["window"] = ",".join(map(str, window))
    if origin is not None:
        options["origin"] = f"{origin[0]!r},{origin[1]!r}"
    if nodata is not None:
        options["nodata"] = repr(float(nodata))
    return spark.read.format("tiff_cells").options(**options).load()


def _cells_of_whole(spark: SparkSession, path: str, bands: tuple[int, ...], window, origin: tuple[float, float], nodata: float | None) -> DataFrame:
    """As ``cells_of``, of files that only Spark can read, each by one task."""
    r0, r1, c0, c1 = window or (0, 1 << 40, 0, 1 << 40)

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf.path.tolist(), pdf.content.tolist(), strict=True):
                t = Tiff(bytes(data))
                dr, dc = placed(t.info, *origin)
                for k in range(t.across * t.down):
                    r, c, values = t.block(k, bands)
                    for band, a in zip(bands, values, strict=True):
                        i, j = np.nonzero(valid(a, (t.nodata, nodata)))
                        own = pd.DataFrame({"path": p, "band": band, "r": i + r + dr, "c": j + c + dc, "z": a[i, j].astype(float)})
                        yield own[(own.r >= r0) & (own.r < r1) & (own.c >= c0) & (own.c < c1)]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, band int, r int, c int, z double")


def read_grid(spark: SparkSession, path: str, nodata: float | None = None, band: int = 1, window: tuple[int, int, int, int] | None = None, run_bytes: int = 32 << 20) -> tuple[DataFrame, GridInfo]:
    """(cells (r, c, z), georeference) of one file or of several on one grid; where files overlap, the last by path that has a value wins.

    Cells are valid if finite and neither the file's NoData value nor ``nodata``; the others have no row. An error if there are none. ``window``: only rows from the first
    to before the second number, and columns likewise, on the common grid.
    """
    found = headers(spark, path).orderBy("path").collect()  # one row a file
    if not found:
        raise RasterError(f"no file at {path}")
    cw, ch = found[0].cw, found[0].ch
    x0, y0 = min(h.x0 for h in found), max(h.y0 for h in found)
    if any(abs(h.cw - cw) > 1e-9 * cw or abs(h.ch - ch) > 1e-9 * ch for h in found):
        raise RasterError("the files are not on one grid")
    place = [(*placed(GridInfo(h.rows, h.cols, h.x0, h.y0, cw, ch), x0, y0), h.rows, h.cols) for h in found]
    info = GridInfo(max(r + rows for r, _, rows, _ in place), max(c + cols for _, c, _, cols in place), x0, y0, cw, ch)
    if _reached(found[0].path):
        cells = cells_of(spark, [h.path for h in found], (band,), window, (x0, y0), nodata, run_bytes)
    else:
        cells = _cells_of_whole(spark, path, (band,), window, (x0, y0), nodata)
    cells = cells.groupBy("r", "c").agg(F.max_by("z", "path").alias("z")) if overlapping(place) else cells.select("r", "c", "z")
    if cells.isEmpty():
        raise RasterError("the grid has no valid cell")
    return cells, info


def overlapping(place: list[tuple[int, int, int, int]]) -> bool:
    """Whether two of the boxes (row, column, rows, columns) share a cell: a sweep down the rows, with the boxes of the row by column."""
    from bisect import bisect_left, insort

    events = sorted([(r, 1, c, w, r + h) for r, c, h, w in place] + [(r + h, 0, c, w, r + h) for r, c, h, w in place])
    here: list[tuple[int, int]] = []
    for _, opens, c, w, _ in events:
        if not opens:
            here.pop(bisect_left(here, (c, c + w)))
            continue
        k = bisect_left(here, (c, c + w))
        if k < len(here) and here[k][0] < c + w or k and here[k - 1][1] > c:
            return True
        insort(here, (c, c + w))
    return False


def free_nodata(values: np.ndarray, kind: np.dtype, asked: float) -> float:
    """``asked``, if none of the valid ``values`` is that in a file of ``kind``; else NaN or, of whole numbers, the least that none is."""
    held = np.unique(values.astype(kind))
    if not (held == np.array(asked).astype(kind)).any():
        return asked
    if kind.kind == "f":
        return math.nan
    least = np.arange(len(held)) + np.iinfo(kind).min
    return float(np.append(least, least[-1] + 1)[np.append(held != least, True).argmax()])


def encode(a: np.ndarray, info: GridInfo, nodata: float = -9999.0, epsg: int | None = None, tags: dict[str, str] | None = None, tile: int = 256) -> bytes:
    """A tiled deflate file of float32, or int32 or uint8 if ``a`` is of whole numbers; what is not finite becomes NoData (NaN where a cell has the value ``nodata``)."""
    kind = np.dtype("<f4") if a.dtype.kind == "f" else np.dtype("u1") if a.dtype == np.uint8 else np.dtype("<i4")
    nodata = free_nodata(a[np.isfinite(a)], kind, nodata) if kind.kind == "f" else nodata
    a = np.where(np.isfinite(a), a, nodata).astype(kind) if a.dtype.kind == "f" else a.astype(kind)
    rows, cols = a.shape
    blocks = []
    for r in range(0, rows, tile):
        for c in range(0, cols, tile):
            part = np.full((tile, tile), 0 if kind.kind == "u" else nodata, kind)
            part[: min(tile, rows - r), : min(tile, cols - c)] = a[r : r + tile, c : c + tile]
            blocks.append(zlib.compress(part.tobytes(), 6))
    text = "".join(f'<Item name="{k}">{v}</Item>' for k, v in sorted((tags or {}).items()))
    entries = [
        (256, 4, [cols]), (257, 4, [rows]), (258, 3, [8 * kind.itemsize]), (259, 3, [8]), (262, 3, [1]), (277, 3, [1]), (284, 3, [1]), (317, 3, [1]), (322, 3, [tile]), (323, 3, [tile]),
        (324, 4, [0] * len(blocks)), (325, 4, [len(b) for b in blocks]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind.kind]]), (33550, 12, [info.cw, info.ch, 0.0]), (33922, 12, [0.0, 0.0, 0.0, info.x0, info.y0, 0.0]),
    ]
    if epsg:
        model, key = (2, 2048) if epsg == 4326 else (1, 3072)  # degrees or projected
        entries.append((34735, 3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, epsg]))
    if text:
        entries.append((42112, 2, f"<GDALMetadata>{text}</GDALMetadata>"))
    if kind.kind != "u":
        entries.append((42113, 2, f"{nodata:.17g}"))

    def packed(at: list[int]) -> tuple[bytes, int]:
        """The directory and its long values; and where the blocks begin."""
        extra_at = 8 + 2 + 12 * len(entries) + 4
        head, extra = struct.pack("<H", len(entries)), b""
        for tag, k, values in entries:
            values = at if tag == 324 else values
            body = values.encode("latin-1") + b"\0" if k == 2 else struct.pack(f"<{len(values)}{KINDS[k][1]}", *values)
            count = len(body) if k == 2 else len(values)
            if len(body) <= 4:
                head += struct.pack("<HHI", tag, k, count) + body.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, k, count, extra_at + len(extra))
                extra += body + b"\0" * (len(body) % 2)
        return head + struct.pack("<I", 0) + extra, extra_at + len(extra)

    start = packed([0] * len(blocks))[1]
    at = [start + x for x in np.concatenate(([0], np.cumsum([len(b) for b in blocks])[:-1])).astype(int).tolist()]
    if start + sum(map(len, blocks)) >= 1 << 32:
        raise RasterError("the grid is too large for one file; write it in pieces")
    return b"II*\0" + struct.pack("<I", 8) + packed(at)[0] + b"".join(blocks)


def pieces(cells: DataFrame, info: GridInfo, column: str, size: int = 2048, whole: bool = False, **options) -> DataFrame:
    """(tr, tc, content): a file of every ``size`` x ``size`` cells that hold any, each on its own part of the grid; made where the cells are. A piece with a cell of the value ``nodata`` has a NoData value of its own."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * size, key[1] * size
        h, w = min(size, info.rows - r0), min(size, info.cols - c0)
        a = np.full((h, w), np.nan)
        a[pdf.r.to_numpy() - r0, pdf.c.to_numpy() - c0] = pdf.v.to_numpy(float)
        own = dict(options)
        if whole:
            own["nodata"] = free_nodata(a[np.isfinite(a)], np.dtype("<i4"), options.get("nodata", -9999.0))
            a = np.where(np.isnan(a), own["nodata"], a).astype(np.int32)
        part = GridInfo(h, w, info.x0 + c0 * info.cw, info.y0 - r0 * info.ch, info.cw, info.ch)
        return pd.DataFrame({"tr": [key[0]], "tc": [key[1]], "content": [encode(a, part, **own)]})

    own = cells.select("r", "c", F.col(column).cast("double").alias("v"), F.expr(f"r div {size}").cast("int").alias("tr"), F.expr(f"c div {size}").cast("int").alias("tc"))
    return own.groupBy("tr", "tc").applyInPandas(run, "tr int, tc int, content binary")


def write_folder(cells: DataFrame, info: GridInfo, column: str, folder: str, size: int = 2048, **options) -> DataFrame:
    """``pieces`` written by the tasks that make them, a file each, into a folder that all executors reach; gives (path, bytes). A piece that is made again is the same, and replaces the first in one step."""
    spark = cells.sparkSession
    if not _reached(folder):
        raise RasterError(f"executors can't write to {folder} themselves")

    def run(batches):
        for pdf in batches:
            rows = []
            for tr, tc, content in zip(pdf.tr.tolist(), pdf.tc.tolist(), pdf.content.tolist(), strict=True):
                fs, base = store_of(folder)
                fs.create_dir(base, recursive=True)
                name, part = f"{base}/{tr:06d}_{tc:06d}.tif", f"{base}/_{tr}_{tc}.{np.random.default_rng().integers(1 << 62)}"
                with fs.open_output_stream(part) as out:
                    out.write(bytes(content))
                fs.move(part, name)
                rows.append({"path": name, "bytes": len(content)})
            yield pd.DataFrame(rows, columns=["path", "bytes"])

    written = pieces(cells, info, column, size, **options).mapInPandas(run, "path string, bytes long").collect()  # one row a file
    return spark.createDataFrame([tuple(r) for r in written], "path string, bytes long")


def write_grid(cells: DataFrame, info: GridInfo, column: str, path: str, max_cells: int = 64_000_000, **options) -> str:
    """One file at ``path`` (any store Spark reaches), for grids of at most ``max_cells``; larger ones are written as ``pieces``."""
    if info.rows * info.cols > max_cells:
        raise RasterError(f"{info.rows * info.cols} cells; one file has at most {max_cells}")
    spark = cells.sparkSession
    got = pieces(cells, info, column, size=max(info.rows, info.cols, 1), **options).collect()
    if not got:
        raise RasterError("no cell to write")
    put(spark, path, bytes(got[0].content))
    return path


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a file through Spark's file systems."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        for k in range(0, len(data), 1 << 20):
            out.write(bytearray(data[k : k + (1 << 20)]))
    finally:
        out.close()


def take(spark: SparkSession, path: str) -> bytes:
    """Read a small file through Spark's file systems."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


# --- other grids on this one ------------------------------------------------------------------------


def resample(cells: DataFrame, source: GridInfo, target: GridInfo, method: str = "bilinear", back=None) -> DataFrame:
    """(r, c, z) of the target grid: at its cell centres, carried to the source by ``back`` (columns x, y to columns x, y; none if both share a coordinate system), the
    value of the cell there (``near``, for classes) or the weighted mean of the valid ones of the four around (``bilinear``), where the nearest is valid."""
    if method not in ("near", "bilinear"):
        raise ValueError(f"resampling {method}")
    spark = cells.sparkSession
    grid = spark.range(target.rows * target.cols).select(F.expr(f"cast(id div {target.cols} as int)").alias("r"), F.expr(f"cast(id % {target.cols} as int)").alias("c"))
    x, y = target.x(F.col("c")), target.y(F.col("r"))
    if back is not None:
        x, y = back(x, y)
    at = grid.withColumn("fc", (x - source.x0) / source.cw - 0.5).withColumn("fr", (F.lit(source.y0) - y) / source.ch - 0.5)
    own = cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "z")
    nearest = at.withColumn("sr", F.floor(F.col("fr") + 0.5).cast("int")).withColumn("sc", F.floor(F.col("fc") + 0.5).cast("int")).join(own, ["sr", "sc"])
    if method == "near":
        return nearest.select("r", "c", "z")
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    u, v = F.col("fc") - F.floor("fc"), F.col("fr") - F.floor("fr")
    four = nearest.select("r", "c", "fc", "fr").withColumn("k", corner).select("r", "c", (F.floor("fr") + F.col("k.i")).cast("int").alias("sr"), (F.floor("fc") + F.col("k.j")).cast("int").alias("sc"), (F.when(F.col("k.j") == 1, u).otherwise(1 - u) * F.when(F.col("k.i") == 1, v).otherwise(1 - v)).alias("w"))
    got = four.join(own, ["sr", "sc"]).groupBy("r", "c").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))
    return got.filter(F.col("z").isNotNull())


def transform_bounds(bounds: tuple[float, float, float, float], forward, steps: int = 21) -> tuple[float, float, float, float]:
    """(xmin, ymin, xmax, ymax) after ``forward`` (x, y to x, y) of points along the box's edges."""
    a, b, c, d = bounds
    t = [k / (steps - 1) for k in range(steps)]
    points = [forward(a + s * (c - a), y) for s in t for y in (b, d)] + [forward(x, b + s * (d - b)) for s in t for x in (a, c)]
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)
