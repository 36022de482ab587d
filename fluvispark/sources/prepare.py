"""Grids carried to another coordinate system, and elevation models prepared for drainage work.

A warp is one shuffle: every source cell is sent to the tiles of the target grid that its value can reach (its place there by the forward transform, give or take the
kernel's width), and each target tile then interpolates at its own cell centres, carried back by the inverse transform. Tiles are of a fixed size; a tile's task holds it and the
part of the source below it.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import projection
from ..operators import conditioning
from . import raster
from .grids import GridInfo, cut

#: half widths of the kernels, in source cells (or target cells, where those are larger)
METHODS = {"near": 0.5, "bilinear": 1.0, "cubic": 2.0}
Carry = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _same(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, y


def fractional(info: GridInfo, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column, as real numbers, of points; a cell's centre has its whole numbers."""
    return (info.y0 - y) / info.ch - 0.5, (x - info.x0) / info.cw - 0.5


def tent(d: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(d))


def cubic(d: np.ndarray) -> np.ndarray:
    """Catmull and Rom's convolution kernel."""
    d = np.abs(d)
    return np.where(d < 1, (1.5 * d - 2.5) * d * d + 1, np.where(d < 2, ((2.5 - 0.5 * d) * d - 4) * d + 2, 0))


def stretch(source: GridInfo, target: GridInfo, forward: Carry, steps: int = 9) -> tuple[float, float]:
    """Target rows and target columns that a source cell spans at most, over points spread on the target grid's part of the source."""
    r, c = np.meshgrid(np.linspace(0, source.rows - 1, steps), np.linspace(0, source.cols - 1, steps), indexing="ij")
    x, y = source.x0 + (c + 0.5) * source.cw, source.y0 - (r + 0.5) * source.ch
    here = fractional(target, *forward(x, y))
    moved = [fractional(target, *forward(x + source.cw, y)), fractional(target, *forward(x, y - source.ch))]
    spans = [sum(np.abs(m[k] - here[k]) for m in moved) for k in (0, 1)]
    return tuple(float(np.nanmax(np.where(np.isfinite(s), s, np.nan))) for s in spans)


def warp(cells: DataFrame, source: GridInfo, target: GridInfo, forward: Carry = _same, back: Carry = _same, method: str = "bilinear", tile: int = 256) -> DataFrame:
    """(r, c, z) of the target grid at its cell centres.

    ``forward`` carries x, y of the source's system to the target's, ``back`` the other way. ``near``: the value of the source cell there. ``bilinear`` and ``cubic``: the mean of the
    valid cells around, weighted by a tent or a cubic kernel in source cells, or in target cells where those are larger, so that no source cell is skipped on a coarser grid; where
    the nearest source cell is valid. Cells without a value have no row.
    """
    if method not in METHODS:
        raise ValueError(f"resampling {method}")
    rows, cols = stretch(source, target, forward)
    wide = (max(1.0, 1 / max(rows, 1e-12)), max(1.0, 1 / max(cols, 1e-12))) if method != "near" else (1.0, 1.0)
    half, kernel = METHODS[method], cubic if method == "cubic" else tent
    # how far, in target cells, a source cell's value reaches; more than half a cell besides for what the transform bends within a tile
    reach = (half * wide[0] * rows + rows + 1.5, half * wide[1] * cols + cols + 1.5)

    def deal(batches):
        for pdf in batches:
            r, c, z = pdf.r.to_numpy(np.int64), pdf.c.to_numpy(np.int64), pdf.z.to_numpy(float)
            fr, fc = fractional(target, *forward(source.x0 + (c + 0.5) * source.cw, source.y0 - (r + 0.5) * source.ch))
            keep = np.isfinite(z) & (fr >= -reach[0]) & (fr <= target.rows - 1 + reach[0]) & (fc >= -reach[1]) & (fc <= target.cols - 1 + reach[1])
            r, c, z, fr, fc = (a[keep] for a in (r, c, z, fr, fc))
            span = lambda f, m, most: (np.clip(f - m, 0, most).astype(np.int64) // tile, np.clip(np.ceil(f + m), 0, most).astype(np.int64) // tile)
            (top, bottom), (left, right) = span(fr, reach[0], target.rows - 1), span(fc, reach[1], target.cols - 1)
            for i in range(int((bottom - top).max(initial=-1)) + 1):
                for j in range(int((right - left).max(initial=-1)) + 1):
                    own = (top + i <= bottom) & (left + j <= right)
                    yield pd.DataFrame({"tr": top[own] + i, "tc": left[own] + j, "r": r[own], "c": c[own], "z": z[own]})

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile, key[1] * tile
        tr, tc = np.meshgrid(np.arange(r0, min(r0 + tile, target.rows)), np.arange(c0, min(c0 + tile, target.cols)), indexing="ij")
        fr, fc = fractional(source, *back(target.x0 + (tc + 0.5) * target.cw, target.y0 - (tr + 0.5) * target.ch))
        sr, sc = pdf.r.to_numpy(np.int64), pdf.c.to_numpy(np.int64)
        top, left = int(sr.min()), int(sc.min())
        part = np.full((int(sr.max()) - top + 1, int(sc.max()) - left + 1), np.nan)
        part[sr - top, sc - left] = pdf.z.to_numpy(float)

        def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
            i, j = r - top, c - left
            ok = (i >= 0) & (i < part.shape[0]) & (j >= 0) & (j < part.shape[1])
            return np.where(ok, part[np.clip(i, 0, part.shape[0] - 1), np.clip(j, 0, part.shape[1] - 1)], np.nan)

        fr, fc = np.where(np.isfinite(fr), fr, -9e15), np.where(np.isfinite(fc), fc, -9e15)
        nearest = at(np.floor(fr + 0.5).astype(np.int64), np.floor(fc + 0.5).astype(np.int64))
        value = nearest
        if method != "near":
            total, weight = np.zeros(fr.shape), np.zeros(fr.shape)
            low = np.floor(fr).astype(np.int64), np.floor(fc).astype(np.int64)
            steps = [range(1 - math.ceil(half * w), math.ceil(half * w) + 1) for w in wide]
            for i in steps[0]:
                wr = kernel((low[0] + i - fr) / wide[0])
                for j in steps[1]:
                    v = at(low[0] + i, low[1] + j)
                    w = np.where(np.isnan(v), 0, wr * kernel((low[1] + j - fc) / wide[1]))
                    total += w * np.where(np.isnan(v), 0, v)
                    weight += w
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(weight > 1e-9, total / weight, np.nan)
        ok = np.isfinite(value) & np.isfinite(nearest)
        return pd.DataFrame({"r": tr[ok], "c": tc[ok], "z": value[ok]})

    dealt = cells.select("r", "c", F.col("z").cast("double").alias("z")).mapInPandas(deal, "tr long, tc long, r long, c long, z double")
    return dealt.groupBy("tr", "tc").applyInPandas(fill, "r int, c int, z double")


def warp_between(cells: DataFrame, source: GridInfo, target: GridInfo, source_epsg: int | None, target_epsg: int | None, method: str = "bilinear", tile: int = 256) -> DataFrame:
    """``warp`` between the systems of two EPSG codes; an error if the source's is missing or either is unknown."""
    a, b = projection.system(source_epsg), projection.system(target_epsg)
    return warp(cells, source, target, projection.carry(a, b), projection.carry(b, a), method, tile)


def warp_to_grid(spark: SparkSession, path: str, target: GridInfo, target_epsg: int | None, method: str = "bilinear", band: int = 1) -> tuple[DataFrame, str]:
    """(cells (r, c, z) of the file or files at ``path`` on the target grid, how they were made); of the files only the blocks below the target are read.

    A target without a system takes the file as it is. A file without one is refused where the target has one: it is not guessed.
    """
    found = raster.headers(spark, path).orderBy("path").collect()  # one row a file
    if not found:
        raise raster.RasterError(f"no file at {path}")
    codes = {h.epsg for h in found}
    if len(codes) > 1:
        raise ValueError("the files are in different coordinate systems")
    source = whole(found)
    own = codes.pop() if target_epsg is not None else None
    if target_epsg is not None and own is None:
        raise ValueError(f"{path} has no coordinate system; it is not guessed")
    a, b = (projection.system(own), projection.system(target_epsg)) if target_epsg is not None else (projection.Geographic(),) * 2
    window = needed(source, target, projection.carry(b, a), projection.carry(a, b))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    cells, _ = raster.read_grid(spark, path, band=band, window=window)
    return warp(cells, source, target, projection.carry(a, b), projection.carry(b, a), method), f"{name} (resampled {method} to the grid)"


def whole(found: list) -> GridInfo:
    """The common grid of files, by their header rows."""
    cw, ch = found[0].cw, found[0].ch
    x0, y0 = min(h.x0 for h in found), max(h.y0 for h in found)
    return GridInfo(max(round((y0 - h.y0) / ch) + h.rows for h in found), max(round((h.x0 - x0) / cw) + h.cols for h in found), x0, y0, cw, ch)


def bounds(info: GridInfo) -> tuple[float, float, float, float]:
    return info.x0, info.y0 - info.rows * info.ch, info.x0 + info.cols * info.cw, info.y0


def needed(source: GridInfo, target: GridInfo, back: Carry, forward: Carry) -> tuple[int, int, int, int]:
    """Rows and columns of the source that lie below the target, with a margin of the widest kernel and two cells."""
    box = raster.transform_bounds(bounds(target), lambda x, y: back(float(x), float(y)))
    rows, cols = stretch(source, target, forward)
    (top, left), (bottom, right) = fractional(source, box[0], box[3]), fractional(source, box[2], box[1])
    mr, mc = math.ceil(2 / max(min(rows, 1.0), 1e-12)) + 2, math.ceil(2 / max(min(cols, 1.0), 1e-12)) + 2
    return max(0, math.floor(top) - mr), min(source.rows, math.ceil(bottom) + mr + 1), max(0, math.floor(left) - mc), min(source.cols, math.ceil(right) + mc + 1)


def native_cell_m(info: GridInfo, epsg: int | None, lat: float = 0.0, unit_m: float = 1.0) -> tuple[float, float]:
    """A grid's cell in metres, in x and y: degrees at the latitude of its centre, other units by ``unit_m``."""
    if epsg is not None and not projection.system(epsg).metric:
        # lengths along the parallel and the meridian of the ellipsoid
        e2, phi = projection.ECCENTRICITY**2, math.radians(lat)
        w = 1 - e2 * math.sin(phi) ** 2
        return info.cw * math.radians(1) * projection.RADIUS * math.cos(phi) / math.sqrt(w), info.ch * math.radians(1) * projection.RADIUS * (1 - e2) / w**1.5
    return info.cw * unit_m, info.ch * unit_m


@dataclass
class Prepared:
    """An elevation model on a metric grid, and how it came about."""

    cells: DataFrame
    info: GridInfo
    epsg: int
    log: dict = field(default_factory=dict)


def prepare(spark: SparkSession, path: str, target: int | None = None, cell_m: float | None = None, method: str = "bilinear", clip: tuple[float, float, float, float] | None = None, clip_epsg: int | None = None, buffer_m: float = 2000.0, nodata: float | None = None, audits: bool = True) -> Prepared:
    """Merge the files at ``path``, clip, carry to a metric system, and audit before and after.

    ``target``: an EPSG code; None takes the UTM zone of the centre (of ``clip``, if given). ``cell_m``: None takes the source's cell in metres, the larger side, to a decimetre. The target
    grid's edges are multiples of the cell. ``clip``: xmin, ymin, xmax, ymax in ``clip_epsg`` (None: the files' system), widened by ``buffer_m``. Refused: files without
    a coordinate system or in several, a target in degrees, the method ``near`` (it repeats rows and columns). Audits of large grids look at the middle 4 million cells.
    """
    if method == "near":
        raise ValueError("nearest neighbour repeats rows and columns of the source and makes false flats")
    found = raster.headers(spark, path).orderBy("path").collect()  # one row a file
    if not found:
        raise ValueError("give at least one elevation file")
    codes = {h.epsg for h in found}
    if None in codes:
        raise ValueError("a file has no coordinate system")
    if len(codes) > 1:
        raise ValueError("the files are in different coordinate systems; give tiles of one product")
    own, source = codes.pop(), whole(found)
    a, degrees = projection.system(own), projection.Geographic()
    through = lambda box, s, t: raster.transform_bounds(box, lambda x, y: projection.carry(s, t)(float(x), float(y)))
    box = through(clip, projection.system(clip_epsg or own), degrees) if clip else through(bounds(source), a, degrees)
    lon, lat = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2
    epsg = target or projection.utm_of(lon, lat)
    b = projection.system(epsg)
    if not b.metric:
        raise ValueError("the target is in degrees; a projected system in metres is needed")
    native = native_cell_m(source, own, lat)
    cell = float(cell_m) if cell_m is not None else round(max(native), 1)
    if cell <= 0:
        raise ValueError("the cell size must be positive")
    extent = through(bounds(source), a, b)
    if clip:
        c = through(clip, projection.system(clip_epsg or own), b)
        extent = (c[0] - buffer_m, c[1] - buffer_m, c[2] + buffer_m, c[3] + buffer_m)
    info = aligned(extent, cell)
    forward, back = projection.carry(a, b), projection.carry(b, a)
    cells, _ = raster.read_grid(spark, path, nodata=nodata, window=needed(source, info, back, forward))
    out = cut(warp(cells, source, info, forward, back, method), "prepared")
    corners = {projection.utm_of(x, y) for x in (box[0], box[2]) for y in (box[1], box[3])}
    log = {
        "inputs": [h.path for h in found], "input_epsg": own, "input_cell": (source.cw, source.ch), "input_cell_m": native, "target_epsg": epsg, "chosen": "given" if target else "by centre", "centre": (lon, lat), "cell_m": cell, "method": method,
        "nodata": nodata, "buffer_m": buffer_m if clip else None, "bounds": bounds(info), "rows": info.rows, "cols": info.cols, "zones": len(corners),
        "note": "the extent spans several UTM zones; that of its centre is used" if target is None and len(corners) > 1 else "",
    }
    if audits:
        before = conditioning.audit(conditioning.central_window(cells, source), source).first().asDict()
        after = conditioning.audit(conditioning.central_window(out, info), info).first().asDict()
        worn = before["repeated_row_share"] >= 0.002 or before["repeated_col_share"] >= 0.002
        log |= {"audit_input": before, "audit_output": after, "native_estimate_m": tuple(m / max(1e-9, 1 - before[f"repeated_{k}_share"]) for m, k in zip(native, ("col", "row"), strict=True))}
        log |= {"damaged_before": worn, "advice": "the input repeats rows or columns: get the product on its own grid" if worn else ""}
    return Prepared(out, info, epsg, log)


def aligned(extent: tuple[float, float, float, float], cell: float) -> GridInfo:
    """The grid of square cells whose edges are multiples of the cell and that covers the extent."""
    a, b, c, d = math.floor(extent[0] / cell + 1e-9), math.floor(extent[1] / cell + 1e-9), math.ceil(extent[2] / cell - 1e-9), math.ceil(extent[3] / cell - 1e-9)
    return GridInfo(d - b, c - a, a * cell, d * cell, cell, cell)
