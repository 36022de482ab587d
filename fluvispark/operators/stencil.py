"""Neighbourhood operators on tiles with a halo.

A stencil deals every cell to its tile and border cells to the adjoining tiles as well, so that one
shuffle of little more than the grid itself serves any 3 x 3 (or wider) window; each tile is then a dense
array and the window is evaluated by whole-array arithmetic. Tiles are of a fixed size, so a task's memory
does not depend on the grid's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 256
# fixed values: direction index 0-7 is E, SE, S, SW, W, NW, N, NE; ties go to the lowest rank
OFFSETS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
TIE_RANK = (3, 4, 0, 5, 1, 6, 2, 7)

Kernel = Callable[[dict[str, np.ndarray], int], dict[str, np.ndarray]]


def stencil(cells: DataFrame, variables: list[str], kernel: Kernel, out: str, halo: int = 1, tile: int = TILE, keys: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``kernel`` to padded tiles of ``variables``; returns ``keys``, r, c and the columns ``out`` for the cells present.

    The kernel gets arrays of (rows + 2 halo, cols + 2 halo), up to the tile's last row and column that hold a cell, NaN where there is no cell, with the mask
    ``"present"``, and the halo's width; it returns arrays of the inner shape. A NaN result is null.
    """
    names = [x.split()[0] for x in out.split(", ")]
    tiles = lambda x: F.explode(F.sequence(F.expr(f"cast(greatest({x} - {halo}, 0) div {tile} as int)"), F.expr(f"cast(({x} + {halo}) div {tile} as int)")))
    dealt = cells.select(*keys, F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *[F.col(v).cast("double").alias(v) for v in variables])
    dealt = dealt.withColumn("tr", tiles("r")).withColumn("tc", tiles("c"))
    key_types = {f.name: f.dataType.simpleString() for f in cells.schema if f.name in keys}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tr, tc = key[-2], key[-1]
        r, c = pdf.r.to_numpy() - tr * tile + halo, pdf.c.to_numpy() - tc * tile + halo
        inner = (r >= halo) & (r < tile + halo) & (c >= halo) & (c < tile + halo)
        shape = (r[inner].max() + halo + 1, c[inner].max() + halo + 1) if inner.any() else (2 * halo + 1, 2 * halo + 1)
        seen = (r < shape[0]) & (c < shape[1])
        r, c = r[seen], c[seen]
        arrays = {}
        for v in variables:
            a = np.full(shape, np.nan)
            a[r, c] = pdf[v].to_numpy()[seen]
            arrays[v] = a
        present = np.zeros(shape, bool)
        present[r, c] = True
        arrays["present"] = present
        found = kernel(arrays, halo)
        rr, cc = np.nonzero(present[halo:-halo, halo:-halo])
        got = {k: np.full(len(rr), key[i], dtype=object) for i, k in enumerate(keys)}
        got |= {"r": rr + tr * tile, "c": cc + tc * tile}
        for n, kind in (x.split() for x in out.split(", ")):
            v = found[n][rr, cc]
            got[n] = v if kind == "double" or v.dtype.kind != "f" else pd.array(np.where(np.isnan(v), 0, v).astype(np.int64), "Int64")
            if kind != "double" and v.dtype.kind == "f":
                got[n][np.isnan(v)] = pd.NA
        return pd.DataFrame(got)

    schema = ", ".join([*[f"{k} {key_types[k]}" for k in keys], "r int", "c int", out])
    got = dealt.groupBy(*keys, "tr", "tc").applyInPandas(run, schema)
    doubles = [n for n, kind in (x.split() for x in out.split(", ")) if kind == "double"]
    return got.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in doubles}) if doubles else got


def shifted(a: np.ndarray, dr: int, dc: int, halo: int) -> np.ndarray:
    """The inner-shaped view of ``a`` displaced by (dr, dc)."""
    h, w = a.shape
    return a[halo + dr : h - halo + dr, halo + dc : w - halo + dc]


def distances(cw: float, ch: float) -> list[float]:
    return [float(np.hypot(dc * cw, dr * ch)) for dr, dc in OFFSETS]


# --- kernels ------------------------------------------------------------------------------------


def boundary_kernel(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
    valid = ~np.isnan(a["z"])
    count = sum(shifted(valid, dr, dc, h).astype(int) for dr, dc in OFFSETS)
    own = shifted(valid, 0, 0, h)
    return {"boundary": (own & (count < 8)).astype(np.int64), "valid_neighbours": count, "z": shifted(a["z"], 0, 0, h)}


def boundary(cells: DataFrame, keep: bool = False, **more) -> DataFrame:
    """boundary: 1 for valid cells on the grid's edge or beside NoData; and the number of valid neighbours. With ``keep`` z as well."""
    return stencil(cells, ["z"], boundary_kernel, "boundary int, valid_neighbours int" + ", z double" * keep, **more)


def horn_kernel(cw: float, ch: float, rows: int, cols: int):
    """Horn's 3 x 3 gradient; at the grid's edge the nearest row or column is repeated, beside NoData it is null."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        z = a["z"].copy()
        present = a["present"]
        # where nothing at all lies beyond, the edge of the grid is repeated outwards
        r, c = a["row"], a["col"]
        first = lambda x: x[~np.isnan(x)]
        rr, cc = first(r), first(c)
        if len(rr):
            i0, j0 = np.argwhere(present)[0]
            base_r, base_c = int(r[i0, j0]) - i0, int(c[i0, j0]) - j0
            top, left = max(0, -base_r), max(0, -base_c)
            bottom, right = min(z.shape[0], rows - base_r) - 1, min(z.shape[1], cols - base_c) - 1
            z[:top] = z[top]
            z[bottom + 1 :] = z[bottom]
            z[:, :left] = z[:, left : left + 1]
            z[:, right + 1 :] = z[:, right : right + 1]
        s = lambda dr, dc: shifted(z, dr, dc, h)
        gx = ((s(-1, 1) + 2 * s(0, 1) + s(1, 1)) - (s(-1, -1) + 2 * s(0, -1) + s(1, -1))) / (8 * cw)
        gy = ((s(1, -1) + 2 * s(1, 0) + s(1, 1)) - (s(-1, -1) + 2 * s(-1, 0) + s(-1, 1))) / (8 * ch)
        own = np.where(np.isnan(s(0, 0)), np.nan, 1.0)
        slope = np.hypot(gx, gy) * own
        own = np.where(np.isnan(slope), np.nan, 1.0)
        return {"dzdx": gx * own, "dzdy": gy * own, "slope": slope}

    return run


def horn(cells: DataFrame, info, **more) -> DataFrame:
    """dzdx (east), dzdy (south) and slope, all in m/m."""
    cells = cells.withColumn("row", F.col("r").cast("double")).withColumn("col", F.col("c").cast("double"))
    return stencil(cells, ["z", "row", "col"], horn_kernel(info.cw, info.ch, info.rows, info.cols), "dzdx double, dzdy double, slope double", **more)


def d8_kernel(cw: float, ch: float, column: str = "z"):
    """Steepest descent by drop over distance; near-ties (1e-6 relative) go to the lowest rank; no descent is null."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        z = a[column]
        own = shifted(z, 0, 0, h)
        drops = np.stack([(own - shifted(z, dr, dc, h)) / d for (dr, dc), d in zip(OFFSETS, distances(cw, ch), strict=True)])
        drops = np.where(np.isnan(drops), -np.inf, drops)
        best = drops.max(axis=0)
        rank = np.where(drops >= best * (1 - 1e-6), np.array(TIE_RANK)[:, None, None], 9)
        k = rank.argmin(axis=0)
        none = (best <= 0) | np.isnan(own)
        return {"dir": np.where(none, np.nan, k), "drop": np.where(none, np.nan, best)}

    return run


def d8(cells: DataFrame, info, column: str = "z", **more) -> DataFrame:
    """dir (0-7, null without descent) and drop (m/m) of the steepest descent."""
    return stencil(cells, [column], d8_kernel(info.cw, info.ch, column), "dir int, drop double", **more)


def d8_surface(cells: DataFrame, info, **more) -> DataFrame:
    """(r, c, dir, drop, boundary, z): ``d8`` and ``boundary`` of the cells in one pass, with their z."""
    descent = d8_kernel(info.cw, info.ch)

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        return descent(a, h) | boundary_kernel(a, h)

    return stencil(cells, ["z"], run, "dir int, drop double, boundary int, z double", **more)


def mean_drop(cells: DataFrame, info) -> DataFrame:
    """mean_drop: the mean over valid cells of the steepest drop in metres, 0 where there is none."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        z = a["z"]
        own = shifted(z, 0, 0, h)
        low = np.full(own.shape, np.inf)
        for dr, dc in OFFSETS:
            low = np.fmin(low, shifted(z, dr, dc, h))
        return {"d": np.where(np.isnan(own), np.nan, np.maximum(0, np.where(np.isinf(low), 0, own - low)))}

    return stencil(cells, ["z"], run, "d double").agg(F.avg("d").alias("mean_drop"), F.count("d").alias("n_cells"))


def sloped_ties(cells: DataFrame, relief: float = 0.1) -> DataFrame:
    """n_pairs, n_tied: east and south neighbour pairs whose 3 x 3 reliefs both exceed ``relief``, and those exactly equal."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        z = a["z"]
        pad = np.pad(z, 1, constant_values=np.nan)
        stack = np.stack([shifted(pad, dr, dc, 1) for dr, dc in ((0, 0), *OFFSETS)])
        with np.errstate(all="ignore"):
            rel = np.where(np.isnan(z), np.nan, np.nanmax(np.where(np.isnan(stack), -np.inf, stack), axis=0) - np.nanmin(np.where(np.isnan(stack), np.inf, stack), axis=0))
        steep = rel > relief
        s = lambda x, dr, dc: shifted(x, dr, dc, h)
        pairs = tied = 0
        for dr, dc in ((0, 1), (1, 0)):
            both = s(steep, 0, 0) & s(steep, dr, dc)
            pairs = pairs + both.astype(int)
            tied = tied + (both & (s(z, 0, 0) == s(z, dr, dc))).astype(int)
        return {"pairs": pairs, "tied": tied}

    return stencil(cells, ["z"], run, "pairs int, tied int", halo=2).agg(F.sum("pairs").alias("n_pairs"), F.sum("tied").alias("n_tied"))


def hillshade(cells: DataFrame, info, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """shade, 0 to 1, from Horn gradients."""
    az, alt = np.radians(azimuth), np.radians(altitude)
    g = horn(cells, info)
    norm = F.sqrt(1 + F.col("dzdx") ** 2 + F.col("dzdy") ** 2)
    light = (F.lit(float(np.sin(alt))) - F.col("dzdx") * float(np.cos(alt) * np.sin(az)) + F.col("dzdy") * float(np.cos(alt) * np.cos(az))) / norm
    return g.select("r", "c", F.greatest(F.lit(0.0), light).alias("shade"))


def window_max(cells: DataFrame, column: str, k: int) -> DataFrame:
    """The greatest value of ``column`` in the (2k+1)^2 window of each cell."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        best = np.full(shifted(a[column], 0, 0, h).shape, np.nan)
        for dr in range(-k, k + 1):
            for dc in range(-k, k + 1):
                best = np.fmax(best, shifted(a[column], dr, dc, h))
        return {"window_max": best}

    return stencil(cells, [column], run, "window_max double", halo=k)


def block_min(cells: DataFrame, k: int) -> DataFrame:
    """The least z of each k x k block, NoData left out."""
    return cells.filter("z is not null").groupBy(F.floor(F.col("r") / k).cast("int").alias("br"), F.floor(F.col("c") / k).cast("int").alias("bc")).agg(F.min("z").alias("z_min"), F.count("*").alias("n_cells"))


def downsample(cells: DataFrame, column: str, k: int, kind: str = "continuous") -> DataFrame:
    """Block mean, or the value of the block's centre cell for classes."""
    if kind == "continuous":
        return cells.groupBy(F.expr(f"r div {k}").cast("int").alias("br"), F.expr(f"c div {k}").cast("int").alias("bc")).agg(F.avg(column).alias(column))
    return cells.filter(f"r % {k} = {k // 2} and c % {k} = {k // 2}").select(F.expr(f"r div {k}").cast("int").alias("br"), F.expr(f"c div {k}").cast("int").alias("bc"), column)


def dilate(mask: DataFrame, offsets: list[tuple[int, int]], info) -> DataFrame:
    """Distinct (r, c) within the grid reached from ``mask`` by any of ``offsets``."""
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets])
    spread = mask.select("r", "c", F.explode(moves).alias("m")).select((F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    return spread.filter((F.col("r").between(0, info.rows - 1)) & (F.col("c").between(0, info.cols - 1))).distinct()


def square(n: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1)]


def disk(radius: float, cw: float, ch: float) -> list[tuple[int, int]]:
    nr, nc = int(radius // ch), int(radius // cw)
    return [(dr, dc) for dr in range(-nr, nr + 1) for dc in range(-nc, nc + 1) if (dr * ch) ** 2 + (dc * cw) ** 2 <= radius * radius]


# --- audits ---------------------------------------------------------------------------------------


def repeated_lines(cells: DataFrame, least_overlap: int = 50, share: float = 0.99) -> DataFrame:
    """(axis, line, n, n_equal, repeated): rows and columns that repeat the one before on nearly all valid overlapping cells."""
    parts = []
    for axis, other in (("r", "c"), ("c", "r")):
        a = cells.filter("z is not null").select(F.col(axis).alias("line"), F.col(other).alias("pos"), "z")
        b = a.select((F.col("line") + 1).alias("line"), "pos", F.col("z").alias("zb"))
        both = a.join(b, ["line", "pos"]).groupBy("line").agg(F.count("*").alias("n"), F.sum((F.col("z") == F.col("zb")).cast("long")).alias("n_equal"), F.min("z").alias("lo"), F.max("z").alias("hi"))
        parts.append(both.select(F.lit("row" if axis == "r" else "col").alias("axis"), "line", "n", "n_equal", ((F.col("n") >= least_overlap) & (F.col("n_equal") >= share * F.col("n")) & (F.col("lo") < F.col("hi"))).alias("repeated")))
    return parts[0].union(parts[1])


def tied_pairs(cells: DataFrame) -> DataFrame:
    """n_all_pairs, n_all_tied: east and south neighbour pairs, and those exactly equal."""

    def run(a: dict[str, np.ndarray], h: int) -> dict[str, np.ndarray]:
        z = a["z"]
        own, pairs, tied = shifted(z, 0, 0, h), 0, 0
        for dr, dc in ((0, 1), (1, 0)):
            other = shifted(z, dr, dc, h)
            pairs = pairs + (~np.isnan(own) & ~np.isnan(other)).astype(int)
            tied = tied + (own == other).astype(int)
        return {"pairs": pairs, "tied": tied}

    return stencil(cells, ["z"], run, "pairs int, tied int").agg(F.sum("pairs").alias("n_all_pairs"), F.sum("tied").alias("n_all_tied"))


# fixed values: steps of storage that are tried, largest first
STEPS = (1.0, 0.5, 0.25, 0.2, 0.1, 0.05, 0.02, 0.01)


def vertical_quantum(cells: DataFrame, share: float = 0.999) -> DataFrame:
    """quantum: the largest step of which nearly all elevations are multiples (null if none), over all valid cells."""
    z = cells.filter("z is not null")
    steps = F.array(*[F.lit(s) for s in STEPS])
    # tolerance: 2 % of the step, or 4 units in the last place of the greatest elevation in single precision
    off = F.abs(F.col("z") - F.round(F.col("z") / F.col("q")) * F.col("q"))
    most = z.agg(F.max(F.abs("z")).alias("m")).first().m or 0.0
    ulp = 4 * float(np.spacing(np.float32(most)))
    per = z.select("z", F.explode(steps).alias("q")).groupBy("q").agg(F.avg((off <= F.greatest(0.02 * F.col("q"), F.lit(ulp))).cast("double")).alias("share"))
    return per.agg(F.max(F.when(F.col("share") >= share, F.col("q"))).alias("quantum"))


# fixed values: what grids hold where their header says nothing of NoData
SUSPECTS = (0.0, -9999.0, -32768.0, -3.4028235e38)


def nodata_suspects(cells: DataFrame, share: float = 0.005, gap: float = 0.25) -> DataFrame:
    """(value, n, share, suspect) of values often used for NoData: suspect if more than ``share`` of the cells hold one that lies below all others by more than ``gap`` of their spread."""
    z = cells.filter("z is not null")
    suspects = F.array(*[F.lit(s) for s in SUSPECTS])
    hit = F.col("z").cast("float") == F.col("value").cast("float")
    per = z.select("z", F.explode(suspects).alias("value")).groupBy("value").agg(
        F.sum(hit.cast("long")).alias("n"), F.count("*").alias("total"), F.min(F.when(~hit, F.col("z"))).alias("lo"), F.max(F.when(~hit, F.col("z"))).alias("hi")
    )
    spread = F.col("hi") - F.col("lo")
    bad = (F.col("n") > share * F.col("total")) & (spread > 0) & (F.col("lo") - F.col("value") > gap * spread)
    return per.select("value", "n", (F.col("n") / F.col("total")).alias("share"), F.coalesce(bad, F.lit(False)).alias("suspect"))
