"""Changes of a surface before routing: channels burnt through the road, clipping to what drains to it, and the audit of a grid."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import GridInfo, cut
from . import coverage, fill, graph, stencil
from .geometry import line_cells

LOG = "uid string, cells int, max_cut_m double, cut_m3 double, z_up double, z_down double, length_m double, note string"


def _lowest(z: dict[tuple[int, int], float], r: int, c: int, radius: int, fits) -> tuple[int, int] | None:
    """The lowest known cell within ``radius`` that ``fits``, the first in row order of equal ones."""
    near = [(z[i, j], i, j) for i in range(r - radius, r + radius + 1) for j in range(c - radius, c + radius + 1) if (i, j) in z and fits(i, j)]
    return min(near)[1:] if near else None


def burn(cells: DataFrame, crossings: DataFrame, info: GridInfo, half_m: float = 30.0, search: int = 2, min_grade: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(cells (r, c, z) with a channel cut at every crossing, log (``LOG``)); nothing is raised.

    ``crossings`` is (uid, pos, x, y, azimuth_deg), the direction of the road. A channel runs straight between the lowest cells within ``search`` cells of points ``half_m`` to either side, each on its own side
    of the road, at an even grade (at least ``min_grade``). Crossings whose surroundings overlap are one group and are cut in the order of ``pos``; the rest know nothing of each other.
    """
    reach = int(math.ceil(half_m / min(info.cw, info.ch))) + search + 2
    own = crossings.select(F.col("uid").cast("string").alias("uid"), F.col("pos").cast("long").alias("pos"), "x", "y", "azimuth_deg", info.row(F.col("y")).alias("r0"), info.col(F.col("x")).alias("c0"))
    own = cut(own, "crossings")
    # squares of twice the reach: crossings whose surroundings overlap lie in the same or adjoining ones
    side = 2 * reach + 1
    binned = own.withColumn("br", F.floor(F.col("r0") / side)).withColumn("bc", F.floor(F.col("c0") / side))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    around = binned.withColumn("m", near).select(F.col("pos").alias("other"), F.col("r0").alias("r1"), F.col("c0").alias("c1"), (F.col("br") + F.col("m.i")).alias("br"), (F.col("bc") + F.col("m.j")).alias("bc"))
    touch = binned.join(around, ["br", "bc"]).filter((F.col("other") > F.col("pos")) & (F.abs(F.col("r0") - F.col("r1")) < side) & (F.abs(F.col("c0") - F.col("c1")) < side)).select(F.col("pos").alias("a"), F.col("other").alias("b"))
    group = graph.components(touch)
    own = own.join(group.withColumnRenamed("id", "pos"), "pos", "left").withColumn("g", F.coalesce("component", "pos"))
    own = cut(own.drop("component"), "groups")
    window = own.withColumn("r", F.explode(F.sequence(F.col("r0") - reach, F.col("r0") + reach))).withColumn("c", F.explode(F.sequence(F.col("c0") - reach, F.col("c0") + reach))).select("g", "r", "c").distinct()
    here = window.join(cells.filter("z is not null").select("r", "c", "z"), ["r", "c"])

    def run(key: tuple, ground: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        z = {(r, c): v for r, c, v in zip(ground.r.tolist(), ground.c.tolist(), ground.z.tolist(), strict=True)}
        changed, rows = set(), []
        for m in marks.sort_values("pos").itertuples():
            angle = math.radians(m.azimuth_deg)
            left = (-math.cos(angle), math.sin(angle))  # of the road's direction (sin, cos)
            ends = []
            for sign in (1.0, -1.0):
                r = min(max(math.floor((info.y0 - m.y - sign * half_m * left[1]) / info.ch), 0), info.rows - 1)
                c = min(max(math.floor((m.x + sign * half_m * left[0] - info.x0) / info.cw), 0), info.cols - 1)
                beside = lambda i, j: sign * ((info.x0 + (j + 0.5) * info.cw - m.x) * left[0] + (info.y0 - (i + 0.5) * info.ch - m.y) * left[1]) > 0.5 * max(info.cw, info.ch)  # noqa: B023, E731
                ends.append(_lowest(z, r, c, search, beside))
            log = {"uid": m.uid, "cells": 0, "max_cut_m": 0.0, "cut_m3": 0.0, "z_up": None, "z_down": None, "length_m": 0.0, "note": None}
            if None in ends:
                rows.append(log | {"note": "no valid cells at one end; not burnt"})
                continue
            up, down = sorted(ends, key=lambda e: -z[e])
            way = line_cells(up, down)
            at = np.concatenate(([0.0], np.cumsum([math.hypot((q[1] - p[1]) * info.cw, (q[0] - p[0]) * info.ch) for p, q in zip(way, way[1:], strict=False)])))
            if at[-1] <= 0:
                rows.append(log | {"note": "the ends coincide; not burnt"})
                continue
            high, low = z[up], min(z[down], z[up] - min_grade * at[-1])
            cuts = []
            for p, s in zip(way, at.tolist(), strict=True):
                grade = high + (low - high) * s / at[-1]
                if p in z and z[p] > grade:
                    cuts.append(z[p] - grade)
                    z[p] = grade
                    changed.add(p)
            rows.append(log | {"cells": len(cuts), "max_cut_m": max(cuts, default=0.0), "cut_m3": sum(cuts) * info.cw * info.ch, "z_up": high, "z_down": low, "length_m": float(at[-1])})
        out = pd.DataFrame(rows)
        cells_ = pd.DataFrame([{"r": r, "c": c, "z": z[r, c]} for r, c in sorted(changed)], columns=["r", "c", "z"])
        return pd.concat([out, cells_]).reindex(columns=[x.split()[0] for x in f"{LOG}, r int, c int, z double".split(", ")])

    got = cut(here.groupBy("g").cogroup(own.select(*[F.col(c).alias(c) for c in ("g", "uid", "pos", "x", "y", "azimuth_deg")]).groupBy("g")).applyInPandas(run, f"{LOG}, r int, c int, z double"), "burnt")
    low = got.filter("r is not null").select("r", "c", F.col("z").alias("_z"))
    burnt = cells.join(low, ["r", "c"], "left").withColumn("z", F.least("z", F.coalesce("_z", "z"))).drop("_z")
    return burnt, got.filter("uid is not null").select(*[x.split()[0] for x in LOG.split(", ")])


def drains_to(flow: DataFrame, marked: DataFrame, info: GridInfo) -> DataFrame:
    """(id): the cells of ``flow`` (id, parent) whose way down reaches a marked cell (id), the marked ones included."""
    nodes = flow.select("id", "parent").join(marked.select("id", F.lit(True).alias("marked")).distinct(), "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    return graph.descend(nodes, info=info).filter("target is not null").select("id")


def dilate_square(mask: DataFrame, n: int, info: GridInfo) -> DataFrame:
    """Distinct (r, c) of the grid within ``n`` cells of ``mask``, rows first, then columns."""
    rows = mask.select(F.explode(F.sequence(F.greatest(F.col("r") - n, F.lit(0)), F.least(F.col("r") + n, F.lit(info.rows - 1)))).alias("r"), "c").distinct()
    return rows.select("r", F.explode(F.sequence(F.greatest(F.col("c") - n, F.lit(0)), F.least(F.col("c") + n, F.lit(info.cols - 1)))).alias("c")).distinct()


def coarse_factor(rows: int, cols: int, max_cells: float = 4e6) -> int:
    """The least k for which blocks of k x k cells are at most ``max_cells``."""
    return max(1, math.ceil(math.sqrt(rows * cols / max_cells)))


def autoclip(cells: DataFrame, segments: DataFrame, info: GridInfo, buffer_m: float = 200.0, margin_m: float = 1000.0, k: int | None = None, pad: int = 2) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """(blocks (br, bc) to keep, window (first row, row after the last, first column, column after the last)): what drains to the road, and the road itself, on a coarse copy of block minima, widened by the margin."""
    k = k or coarse_factor(info.rows, info.cols)
    small = GridInfo(-(-info.rows // k), -(-info.cols // k), info.x0, info.y0, info.cw * k, info.ch * k)
    low = cut(stencil.block_min(cells, k).select(F.col("br").alias("r"), F.col("bc").alias("c"), F.col("z_min").alias("z")), "coarse")
    surface = cut(fill.fill_depressions(low, small).select("r", "c", F.col("filled").alias("z")), "coarse-filled")
    flow = fill.resolve_flats(stencil.d8_surface(surface, small), small)
    flow = cut(graph._valid(graph.with_receiver(flow, small)), "coarse-flow")
    road = coverage.road_cells(segments, small, buffer_m, per_cell=3.0).join(flow.select("id", "r", "c"), ["r", "c"])
    up = drains_to(flow, road, small).join(flow.select("id", "r", "c"), "id").select("r", "c").union(road.select("r", "c")).distinct()
    n = math.ceil(margin_m / min(small.cw, small.ch)) + pad
    keep = cut(dilate_square(up, n, small).join(low.select("r", "c"), ["r", "c"], "left_semi"), "kept")
    box = keep.agg(F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("x"), F.max("c").alias("y")).first()
    if box.a is None:
        raise ValueError("the road does not cross the grid")
    window = (box.a * k, min((box.b + 1) * k, info.rows), box.x * k, min((box.y + 1) * k, info.cols))
    return keep.select(F.col("r").alias("br"), F.col("c").alias("bc")), window


def clipped(cells: DataFrame, info: GridInfo, window: tuple[int, int, int, int], blocks: DataFrame | None = None, k: int = 1) -> tuple[DataFrame, GridInfo]:
    """(cells of the window, only those of ``blocks`` if given, with rows and columns of its own; its georeference)."""
    a, b, x, y = window
    own = cells.filter(F.col("r").between(a, b - 1) & F.col("c").between(x, y - 1))
    if blocks is not None:
        own = own.join(blocks, (F.floor(F.col("r") / k) == F.col("br")) & (F.floor(F.col("c") / k) == F.col("bc")), "left_semi")
    return own.withColumn("r", F.col("r") - a).withColumn("c", F.col("c") - x), GridInfo(b - a, y - x, info.x0 + x * info.cw, info.y0 - a * info.ch, info.cw, info.ch)


def touches_edge(member: DataFrame, cells: DataFrame, info: GridInfo) -> DataFrame:
    """(outlet, touches): whether any cell of a zone (outlet, id) lies on the grid's edge or beside a cell without data."""
    edge = stencil.boundary(cells.select("r", "c", "z")).filter("boundary = 1").select((F.col("r").cast("long") * info.cols + F.col("c")).alias("id"), F.lit(1).alias("b"))
    return member.join(edge, "id", "left").groupBy("outlet").agg(F.coalesce(F.max("b"), F.lit(0)).alias("touches"))


def truncation(member: DataFrame, cells: DataFrame, outlets: DataFrame, info: GridInfo) -> DataFrame:
    """(outlet, truncated_cells, truncated): cells of a zone on the valid boundary, but for the 3 x 3 around its outlet (outlet, id)."""
    edge = stencil.boundary(cells.select("r", "c", "z")).filter("boundary = 1").select((F.col("r").cast("long") * info.cols + F.col("c")).alias("id"))
    r, c = (lambda x: F.expr(f"{x} div {info.cols}")), (lambda x: F.expr(f"{x} % {info.cols}"))
    hit = member.join(edge, "id").join(outlets.select("outlet", F.col("id").alias("at")), "outlet").filter((F.abs(r("id") - r("at")) > 1) | (F.abs(c("id") - c("at")) > 1)).groupBy("outlet").agg(F.count("*").alias("truncated_cells"))
    return outlets.select("outlet").distinct().join(hit, "outlet", "left").withColumn("truncated_cells", F.coalesce("truncated_cells", F.lit(0).cast("long"))).withColumn("truncated", (F.col("truncated_cells") > 0).cast("int"))


# --- audits -------------------------------------------------------------------------------------------


def central_window(cells: DataFrame, info: GridInfo, max_cells: int = 4_000_000) -> DataFrame:
    """The cells of a square of at most ``max_cells`` in the grid's middle; all of them if the grid is no larger. Audits of neighbours on a large grid may use it; it is the caller's choice."""
    if info.rows * info.cols <= max_cells:
        return cells
    side = int(max_cells**0.5)
    a, x = max((info.rows - side) // 2, 0), max((info.cols - side) // 2, 0)
    return cells.filter(F.col("r").between(a, a + side - 1) & F.col("c").between(x, x + side - 1))


def audit(cells: DataFrame, info: GridInfo) -> DataFrame:
    """One row: everything that the audits of a grid say, with verdicts.

    ``nodata``: values held by many cells far below the rest. ``resampling``: rows or columns that repeat the one before (0.2 % of them), or, on continuous or centimetre
    elevations, ties on sloping ground (2 % of the pairs). ``precision``: the mean steepest drop against the elevation step, below 1 ``warning``, below 10 ``caution``.
    """
    lines = stencil.repeated_lines(cells).groupBy("axis").agg(F.sum(F.col("repeated").cast("int")).alias("repeated"), F.sum((F.col("n") >= 50).cast("int")).alias("compared"))
    lines = lines.select("axis", F.coalesce("repeated", F.lit(0)).alias("n"), (F.coalesce("repeated", F.lit(0)) / F.greatest("compared", F.lit(1))).alias("share"))
    per = lines.agg(*[F.coalesce(F.max(F.when(F.col("axis") == a, F.col(v))), F.lit(0)).alias(f"repeated_{a}_{v}") for a in ("row", "col") for v in ("n", "share")])
    ties = stencil.sloped_ties(cells)
    pairs = stencil.tied_pairs(cells)
    step, drop = stencil.vertical_quantum(cells), stencil.mean_drop(cells, info)
    suspect = stencil.nodata_suspects(cells).agg(F.max(F.when(F.col("suspect"), F.col("value"))).alias("nodata"))
    out = per.join(ties).join(pairs).join(step).join(drop).join(suspect)  # one row each
    sloped = F.col("n_tied") / F.greatest("n_all_pairs", F.lit(1))
    worst = F.greatest("repeated_row_share", "repeated_col_share")
    out = out.withColumn("sloped_tied_share", sloped).withColumn("tied_share", F.col("n_all_tied") / F.greatest("n_all_pairs", F.lit(1)))
    out = out.withColumn("resampling", F.when(worst >= 0.002, "repeated lines").when((F.col("quantum").isNull() | (F.col("quantum") <= 0.01)) & (sloped >= 0.02), "tied cells").otherwise("ok"))
    ratio = F.col("mean_drop") / F.col("quantum")
    return out.withColumn("precision_ratio", ratio).withColumn("precision", F.when(ratio < 1, "warning").when(ratio < 10, "caution").otherwise("ok")).drop("n_pairs", "n_tied", "n_all_pairs", "n_all_tied")
