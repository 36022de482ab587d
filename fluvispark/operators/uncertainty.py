"""Elevation-error Monte Carlo: correlated Gaussian fields added to a grid, routed anew by the operators of any grid, and what that does to each crossing.

A field is a function of seed, realisation and cell: white noise comes from a counter-based generator, so a tile makes the noise of its own surroundings and smooths it, and agrees
with its neighbours without an exchange. Realisations are laid one below the other on one tall grid, with rows without data between; filling, flats, accumulation,
snapping and longest paths then run over all of them at once, distributed as for any grid of that size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..sources.grids import GridInfo, cut
from . import drainage, fill, graph, stencil
from .stencil import TILE

# fixed values: published vertical errors (m) of two elevation models; no model is assumed
PRESETS = {"AW3D30": 4.4, "FABDEM": 2.5}
QUANTITIES = ("area_km2", "lfp_length_m", "lfp_slope_1085", "tc_kirpich_min")


def _mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def noise(rows: np.ndarray, cols: np.ndarray, seed: int, realisation: int) -> np.ndarray:
    """Independent standard normal numbers of the cells rows x cols, each a function of its row, column, seed and realisation alone."""
    step = np.uint64(0x9E3779B97F4A7C15)
    key = _mixed(_mixed(np.array([seed], np.int64).astype(np.uint64) + step) + np.array([realisation], np.int64).astype(np.uint64) * step)
    line = _mixed(key + (rows.astype(np.int64).astype(np.uint64) + np.uint64(1)) * step)
    a = _mixed(line[:, None] + (cols.astype(np.int64).astype(np.uint64) + np.uint64(1))[None, :] * step)
    b = _mixed(a ^ step)
    unit = lambda h: ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53
    return np.sqrt(-2 * np.log(unit(a))) * np.cos(2 * math.pi * unit(b))


def error_field(top: int, left: int, rows: int, cols: int, sigma: float, length: float, seed: int, realisation: int) -> np.ndarray:
    """The part from (top, left) of a field of standard deviation ``sigma`` with correlation exp(-(d / length)^2), distances in cells.

    White noise is weighted by exp(-2 (d / length)^2), rows first, then columns, out to three lengths, where the weight is 2e-8. The sums are made in one order, so any two windows agree to the last bit.
    """
    if sigma == 0:
        return np.zeros((rows, cols))
    reach = math.ceil(3 * length)
    d = np.arange(-reach, reach + 1)
    weight = np.exp(-2.0 * (d / max(length, 1e-6)) ** 2)
    white = noise(np.arange(top - reach, top + rows + reach), np.arange(left - reach, left + cols + reach), seed, realisation)
    half = sum(w * white[k : k + rows] for k, w in enumerate(weight))
    return sigma / float((weight * weight).sum()) * sum(w * half[:, k : k + cols] for k, w in enumerate(weight))


def realisations(cells: DataFrame, n: int, sigma: float | None, length_m: float, cell_m: float, seed: int = 2026, tile: int = TILE, together: int = 8) -> DataFrame:
    """(realisation, r, c, z): the surface (r, c, z) with the error of each of ``n`` realisations, and without as realisation 0. ``sigma`` has no default.

    A task makes ``together`` realisations of a tile; what is shuffled is the grid, once for every so many.
    """
    if sigma is None or sigma < 0:
        raise ValueError("the standard deviation of the elevation error must be given")
    length = length_m / cell_m

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile, int(key[1]) * tile
        r, c, z = pdf.r.to_numpy(np.int64), pdf.c.to_numpy(np.int64), pdf.z.to_numpy(float)
        out = []
        for k in range(int(key[2]), min(int(key[2]) + together, n + 1)):
            error = error_field(top, left, tile, tile, sigma, length, seed, k)[r - top, c - left] if k else 0.0
            out.append(pd.DataFrame({"realisation": k, "r": r, "c": c, "z": z + error}))
        return pd.concat(out)

    dealt = cells.select("r", "c", F.col("z").cast("double").alias("z")).filter("z is not null")
    dealt = dealt.withColumn("tr", F.expr(f"r div {tile}")).withColumn("tc", F.expr(f"c div {tile}")).withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(n), F.lit(together))))
    return dealt.groupBy("tr", "tc", "first").applyInPandas(run, "realisation long, r int, c int, z double")


def crossings(cells: DataFrame, points: DataFrame, info: GridInfo, n: int, sigma: float | None, length_m: float = 90.0, threshold_cells: float = 200.0, snap_cells: int = 5, seed: int = 2026, tile: int = TILE) -> DataFrame:
    """(realisation, uid, area_km2, lfp_length_m, lfp_slope_1085, tc_kirpich_min): each crossing (uid, x, y) in each realisation; null where it has lost its stream. ``sigma`` has no default."""
    every = realisations(cells, n, sigma, length_m, min(info.cw, info.ch), seed, tile)
    # one tall grid: each realisation begins at a tile's edge, with more empty rows above than a snap reaches
    step = -(-(info.rows + snap_cells + 2) // tile) * tile
    tall = GridInfo(step * (n + 1), info.cols, info.x0, info.y0, info.cw, info.ch)
    ground = cut(every.select((F.col("r") + F.col("realisation") * step).cast("int").alias("r"), "c", "z"), "realisations")
    surface = cut(fill.fill_depressions(ground, tall, tile=tile).select("r", "c", F.col("filled").alias("z")), "realisations-filled")
    routed = fill.resolve_flats(stencil.d8_surface(surface, tall), tall, tile=tile)
    flow = cut(graph.flow_accumulation(routed.select("r", "c", "dir"), tall, tile=tile), "realisations-flow")

    inside = F.col("x").between(info.x0, info.x0 + info.cols * info.cw) & F.col("y").between(info.y0 - info.rows * info.ch, info.y0)
    asked = points.select("uid", "x", "y").crossJoin(cells.sparkSession.range(n + 1).withColumnRenamed("id", "realisation"))  # crossings times realisations: the rows of the result
    asked = cut(asked.select(F.struct("realisation", "uid").alias("fid"), "x", (F.col("y") - F.col("realisation") * (step * info.ch)).alias("y"), F.coalesce(inside, F.lit(False)).alias("inside")), "realisations-points")
    stream = drainage.streams(flow, threshold_cells=threshold_cells)
    snapped = drainage.snap(asked.filter("inside"), stream, tall, snap_cells).select("fid", (F.col("snap_r").cast("long") * tall.cols + F.col("snap_c")).alias("id"))
    at = cut(snapped.join(stream.select("id", "acc"), "id").select(F.col("fid").alias("outlet"), "id", "acc"), "realisations-outlets")
    paths = cut(drainage.longest_paths(flow, at.select("outlet", "id"), tall), "realisations-paths")
    heights = ground.select((F.col("r").cast("long") * tall.cols + F.col("c")).alias("id"), "z")
    slopes = drainage.slope_1085(paths, heights).select("outlet", "length_m", "slope_1085")
    found = at.join(slopes, "outlet", "left").select(F.col("outlet").alias("fid"), ((F.col("acc") + 1) * info.cell_area_km2).alias("area_km2"), F.coalesce("length_m", F.lit(0.0)).alias("lfp_length_m"), F.col("slope_1085").alias("lfp_slope_1085"))
    time = F.when((F.col("lfp_length_m") > 0) & (F.col("lfp_slope_1085") > 0), H.kirpich(F.col("lfp_length_m"), F.col("lfp_slope_1085")))
    return asked.join(found, "fid", "left").select("fid.realisation", "fid.uid", "area_km2", "lfp_length_m", "lfp_slope_1085", time.alias("tc_kirpich_min"))


def summarise(rows: DataFrame, reference: DataFrame | None = None, switch: float = 0.25) -> DataFrame:
    """(uid, n, lost_pct, switch_pct, and for each quantity p10, p50, p90 and cv, note) of realisations.

    ``lost_pct`` counts realisations without a stream, ``switch_pct`` those whose area is off the error-free one by more than ``switch`` of it; both are shares of all realisations. Crossings without a stream in
    the error-free run, or whose area there is off their ``reference`` (uid, area_km2) by more than ``switch``, are not assessed: their values are null.
    """
    base = rows.filter("realisation = 0").select("uid", F.col("area_km2").alias("base"))
    if reference is not None:
        base = base.join(reference.select("uid", F.col("area_km2").alias("ref")), "uid", "left").withColumn("other", F.coalesce((F.col("ref") > 0) & (F.abs(F.col("base") - F.col("ref")) > switch * F.col("ref")), F.lit(False)))
        base = base.withColumn("base", F.when(~F.col("other"), F.col("base"))).drop("ref")
    else:
        base = base.withColumn("other", F.lit(False))
    own = rows.filter("realisation > 0").join(base, "uid")
    assessed = F.col("base").isNotNull()
    stats = []
    for q in QUANTITIES:
        v = F.when(assessed, F.col(q))
        stats += [F.percentile(v, p / 100).alias(f"{q}_p{p}") for p in (10, 50, 90)] + [F.when(F.avg(v) != 0, F.stddev_pop(v) / F.avg(v)).alias(f"{q}_cv")]
    moved = assessed & F.col("area_km2").isNotNull() & (F.abs(F.col("area_km2") - F.col("base")) > switch * F.col("base"))
    got = own.groupBy("uid").agg(F.count("*").alias("n"), (100 * F.sum(F.col("area_km2").isNull().cast("int")) / F.count("*")).alias("lost_pct"), F.when(F.first("base").isNotNull() & (F.count("area_km2") > 0), 100 * F.sum(F.coalesce(moved, F.lit(False)).cast("int")) / F.count("*")).alias("switch_pct"), *stats, F.first("base").alias("_b"), F.first("other").alias("_o"))
    note = F.when(F.col("_o"), "not assessed: another channel on the error-free surface").when(F.col("_b").isNull(), "not assessed: no stream on the error-free surface")
    return got.withColumn("note", note).drop("_b", "_o")


def length_sensitivity(cells: DataFrame, points: DataFrame, info: GridInfo, n: int, sigma: float, length_m: float = 90.0, factors=(0.5, 2.0), most: int = 3, **options) -> DataFrame:
    """(uid, factor, area_p50, area_cv) of the ``most`` crossings of the greatest area (uid, x, y, area_km2) at other correlation lengths."""
    largest = points.orderBy(F.desc("area_km2"), "uid").limit(most)
    out = None
    for f in factors:
        got = summarise(crossings(cells, largest, info, n, sigma, length_m * f, **options)).select("uid", F.lit(float(f)).alias("factor"), F.col("area_km2_p50").alias("area_p50"), F.col("area_km2_cv").alias("area_cv"))
        out = got if out is None else out.union(got)
    return out
