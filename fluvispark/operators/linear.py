"""Linear referencing: alignments, projections, intersections, profiles, runs and sags.

An alignment is (road, seg_id, part, x0, y0, x1, y1, seg_len, ch0, part_end); chainage grows along each road and offsets are
positive to the left. Tables of stations carry ``road`` (0 if they have none), and every window is one road's or one part's.
Points meet segments through square bins, stations meet what lies along the same road in its order, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.grids import GridInfo, State


def by_road(df: DataFrame) -> DataFrame:
    """``df`` with a road, 0 if it has none."""
    return df if "road" in df.columns else df.withColumn("road", F.lit(0))


def alignment(vertices: DataFrame, start: float = 0.0, reverse: bool = False) -> DataFrame:
    """Segments from vertices ([road], part, pos, x, y); repeated vertices are dropped. Reversed, the last part's last vertex comes first."""
    v = by_road(vertices)
    if reverse:
        v = v.withColumn("part", -F.col("part")).withColumn("pos", -F.col("pos"))
    w = Window.partitionBy("road", "part").orderBy("pos")
    moved = v.withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w)).filter("px is null or px <> x or py <> y").drop("px", "py")
    seg = moved.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w)).filter("x1 is not null")
    seg = seg.select("road", "part", "pos", F.col("x").alias("x0"), F.col("y").alias("y0"), "x1", "y1", F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2).alias("seg_len"))
    along = Window.partitionBy("road").orderBy("part", "pos")
    last = F.lead("part").over(along)
    return seg.select("road", (F.row_number().over(along) - 1).alias("seg_id"), F.abs("part").alias("part") if reverse else "part", "x0", "y0", "x1", "y1", "seg_len", (F.lit(float(start)) + F.sum("seg_len").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("seg_len")).alias("ch0"), (last.isNull() | (last != F.col("part"))).alias("part_end"))


def extent(segments: DataFrame) -> DataFrame:
    """(road, lo, hi, length): first and last chainage."""
    return segments.groupBy("road").agg(F.min("ch0").alias("lo"), F.max(F.col("ch0") + F.col("seg_len")).alias("hi")).withColumn("length", F.col("hi") - F.col("lo"))


def tangent() -> tuple[Column, Column]:
    """The unit direction of a segment."""
    return (F.col("x1") - F.col("x0")) / F.col("seg_len"), (F.col("y1") - F.col("y0")) / F.col("seg_len")


def _sampled(segments: DataFrame, step: float) -> DataFrame:
    """``segments`` with points (px, py) along them, at most ``step`` apart, both ends included."""
    n = F.greatest(F.ceil(F.col("seg_len") / step), F.lit(1))
    t = F.col("_k") / n
    return segments.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("px", F.col("x0") + t * (F.col("x1") - F.col("x0"))).withColumn("py", F.col("y0") + t * (F.col("y1") - F.col("y0"))).drop("_k")


def _bins(segments: DataFrame, radius: float) -> DataFrame:
    """``segments`` once for every bin of side 2 x ``radius`` that may hold points within ``radius`` of them."""
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    side = 2 * radius
    at = _sampled(segments, radius).select(*segments.columns, F.floor(F.col("px") / side).alias("bx"), F.floor(F.col("py") / side).alias("by")).distinct()
    return at.withColumn("m", F.explode(near)).select(*segments.columns, (F.col("bx") + F.col("m.i")).alias("bx"), (F.col("by") + F.col("m.j")).alias("by")).distinct()


def _projected(both: DataFrame) -> DataFrame:
    """Adds t (place on the segment), d2 (squared distance) and cross (positive to the left) of points (x, y) beside segments."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / (F.col("seg_len") * F.col("seg_len"))))
    return both.withColumn("t", t).withColumn("d2", (F.col("x") - F.col("x0") - t * dx) ** 2 + (F.col("y") - F.col("y0") - t * dy) ** 2).withColumn("cross", dx * (F.col("y") - F.col("y0")) - dy * (F.col("x") - F.col("x0")))


def locate(points: DataFrame, segments: DataFrame, radius: float = 250.0, within: float | None = None) -> DataFrame:
    """(fid, road, chainage, offset, distance, seg_id): the nearest projection; the first road and segment on equal distance; left is positive.

    Points look for segments within ``radius`` first; those that find none look four times as far, until all are placed (or, with ``within``, that far).
    """
    left, found, store = points.select("fid", "x", "y"), None, State("unplaced")
    box = segments.agg(F.min(F.least("x0", "x1")).alias("a"), F.max(F.greatest("x0", "x1")).alias("b"), F.min(F.least("y0", "y1")).alias("c"), F.max(F.greatest("y0", "y1")).alias("d")).first()
    if box.a is None:
        return points.sparkSession.createDataFrame([], f"fid {points.schema['fid'].dataType.simpleString()}, road int, chainage double, offset double, distance double, seg_id int")
    keep = segments.select("road", "seg_id", "x0", "y0", "x1", "y1", "seg_len", "ch0")
    while True:
        reach = radius if within is None else min(radius, within)
        side = 2 * reach
        here = left.withColumn("bx", F.floor(F.col("x") / side)).withColumn("by", F.floor(F.col("y") / side))
        both = _projected(here.join(_bins(keep, reach), ["bx", "by"])).filter(F.col("d2") <= reach * reach)
        best = both.groupBy("fid").agg(F.min(F.struct("d2", "road", "seg_id", (F.col("ch0") + F.col("t") * F.col("seg_len")).alias("chainage"), "cross")).alias("b"))
        best = State("placed").put(best)
        found = best if found is None else found.union(best)
        if within is not None and reach >= within:
            break
        left = store.put(left.join(best, "fid", "left_anti"))
        far = left.agg(F.max(F.greatest(F.lit(box.a) - F.col("x"), F.col("x") - F.lit(box.b), F.lit(box.c) - F.col("y"), F.col("y") - F.lit(box.d), F.lit(0.0))).alias("far")).first().far
        if far is None:  # none is left
            break
        radius = max(4 * radius, far / 4)
    d = F.sqrt("b.d2")
    return found.select("fid", F.col("b.road").alias("road"), F.col("b.chainage").alias("chainage"), F.when(F.col("b.cross") >= 0, d).otherwise(-d).alias("offset"), d.alias("distance"), F.col("b.seg_id").alias("seg_id"))


def on_segments(chainages: DataFrame, segments: DataFrame) -> DataFrame:
    """``chainages`` ([road], chainage_m, ...) with the segment each lies on (the later one at a joint) and its x and y (in place of columns of these names), clamped to the alignment."""
    rows = by_road(chainages).drop("seg_id", "part", "x0", "y0", "x1", "y1", "seg_len", "ch0", "x", "y")
    seg = segments.select("road", F.col("ch0").alias("_at"), F.lit(0).alias("_kind"), F.struct("seg_id", "part", "x0", "y0", "x1", "y1", "seg_len", "ch0").alias("_seg"), *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c != "road"])
    own = rows.join(segments.groupBy("road").agg(F.min("ch0").alias("_lo")), "road").select("road", F.greatest("_lo", "chainage_m").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(seg.schema["_seg"].dataType).alias("_seg"), *[c for c in rows.columns if c != "road"])
    w = Window.partitionBy("road").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    got = seg.unionByName(own).withColumn("s", F.last("_seg", ignorenulls=True).over(w)).filter("_kind = 1")
    u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("_at") - F.col("s.ch0")) / F.col("s.seg_len")))
    return got.select(*rows.columns, "s.seg_id", "s.part", "s.x0", "s.y0", "s.x1", "s.y1", "s.seg_len", "s.ch0", (F.col("s.x0") + u * (F.col("s.x1") - F.col("s.x0"))).alias("x"), (F.col("s.y0") + u * (F.col("s.y1") - F.col("s.y0"))).alias("y"))


def point_at(chainages: DataFrame, segments: DataFrame) -> DataFrame:
    """(road, chainage_m, x, y, part) of chainages, clamped to the alignment."""
    return on_segments(by_road(chainages).select("road", "chainage_m").distinct(), segments).select("road", "chainage_m", "x", "y", "part")


def chainages(segments: DataFrame, step: float) -> DataFrame:
    """(road, chainage_m): every ``step`` from the start, and the end."""
    if step <= 0:
        raise ValueError("the step must be positive")
    ends = extent(segments)
    n = F.floor((F.col("hi") - F.col("lo")) / step + 1e-9).cast("int")
    every = ends.select("road", "hi", F.explode(F.transform(F.sequence(F.lit(0), n), lambda k: F.col("lo") + k * step)).alias("chainage_m"))
    return every.select("road", "chainage_m").union(ends.filter(F.col("hi") - F.col("lo") - n * step > 1e-6).select("road", "hi"))


def stations(segments: DataFrame, step: float) -> DataFrame:
    """(road, chainage_m, x, y, part) at every ``step`` from the start, and the end."""
    return on_segments(chainages(segments, step), segments).select("road", "chainage_m", "x", "y", "part")


def intersections(links: DataFrame, segments: DataFrame) -> DataFrame:
    """(id, road, seg_id, x, y, chainage, angle_deg) where ``links`` (id, ax, ay, bx, by) cross the alignment.

    t in [0, 1) on the link, u in [0, 1) on the segment, or 1 at the end of a part; parallel pairs are ignored. Links and segments meet in
    bins as wide as the longest link.
    """
    eps = 1e-12
    longest = links.agg(F.max(F.greatest(F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by")))).alias("m")).first().m
    if longest is None:
        longest = 1.0
    side = max(2.0 * longest, 1e-6)
    # a link's cell is that of its start; a segment within reach of it lies in the same or an adjoining bin
    l = links.withColumn("_bx", F.floor(F.col("ax") / (2 * side))).withColumn("_by", F.floor(F.col("ay") / (2 * side)))
    s = _bins(segments, side).withColumnRenamed("bx", "_bx").withColumnRenamed("by", "_by")
    both = l.join(s, ["_bx", "_by"])
    rx, ry, sx, sy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    den = rx * sy - ry * sx
    t = ((F.col("x0") - F.col("ax")) * sy - (F.col("y0") - F.col("ay")) * sx) / den
    u = ((F.col("x0") - F.col("ax")) * ry - (F.col("y0") - F.col("ay")) * rx) / den
    hit = both.filter(F.abs(den) > eps).withColumn("t", t).withColumn("u", u).filter((F.col("t") >= -eps) & (F.col("t") < 1 - eps) & (F.col("u") >= -eps) & ((F.col("u") < 1 - eps) | (F.col("part_end") & (F.col("u") <= 1 + eps))))
    angle = F.degrees(F.acos(F.least(F.lit(1.0), F.abs(rx * sx + ry * sy) / (F.sqrt(rx * rx + ry * ry) * F.col("seg_len")))))
    azimuth = F.pmod(F.degrees(F.atan2(sx, sy)), F.lit(360.0))
    side_in = F.when(sx * (F.col("ay") - F.col("y0")) - sy * (F.col("ax") - F.col("x0")) > 0, "L").otherwise("R")
    return hit.select("id", "road", "seg_id", "part", (F.col("ax") + F.col("t") * rx).alias("x"), (F.col("ay") + F.col("t") * ry).alias("y"), (F.col("ch0") + F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("u"))) * F.col("seg_len")).alias("chainage"), angle.alias("angle_deg"), azimuth.alias("azimuth_deg"), side_in.alias("side_in"))


def bilinear(points: DataFrame, cells: DataFrame, info: GridInfo, key: str | list[str], column: str = "z") -> DataFrame:
    """(key, value): interpolation between the four cell centres around (x, y), clamped inside the extent; null if any is missing."""
    keys = [key] if isinstance(key, str) else key
    fc = F.greatest(F.lit(0.0), F.least(F.lit(float(info.cols - 1)), (F.col("x") - info.x0) / info.cw - 0.5))
    fr = F.greatest(F.lit(0.0), F.least(F.lit(float(info.rows - 1)), (info.y0 - F.col("y")) / info.ch - 0.5))
    inside = F.col("x").between(info.x0, info.x0 + info.cols * info.cw) & F.col("y").between(info.y0 - info.rows * info.ch, info.y0)
    p = points.filter(inside).select(*keys, fc.alias("fc"), fr.alias("fr")).withColumn("c0", F.least(F.floor("fc"), F.lit(max(0, info.cols - 2)))).withColumn("r0", F.least(F.floor("fr"), F.lit(max(0, info.rows - 2))))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    i, j = F.col("_corner.i"), F.col("_corner.j")
    weight = F.when(i == 1, F.col("fr") - F.col("r0")).otherwise(1 - F.col("fr") + F.col("r0")) * F.when(j == 1, F.col("fc") - F.col("c0")).otherwise(1 - F.col("fc") + F.col("c0"))
    q = p.withColumn("_corner", corners).select(*keys, F.least(F.col("r0") + i, F.lit(info.rows - 1)).cast("int").alias("r"), F.least(F.col("c0") + j, F.lit(info.cols - 1)).cast("int").alias("c"), weight.alias("w"))
    got = q.join(cells.select("r", "c", column), ["r", "c"]).groupBy(*keys).agg(F.sum(F.col("w") * F.col(column)).alias("v"), F.count(column).alias("n"))
    return points.select(*keys).join(got, keys, "left").select(*keys, F.when(F.col("n") == 4, F.col("v")).alias("value"))


def nearest_sample(points: DataFrame, cells: DataFrame, info: GridInfo, column: str = "z") -> DataFrame:
    """``points`` (x, y) with ``value``: that of the cell each lies in, null outside."""
    own = points.withColumn("r", info.row(F.col("y"))).withColumn("c", info.col(F.col("x")))
    return own.join(cells.select("r", "c", F.col(column).alias("value")), ["r", "c"], "left").drop("r", "c")


# --- profiles -------------------------------------------------------------------------------------


def profile(segments: DataFrame, cells: DataFrame, info: GridInfo, step: float = 10.0, filled: DataFrame | None = None, flow: DataFrame | None = None, crossings: DataFrame | None = None, search_cells: int = 1) -> DataFrame:
    """(road, chainage_m, x, y, part, z_dem_m, z_fill_m, pond_depth_m, acc_km2, stream, strahler, slope_long_pct) along the alignment.

    ``flow`` (r, c, acc): the greatest accumulation within ``search_cells`` of a station. ``crossings`` (road, chainage_m, acc_km2, stream_order) mark the nearest station as
    a stream, raise its area to theirs and give it the highest order.
    """
    st = stations(segments, step)
    keys = ["road", "chainage_m"]
    out = st.join(bilinear(st, cells, info, keys).withColumnRenamed("value", "z_dem_m"), keys)
    z_fill = bilinear(st, filled, info, keys, "filled").withColumnRenamed("value", "z_fill_m") if filled is not None else st.select(*keys, F.lit(None).cast("double").alias("z_fill_m"))
    out = out.join(z_fill, keys).withColumn("pond_depth_m", F.greatest(F.col("z_fill_m") - F.col("z_dem_m"), F.lit(0.0)))
    out = out.withColumn("pond_depth_m", F.when(F.col("z_fill_m").isNotNull() & F.col("z_dem_m").isNotNull(), F.col("pond_depth_m")))
    if flow is not None:
        k = search_cells
        near = st.select(*keys, info.row(F.col("y")).alias("r0"), info.col(F.col("x")).alias("c0")).withColumn("r", F.explode(F.sequence(F.col("r0") - k, F.col("r0") + k))).withColumn("c", F.explode(F.sequence(F.col("c0") - k, F.col("c0") + k)))
        most = near.join(flow.select("r", "c", "acc"), ["r", "c"]).groupBy(*keys).agg(((F.max("acc") + 1) * info.cell_area_km2).alias("acc_km2"))
        out = out.join(most, keys, "left")
    else:
        out = out.withColumn("acc_km2", F.lit(None).cast("double"))
    if crossings is not None:
        marks = nearest_along(by_road(crossings).select("road", "chainage_m", "acc_km2", "stream_order"), st.select(*keys))
        marks = marks.groupBy("road", F.col("near_m").alias("chainage_m")).agg(F.max("acc_km2").alias("_a"), F.max("stream_order").alias("strahler"), F.lit(1).alias("stream"))
        out = out.join(marks, keys, "left").withColumn("acc_km2", F.greatest("acc_km2", "_a")).withColumn("stream", F.coalesce("stream", F.lit(0))).drop("_a")
    else:
        out = out.withColumn("stream", F.lit(0)).withColumn("strahler", F.lit(None).cast("int"))
    sloped = profile_slope(out).withColumn("slope_long_pct", 100 * F.col("slope")).drop("slope")
    return sloped


def nearest_along(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` (road, chainage_m, ...) with near_m and nearest_m: the chainage of the nearest of ``marks`` (road, chainage_m) on the same road (the lower one on equal distance) and how far it is; null without one."""
    a = by_road(rows)
    extra = [c for c in a.columns if c not in ("road", "chainage_m")]
    m = by_road(marks).filter("chainage_m is not null").select("road", "chainage_m").distinct()
    events = a.withColumn("_kind", F.lit(1)).select("road", "chainage_m", "_kind", *extra).unionByName(m.select("road", "chainage_m", F.lit(0).alias("_kind"), *[F.lit(None).cast(a.schema[c].dataType).alias(c) for c in extra]))
    mark = F.when(F.col("_kind") == 0, F.col("chainage_m"))
    below = Window.partitionBy("road").orderBy("chainage_m", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy("road").orderBy(F.col("chainage_m").desc(), F.col("_kind")).rowsBetween(Window.unboundedPreceding, 0)
    got = events.withColumn("_b", F.last(mark, ignorenulls=True).over(below)).withColumn("_a", F.last(mark, ignorenulls=True).over(above)).filter("_kind = 1")
    nearer = F.when(F.col("_a").isNull() | (F.col("chainage_m") - F.col("_b") <= F.col("_a") - F.col("chainage_m")), F.col("_b")).otherwise(F.col("_a"))
    return got.withColumn("near_m", nearer).withColumn("nearest_m", F.abs(F.col("near_m") - F.col("chainage_m"))).drop("_kind", "_a", "_b")


def profile_slope(rows: DataFrame, z: str = "z_dem_m") -> DataFrame:
    """Adds slope: centred difference over neighbours of the same part, one-sided at its ends."""
    own = by_road(rows)
    w = Window.partitionBy("road", "part").orderBy("chainage_m")
    first, last = F.lag("chainage_m").over(w).isNull(), F.lead("chainage_m").over(w).isNull()
    z0, z1 = F.when(first, F.col(z)).otherwise(F.lag(z).over(w)), F.when(last, F.col(z)).otherwise(F.lead(z).over(w))
    c0, c1 = F.coalesce(F.lag("chainage_m").over(w), F.col("chainage_m")), F.coalesce(F.lead("chainage_m").over(w), F.col("chainage_m"))
    return own.withColumn("slope", F.when(c1 > c0, (z1 - z0) / (c1 - c0)))


def summary(rows: DataFrame) -> DataFrame:
    """(road, n, from_m, to_m, n_stream, z_min, z_max, n_ponded, max_pond_m) of a profile."""
    ponded = F.col("pond_depth_m") > 0
    return by_road(rows).groupBy("road").agg(F.count("*").alias("n"), F.min("chainage_m").alias("from_m"), F.max("chainage_m").alias("to_m"), F.sum("stream").alias("n_stream"), F.min("z_dem_m").alias("z_min"), F.max("z_dem_m").alias("z_max"), F.sum(F.coalesce(ponded, F.lit(False)).cast("int")).alias("n_ponded"), F.max("pond_depth_m").alias("max_pond_m"))


def smooth(rows: DataFrame, width: float, column: str = "z_dem_m") -> DataFrame:
    """Adds smooth: the mean within half of ``width`` on each side on the same road, nulls left out."""
    return by_road(rows).withColumn("smooth", F.expr(f"avg({column}) over (partition by road order by chainage_m range between {width / 2}D preceding and {width / 2}D following)"))


def runs(rows: DataFrame, condition: Column, key: str = "chainage_m", keys: tuple[str, ...] = ("road",)) -> DataFrame:
    """``rows`` where ``condition`` holds, with ``run``: the number of the unbroken run each belongs to."""
    w = Window.partitionBy(*keys).orderBy(key)
    own = rows.withColumn("_c", F.coalesce(condition, F.lit(False)))
    own = own.withColumn("_new", (F.col("_c") & ~F.coalesce(F.lag("_c").over(w), F.lit(False))).cast("int"))
    return own.withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_c").drop("_c", "_new")


def groups_by_gap(rows: DataFrame, gap: float, key: str = "chainage_m") -> DataFrame:
    """Adds run: a new one wherever the step from the row before on the road exceeds ``gap``."""
    w = Window.partitionBy("road").orderBy(key)
    return by_road(rows).withColumn("run", F.sum(F.when(F.col(key) - F.lag(key).over(w) <= gap, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def missing_crossings(rows: DataFrame, existing: DataFrame, gap: float = 30.0, near: float = 50.0, min_area_km2: float = 0.0) -> DataFrame:
    """(road, run, chainage_m, acc_km2, nearest_m, covered): for each group of stream stations that of the greatest area (the first of equal ones); covered if an existing crossing is near."""
    best = groups_by_gap(rows.filter((F.col("stream") == 1) & (F.col("acc_km2") >= min_area_km2)), gap).groupBy("road", "run").agg(F.max_by("chainage_m", F.struct("acc_km2", (-F.col("chainage_m")).alias("t"))).alias("chainage_m"), F.max("acc_km2").alias("acc_km2"))
    return nearest_along(best, existing).drop("near_m").withColumn("covered", F.coalesce(F.col("nearest_m") <= near, F.lit(False)))


def cluster_cover(candidates: DataFrame, used: DataFrame) -> DataFrame:
    """(uid, road, chainage_m): candidates (cluster, road, chainage_m) whose cluster holds a used crossing (cluster, uid), the first uid of a cluster."""
    first = used.filter("cluster is not null").groupBy("cluster").agg(F.min("uid").alias("uid"))
    return by_road(candidates).filter("chainage_m is not null").join(first, "cluster").select("uid", "road", "chainage_m")


def flat_stretches(rows: DataFrame, limit: float = 0.005, least_m: float = 300.0) -> DataFrame:
    """(road, run, start_m, end_m, length_m, slope, cross_fall): runs of small slope and cross-fall; bounds half-way to the neighbours."""
    w = Window.partitionBy("road").orderBy("chainage_m")
    own = by_road(rows).withColumn("lo", (F.col("chainage_m") + F.coalesce(F.lag("chainage_m").over(w), F.col("chainage_m"))) / 2).withColumn("hi", (F.col("chainage_m") + F.coalesce(F.lead("chainage_m").over(w), F.col("chainage_m"))) / 2)
    flat = runs(own, (F.abs("slope") < limit) & (F.abs("cross_fall") < limit))
    return flat.groupBy("road", "run").agg(F.min("lo").alias("start_m"), F.max("hi").alias("end_m"), F.avg(F.abs("slope")).alias("slope"), F.avg(F.abs("cross_fall")).alias("cross_fall")).withColumn("length_m", F.col("end_m") - F.col("start_m")).filter(F.col("length_m") >= least_m)


def cross_fall(rows: DataFrame, segments: DataFrame, cells: DataFrame, info: GridInfo, reach_m: float = 100.0) -> DataFrame:
    """``rows`` (road, chainage_m, z_dem_m) with cross_fall: the greater rise or fall (m/m) to the ground ``reach_m`` to the left and right; null without either."""
    at = on_segments(by_road(rows), segments)
    tx, ty = tangent()
    sides = at.withColumn("_s", F.explode(F.array(F.lit(1.0), F.lit(-1.0)))).select("road", "chainage_m", "z_dem_m", "_s", (F.col("x") - F.col("_s") * ty * reach_m).alias("x"), (F.col("y") + F.col("_s") * tx * reach_m).alias("y"))
    z = bilinear(sides, cells, info, ["road", "chainage_m", "_s"])
    worst = sides.join(z, ["road", "chainage_m", "_s"]).groupBy("road", "chainage_m").agg((F.max(F.abs(F.col("value") - F.col("z_dem_m"))) / reach_m).alias("cross_fall"))
    return by_road(rows).join(worst, ["road", "chainage_m"], "left")


def _highest_since_lower(z: np.ndarray) -> np.ndarray:
    """For each place the highest value between it and the last lower one before it, both left out; -inf where there is none.

    What the stack loses to a value lies just between that value and the lower one that stays, and each lost entry knows the highest of its own stretch.
    """
    out, stack = np.full(len(z), -np.inf), []
    for i, v in enumerate(z.tolist()):
        top = -np.inf
        while stack and stack[-1][0] >= v:
            top = max(top, stack.pop()[1])
        out[i] = top
        stack.append((v, max(top, v)))
    return out


def _prominences(z: np.ndarray) -> list[tuple[int, int, float]]:
    """(place, end, prominence) of the local minima of ``z`` (no gaps), a plateau counting from its first place to its end."""
    left, right = _highest_since_lower(z), _highest_since_lower(z[::-1])[::-1]
    first = np.flatnonzero(np.concatenate(([True], z[1:] != z[:-1])))
    last = np.append(first[1:], len(z)) - 1
    v = z[first]
    low = np.flatnonzero((v[1:-1] < v[:-2]) & (v[1:-1] < v[2:])) + 1
    return [(int(first[k]), int(last[k]), float(min(left[first[k]], right[last[k]]) - v[k])) for k in low]


def sags(rows: DataFrame, column: str = "smooth", prominence: float = 0.3) -> DataFrame:
    """(road, chainage_m, z, prominence_m, low_m, z_low): local minima (first station of a plateau) whose lower enclosing rise reaches ``prominence``; ``low_m`` is the lowest raw
    station (z_dem_m, if there is one) from three before it to three after its end.

    The rise on a side is the highest point before the profile falls below the minimum again, over gaps; a station beside a gap (a null) is no minimum. A road's stations are one group.
    """
    own = by_road(rows)
    raw = F.col("z_dem_m") if "z_dem_m" in own.columns else F.col(column)
    kind = own.schema["road"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chainage_m")
        z, ch, low = pdf.z.to_numpy(float), pdf.chainage_m.to_numpy(float), pdf.raw.to_numpy(float)
        known = np.flatnonzero(~np.isnan(z))
        out = []
        for i, _, depth in _prominences(z[known]) if len(known) else []:
            i = known[i]
            beside = 0 < i < len(z) - 1 and not np.isnan(z[i - 1]) and not np.isnan(z[i + 1])
            if depth >= prominence and beside:
                j = i
                while j + 1 < len(z) and z[j + 1] == z[i]:
                    j += 1
                lo, hi = max(0, i - 3), min(len(z), j + 4)
                m = lo + int(np.nanargmin(low[lo:hi])) if not np.isnan(low[lo:hi]).all() else i
                out.append((key[0], ch[i], z[i], depth, ch[m], low[m]))
        return pd.DataFrame(out, columns=["road", "chainage_m", "z", "prominence_m", "low_m", "z_low"])

    return own.select("road", "chainage_m", F.col(column).cast("double").alias("z"), raw.cast("double").alias("raw")).groupBy("road").applyInPandas(run, f"road {kind}, chainage_m double, z double, prominence_m double, low_m double, z_low double")


def ponding(sag_rows: DataFrame, drains: DataFrame, near: float = 50.0) -> DataFrame:
    """Sags with no stream or crossing (road, chainage_m) within ``near``."""
    return nearest_along(sag_rows, drains).filter(F.coalesce(F.col("nearest_m") > near, F.lit(True))).drop("near_m", "nearest_m")


def run_widths(rows: DataFrame, crossings: DataFrame, rises: list[float], column: str = "z_dem_m", window_m: float = 50.0, absolute: bool = False) -> DataFrame:
    """(uid, road, rise_m, bed_m, from_m, to_m, width_m, open_left, open_right): around each crossing (uid, road, chainage_m) the unbroken run of the profile at or
    below the level ``rise_m`` above its lowest station within ``window_m`` (or, ``absolute``, at or below ``rise_m`` itself); ends interpolated, open where the profile or its values end.

    A road's stations and its crossings are one group.
    """
    own = by_road(rows).select("road", "chainage_m", F.col(column).cast("double").alias("v"))
    marks = by_road(crossings).filter("chainage_m is not null").select("road", "uid", F.col("chainage_m").alias("at"))
    kinds = marks.schema

    def run(key: tuple, line: pd.DataFrame, here: pd.DataFrame) -> pd.DataFrame:
        line = line.sort_values("chainage_m")
        ch, v = line.chainage_m.to_numpy(float), line.v.to_numpy(float)
        out = []
        for uid, at in zip(here.uid.tolist(), here["at"].tolist(), strict=True):
            near = np.flatnonzero((np.abs(ch - at) <= window_m) & np.isfinite(v))
            if not len(near):
                continue
            i = near[v[near].argmin()]
            for rise in rises:
                level = rise if absolute else v[i] + rise
                wet = np.nan_to_num(v, nan=np.inf) <= level
                if not wet[i]:
                    continue
                dry = np.flatnonzero(~wet)
                lo = dry[dry < i].max() + 1 if (dry < i).any() else 0
                hi = dry[dry > i].min() - 1 if (dry > i).any() else len(v) - 1
                left, right = lo == 0 or not np.isfinite(v[lo - 1]), hi == len(v) - 1 or not np.isfinite(v[hi + 1])
                cut = lambda a, b: ch[a] + (level - v[a]) / (v[b] - v[a]) * (ch[b] - ch[a])  # noqa: B023, E731
                a, b = ch[lo] if left else cut(lo - 1, lo), ch[hi] if right else cut(hi, hi + 1)
                out.append((uid, key[0], rise, v[i], a, b, b - a, bool(left), bool(right)))
        return pd.DataFrame(out, columns=["uid", "road", "rise_m", "bed_m", "from_m", "to_m", "width_m", "open_left", "open_right"])

    return own.groupBy("road").cogroup(marks.groupBy("road")).applyInPandas(run, f"uid {kinds['uid'].dataType.simpleString()}, road {kinds['road'].dataType.simpleString()}, rise_m double, bed_m double, from_m double, to_m double, width_m double, open_left boolean, open_right boolean")


def floodplain(rows: DataFrame, crossings: DataFrame, rises=(0.5, 1.0, 2.0), min_area_km2: float = 10.0, hand: bool = False, window_m: float = 50.0) -> DataFrame:
    """``run_widths`` of crossings (uid, road, chainage_m, area_km2) that drain enough; with ``hand`` also by height above the drainage (column ``hand`` of ``rows``), as hand_width_m."""
    large = crossings.filter(F.col("area_km2") >= min_area_km2)
    out = run_widths(rows, large, [float(x) for x in rises], window_m=window_m)
    if not hand:
        return out
    above = run_widths(rows, large, [float(x) for x in rises], column="hand", window_m=window_m, absolute=True)
    return out.join(above.select("uid", "rise_m", F.col("width_m").alias("hand_width_m")), ["uid", "rise_m"], "left")


# --- crossings of the stream network ----------------------------------------------------------------


def candidates(flow: DataFrame, stream: DataFrame, segments: DataFrame, info: GridInfo, merge_cells: float = 2.0, same_area: float = 0.05, merge_m: float = 0.0, min_area_km2: float = 0.0, corridor_m: float = 30.0, min_parallel_m: float = 100.0, prefix: str = "C") -> DataFrame:
    """Road crossings of the stream network: (candidate_id, id, road, part, x, y, chainage, angle_deg, azimuth_deg, side_in, area_km2, parallel, cluster, recommended, dist_prev_m).

    Neighbours along the road nearer than two cell diagonals whose areas agree to 5 %, or nearer than ``merge_m``, form a cluster, and so do all on one parallel stream: a
    component of stream cells within ``corridor_m`` of the road with a run of at least ``min_parallel_m``. The greatest area, then the later chainage, is recommended.
    """
    from . import graph
    from .drainage import link_length

    pts = flow.join(stream.select("id").distinct(), "id", "left_semi").filter("parent is not null").select("id", "acc", "parent", info.x(F.col("c")).alias("ax"), info.y(F.col("r")).alias("ay"), link_length(info).alias("link"))
    ends = flow.select(F.col("id").alias("parent"), info.x(F.col("c")).alias("bx"), info.y(F.col("r")).alias("by"))
    hits = intersections(pts.join(ends, "parent"), segments).join(pts.select("id", "parent", ((F.col("acc") + 1) * info.cell_area_km2).alias("area_km2")), "id").filter(F.col("area_km2") >= min_area_km2)
    hits = State("crossings").put(hits)
    # stream cells beside the road, joined by their links
    near = locate(flow.join(stream.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("fid"), info.x(F.col("c")).alias("x"), info.y(F.col("r")).alias("y")), segments, radius=max(corridor_m, info.cw), within=max(corridor_m, 1e-9))
    beside = State("corridor").put(near.filter(F.col("distance") <= corridor_m).select(F.col("fid").alias("id")))
    links = pts.join(beside, "id").join(beside.select(F.col("id").alias("parent")), "parent").select("id", "parent", "link")
    joined = graph.components(links.select(F.col("id").alias("a"), F.col("parent").alias("b")))
    # the longest run of a component: the longest way down within it
    longest = graph.accumulate(beside.join(links, "id", "left").select("id", "parent", F.coalesce("link", F.lit(0.0)).alias("w")), how="max").withColumnRenamed("total", "run_m")
    parallel = joined.join(longest, "id").groupBy("component").agg(F.max("run_m").alias("run_m")).filter(F.col("run_m") >= min_parallel_m)
    member = joined.join(parallel, "component").select("id", F.col("component").alias("along"))
    # a crossing belongs to a parallel stream by either end of its link
    own = hits.join(member, "id", "left").join(member.select(F.col("id").alias("parent"), F.col("along").alias("along2")), "parent", "left").withColumn("along", F.coalesce("along", "along2")).drop("along2", "parent")
    w = Window.partitionBy("road").orderBy("chainage", F.desc("area_km2"), "id")
    gap, before = F.col("chainage") - F.lag("chainage").over(w), F.lag("area_km2").over(w)
    diag = merge_cells * (info.cw**2 + info.ch**2) ** 0.5
    same = F.coalesce((gap < diag) & (F.abs(F.col("area_km2") - before) <= same_area * F.greatest("area_km2", before)) | (gap < merge_m), F.lit(False))
    own = own.withColumn("dist_prev_m", gap).withColumn("k", F.row_number().over(w)).withColumn("new", (~same).cast("int")).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = State("candidates").put(own)
    # groups along the road and parallel streams, joined: small graph of groups and streams
    name = lambda *x: F.concat_ws(":", *x)
    group, line = name(F.lit("g"), "road", "g"), name(F.lit("s"), "along")
    both = own.filter("along is not null").select(group.alias("a"), line.alias("b")).distinct()
    joint = graph.components(both).select(F.col("id").alias("group"), F.col("component").alias("joint"))
    own = own.withColumn("group", group).join(joint, "group", "left").withColumn("joint", F.coalesce("joint", "group"))
    first = Window.partitionBy("joint")
    own = own.withColumn("_first", F.min(F.struct("road", "k")).over(first)).withColumn("cluster", F.dense_rank().over(Window.partitionBy("_first.road").orderBy("_first.k")))
    best = F.row_number().over(Window.partitionBy("joint").orderBy(F.desc("area_km2"), F.desc("chainage")))
    width = F.greatest(F.lit(3), F.length(F.max("k").over(Window.partitionBy("road")).cast("string")))
    label = F.concat(F.lit(prefix), F.lpad(F.col("k").cast("string"), width, F.lit("0")))
    return own.withColumn("recommended", best == 1).select(label.alias("candidate_id"), "id", "road", "part", "x", "y", "chainage", "angle_deg", "azimuth_deg", "side_in", "area_km2", F.col("along").isNotNull().alias("parallel"), "cluster", "recommended", "dist_prev_m")


def select_crossings(rows: DataFrame) -> DataFrame:
    """Which candidates (status, recommended) become crossings: the accepted ones if there are any, otherwise the recommended that are not rejected."""
    status = F.lower(F.trim(F.coalesce("status", F.lit(""))))
    some = rows.select((status == "accepted").alias("a")).agg(F.max("a").alias("some"))
    return rows.join(some).filter(F.when(F.col("some"), status == "accepted").otherwise(F.coalesce(F.col("recommended").cast("boolean"), F.lit(False)) & (status != "rejected"))).drop("some")


# --- the corridor ---------------------------------------------------------------------------------


def offsets(segments: DataFrame, step: float, distances: list[float]) -> DataFrame:
    """(road, chainage_m, side, o, x, y): points left (L) and right (R) of the stations at the given distances."""
    at = on_segments(chainages(segments, step), segments)
    tx, ty = tangent()
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(float(o)).alias("o"), F.lit(float(o) if s == "L" else -float(o)).alias("d")) for s in "LR" for o in distances]))
    return at.withColumn("k", side).select("road", "chainage_m", F.col("k.side").alias("side"), F.col("k.o").alias("o"), (F.col("x") - F.col("k.d") * ty).alias("x"), (F.col("y") + F.col("k.d") * tx).alias("y"))


def corridor(segments: DataFrame, cells: DataFrame, info: GridInfo, column: str, step: float, distances: list[float]) -> DataFrame:
    """(road, chainage_m, side, worst, mean): values of ``column`` at offsets to the left (L) and right (R) of each station, the centre included if 0 is among them."""
    p = offsets(segments, step, distances).withColumn("r", info.row(F.col("y"))).withColumn("c", info.col(F.col("x")))
    return p.join(cells.select("r", "c", column), ["r", "c"]).groupBy("road", "chainage_m", "side").agg(F.max(column).alias("worst"), F.avg(column).alias("mean"))


def reaches_of(rows: DataFrame, value: str) -> DataFrame:
    """(road, reach, value, start_m, end_m, length_m, n_stations): maximal runs of stations of equal ``value`` (null is a value); bounds half-way to the neighbours."""
    own = by_road(rows)
    w = Window.partitionBy("road").orderBy("chainage_m")
    changed = ~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag("chainage_m").over(w).isNull()
    own = own.withColumn("reach", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = own.withColumn("_lo", F.coalesce((F.col("chainage_m") + F.lag("chainage_m").over(w)) / 2, F.col("chainage_m"))).withColumn("_hi", F.coalesce((F.col("chainage_m") + F.lead("chainage_m").over(w)) / 2, F.col("chainage_m")))
    return own.groupBy("road", "reach", F.col(value).alias("value")).agg(F.min("_lo").alias("start_m"), F.max("_hi").alias("end_m"), F.count("*").alias("n_stations")).withColumn("length_m", F.col("end_m") - F.col("start_m"))
