"""Drainage coverage along a road: lines as cells, the road as a wall, what ponds against it, slopes draining to its side drains, mapped drainage lines.

Lines become cells through points along them, so a line costs its length; nothing is compared with all of the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.grids import GridInfo, State, cut
from . import fill, graph, linear, stencil
from .drainage import link_length
from .ranks import numbered

CLASSES = ("low", "moderate", "high", "very high")


def line_points(segments: DataFrame, step: float, offsets: tuple[float, ...] = (0.0,)) -> DataFrame:
    """``segments`` with points (px, py) at most ``step`` apart along them and at the given distances to their left."""
    tx, ty = linear.tangent()
    at = linear._sampled(segments, step)
    if offsets == (0.0,):
        return at
    at = at.withColumn("_o", F.explode(F.array(*[F.lit(float(o)) for o in offsets])))
    return at.withColumn("px", F.col("px") - F.col("_o") * ty).withColumn("py", F.col("py") + F.col("_o") * tx).drop("_o")


def cells_of(points: DataFrame, info: GridInfo, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (keys, r, c) of the grid's cells that hold points (px, py)."""
    got = points.select(*keys, info.row(F.col("py")).alias("r"), info.col(F.col("px")).alias("c")).distinct()
    return got.filter(F.col("r").between(0, info.rows - 1) & F.col("c").between(0, info.cols - 1))


def road_cells(segments: DataFrame, info: GridInfo, half_m: float = 0.0, per_cell: float = 4.0) -> DataFrame:
    """(r, c): cells within ``half_m`` of the centreline, by points ``1 / per_cell`` of a cell apart."""
    step = min(info.cw, info.ch) / per_cell
    n = int(math.floor(half_m / step + 1e-9)) if half_m > 0 else 0
    offsets = sorted({0.0, *[-half_m + k * step for k in range(2 * n + 1 if half_m else 0) if -half_m + k * step <= half_m + 1e-9]})
    return cells_of(line_points(segments, step, tuple(offsets)), info)


def wall_cells(segments: DataFrame, info: GridInfo, gaps: DataFrame | None = None, gap_cells: int = 1) -> DataFrame:
    """(r, c): the centreline's cells without diagonal slits; open within ``gap_cells`` of the points (x, y) of ``gaps``."""
    wall = cut(road_cells(segments, info, per_cell=2.0), "wall")
    # two cells that touch at a corner alone are joined by one beside them
    has = lambda dr, dc: wall.select((F.col("r") - dr).alias("r"), (F.col("c") - dc).alias("c"), F.lit(True).alias(f"h{dr}{dc}".replace("-", "m")))
    near = wall
    for dr, dc in ((1, 1), (0, 1), (1, 0), (1, -1), (0, -1)):
        near = near.join(has(dr, dc), ["r", "c"], "left")
    slit = near.filter(F.col("h11") & F.col("h01").isNull() & F.col("h10").isNull()).select("r", (F.col("c") + 1).alias("c"))
    # the other diagonal is closed at the cell to the left of its upper end
    anti = near.filter(F.col("h1m1") & F.col("h0m1").isNull() & F.col("h10").isNull()).select("r", (F.col("c") - 1).alias("c"))
    wall = wall.union(slit).union(anti).distinct()
    if gaps is None:
        return wall
    open_ = gaps.select(info.row(F.col("y")).alias("r"), info.col(F.col("x")).alias("c"))
    return wall.join(stencil.dilate(open_, stencil.square(gap_cells), info), ["r", "c"], "left_anti")


def walled_flow(filled: DataFrame, segments: DataFrame, info: GridInfo, gaps: DataFrame | None = None, height_m: float = 1000.0, method: str = "barnes") -> tuple[DataFrame, DataFrame]:
    """(flow, wall): routing of ``filled`` (r, c, z) with the road's cells raised by ``height_m`` and not filled again, so that water stops against the embankment."""
    wall = cut(wall_cells(segments, info, gaps), "wall")
    raised = cut(filled.join(wall.withColumn("_w", F.lit(True)), ["r", "c"], "left").withColumn("z", F.col("z") + F.when(F.col("_w"), height_m).otherwise(0.0)).drop("_w"), "walled")
    plain = stencil.d8_surface(raised, info)
    flow = graph.flow_accumulation(fill.resolve_flats(plain, info, method), info)
    return cut(flow, "walled-flow"), wall


def sag_areas(sags: DataFrame, segments: DataFrame, flow: DataFrame, wall: DataFrame, info: GridInfo, offset_cells: float = 1.5) -> DataFrame:
    """``sags`` (road, chainage_m, ...) with area_left_km2, area_right_km2, the greater as area_km2 with its side, and that side's outlet cell: the greatest walled accumulation where water stops
    (no receiver, off the wall) among 5 x 5 cells ``offset_cells`` beside the centreline."""
    at = linear.on_segments(sags.select("road", "chainage_m"), segments)
    tx, ty = linear.tangent()
    d = offset_cells * math.sqrt(info.cw * info.ch)
    side = F.explode(F.array(F.struct(F.lit("left").alias("side"), F.lit(d).alias("d")), F.struct(F.lit("right").alias("side"), F.lit(-d).alias("d"))))
    p = at.withColumn("k", side).select("road", "chainage_m", F.col("k.side").alias("side"), info.row(F.col("y") + F.col("k.d") * tx).alias("r0"), info.col(F.col("x") - F.col("k.d") * ty).alias("c0"))
    near = p.withColumn("r", F.explode(F.sequence(F.col("r0") - 2, F.col("r0") + 2))).withColumn("c", F.explode(F.sequence(F.col("c0") - 2, F.col("c0") + 2)))
    stops = flow.filter("parent is null").join(wall, ["r", "c"], "left_anti").select("r", "c", "id", "acc")
    best = near.join(stops, ["r", "c"]).groupBy("road", "chainage_m", "side").agg(F.max(F.struct("acc", (-F.col("id")).alias("t"))).alias("m")).select("road", "chainage_m", "side", ((F.col("m.acc") + 1) * info.cell_area_km2).alias("area"), (-F.col("m.t")).alias("id"))
    both = best.groupBy("road", "chainage_m").agg(F.max(F.when(F.col("side") == "left", F.col("area"))).alias("area_left_km2"), F.max(F.when(F.col("side") == "right", F.col("area"))).alias("area_right_km2"), F.max(F.struct("area", "side", "id")).alias("m"))
    return sags.join(both, ["road", "chainage_m"], "left").withColumn("area_km2", F.col("m.area")).withColumn("side", F.col("m.side")).withColumn("outlet_id", F.col("m.id")).drop("m")


def run_coverage(segments: DataFrame, cells: DataFrame, filled: DataFrame, flow: DataFrame, profile: DataFrame, crossings: DataFrame, info: GridInfo, min_area_km2: float = 0.18, merge_m: float = 30.0, search_m: float = 50.0, small_area_km2: float = 0.01, smooth_m: float = 30.0, min_depth_m: float = 0.3, sag_min_area_km2: float = 0.05, flat_slope: float = 0.005, crossfall_m: float = 100.0, flat_min_m: float = 300.0, covered: DataFrame | None = None, prefix: str = "P") -> dict[str, DataFrame]:
    """The check of a road: ``coverage`` (issue, road, chainage_m, chainage_to_m, area_km2, uid, nearest_m), ``sags``, ``flats`` and ``proposed`` crossings (uid, road, chainage_m, x, y, reason, outlet_id).

    ``crossings`` (uid, road, chainage_m, x, y, area_km2) are those of the design; ``covered`` (road, chainage_m) are further places that count as covered (``linear.cluster_cover``).
    Issues are missing crossings, small areas, sags without a drain and flat stretches. Proposed are missing crossings and sags with enough area on a side, numbered along each road.
    """
    drains = linear.by_road(crossings).select("road", "chainage_m")
    held = drains if covered is None else drains.unionByName(covered.select("road", "chainage_m"))
    missing = cut(linear.missing_crossings(profile, held, merge_m, search_m, min_area_km2).filter("not covered"), "missing")
    streams = profile.filter("stream = 1")
    found = linear.sags(linear.smooth(profile, smooth_m), prominence=min_depth_m).select("road", F.col("low_m").alias("chainage_m"), F.col("z_low").alias("z_dem_m"), "prominence_m")
    wet = linear.ponding(found, held.unionByName(streams.select("road", "chainage_m")), search_m)
    gaps = linear.by_road(crossings).select("x", "y").union(streams.select("x", "y"))
    walled, wall = walled_flow(filled, segments, info, gaps)
    sags = cut(sag_areas(cut(wet, "sags"), segments, walled, wall, info), "sag-areas")
    flats = linear.flat_stretches(linear.cross_fall(profile.withColumn("slope", F.col("slope_long_pct") / 100), segments, cells, info, crossfall_m), flat_slope, flat_min_m)
    at = linear.on_segments(missing.select("road", "chainage_m", "acc_km2"), segments).select("road", "chainage_m", "x", "y", F.lit("uncovered_stream").alias("reason"), F.lit(None).cast("long").alias("outlet_id"))
    low = linear.on_segments(sags.filter(F.col("area_km2") >= sag_min_area_km2).select("road", "chainage_m", "outlet_id"), segments).select("road", "chainage_m", info.x(F.expr(f"outlet_id % {info.cols}")).alias("x"), info.y(F.expr(f"outlet_id div {info.cols}")).alias("y"), F.lit("sag_point").alias("reason"), "outlet_id")
    k = F.row_number().over(Window.partitionBy("road").orderBy("chainage_m", "reason"))
    width = F.greatest(F.lit(3), F.length(F.count("*").over(Window.partitionBy("road")).cast("string")))
    proposed = cut(at.unionByName(low).dropDuplicates(["road", "x", "y"]).withColumn("uid", F.concat(F.lit(prefix), F.lpad(k.cast("string"), width, F.lit("0")))), "proposed")
    uid = proposed.select("road", "chainage_m", "uid", "reason")
    none = lambda kind: F.lit(None).cast(kind)
    issues = missing.join(uid.filter("reason = 'uncovered_stream'"), ["road", "chainage_m"], "left").select(F.lit("missing_crossing").alias("issue"), "road", "chainage_m", none("double").alias("chainage_to_m"), F.col("acc_km2").alias("area_km2"), "uid", "nearest_m")
    small = linear.by_road(crossings).filter(F.col("area_km2") < small_area_km2).select(F.lit("small_area"), "road", "chainage_m", none("double"), "area_km2", "uid", none("double"))
    ponds = linear.nearest_along(sags.select("road", "chainage_m", "area_km2"), drains).join(uid.filter("reason = 'sag_point'"), ["road", "chainage_m"], "left").select(F.lit("sag_point"), "road", "chainage_m", none("double"), "area_km2", "uid", "nearest_m")
    level = flats.select(F.lit("flat_stretch"), "road", "start_m", "end_m", none("double"), none("string"), none("double"))
    return {"coverage": issues.union(small).union(ponds).union(level), "sags": sags, "flats": flats, "proposed": proposed}


# --- side drains ------------------------------------------------------------------------------------


def side_drain(segments: DataFrame, cells: DataFrame, flow: DataFrame, info: GridInfo, step: float = 10.0, half_width: float = 50.0, offset_step: float = 10.0, road_half_m: float = 5.0) -> DataFrame:
    """(road, chainage_m, side, n, sti_p50, sti_p90): transport index of the cells beside each station whose water reaches the road without meeting a channel.

    ``cells`` has id, sti and channel. A cell off the road and the channel counts if within ceil(half_width / cell) + 1 steps its way enters the road's strip before a channel.
    """
    n = int(math.floor(half_width / offset_step + 1e-9))
    near = linear.offsets(segments, step, [offset_step * (k + 1) for k in range(n)]).select("road", "chainage_m", "side", info.row(F.col("y")).alias("r"), info.col(F.col("x")).alias("c"))
    near = near.filter(F.col("r").between(0, info.rows - 1) & F.col("c").between(0, info.cols - 1)).withColumn("id", F.col("r").cast("long") * info.cols + F.col("c")).select("road", "chainage_m", "side", "id").distinct()
    strip = road_cells(segments, info, road_half_m).select((F.col("r").cast("long") * info.cols + F.col("c")).alias("id"), F.lit(True).alias("road_"))
    state = flow.select("id", "parent").join(strip, "id", "left").join(cells.select("id", "channel"), "id", "left").select("id", "parent", F.coalesce("road_", F.lit(False)).alias("road_"), F.coalesce("channel", F.lit(False)).alias("chan"))
    state = cut(state, "strip")
    start = near.select("id").distinct().join(state, "id").filter("not road_ and not chan").select("id", F.col("parent").alias("at"))
    kept, store = None, State("drain")
    going = start.filter("at is not null")
    for _ in range(int(math.ceil(half_width / min(info.cw, info.ch))) + 1):
        moved = store.put(going.join(state.select(F.col("id").alias("at"), F.col("parent").alias("next"), "road_", "chan"), "at").select("id", F.col("at"), "next", "road_", "chan"))
        hit = cut(moved.filter("road_").select("id"), "drained")
        kept = hit if kept is None else kept.union(hit)
        going = moved.filter("not road_ and not chan and next is not null").select("id", F.col("next").alias("at"))
    own = near.join(kept.distinct(), "id", "left_semi").join(cells.select("id", "sti"), "id").filter(F.col("sti").isNotNull())
    got = own.groupBy("road", "chainage_m", "side").agg(F.count("*").alias("n"), F.percentile("sti", 0.5).alias("sti_p50"), F.percentile("sti", 0.9).alias("sti_p90"))
    every = linear.chainages(segments, step).withColumn("side", F.explode(F.array(F.lit("L"), F.lit("R"))))
    return every.join(got, ["road", "chainage_m", "side"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def drain_classes(stations: DataFrame, slopes: DataFrame | None = None, drain_slope_pct: float = 1.0) -> DataFrame:
    """``stations`` (of ``side_drain``) with class_breaks (P50, P75, P90 of the stations' p90 of both sides of all roads), sti_class (a value on a break belongs to the lower class) and siltation: high or very
    high on a road less steep than ``drain_slope_pct``; null without either. ``slopes`` has road, chainage_m and slope_long_pct."""
    breaks = stations.agg(F.percentile("sti_p90", [0.5, 0.75, 0.9]).alias("class_breaks"))
    own = stations.join(breaks)  # one row
    k = F.size(F.filter("class_breaks", lambda b: b < F.col("sti_p90")))
    own = own.withColumn("sti_class", F.when(F.col("sti_p90").isNotNull(), F.get(F.array(*[F.lit(c) for c in CLASSES]), k)))
    own = own.join(slopes.select("road", "chainage_m", "slope_long_pct"), ["road", "chainage_m"], "left") if slopes is not None else own.withColumn("slope_long_pct", F.lit(None).cast("double"))
    return own.withColumn("siltation", F.when(F.col("sti_class").isNotNull() & F.col("slope_long_pct").isNotNull(), (F.col("sti_class").isin("high", "very high") & (F.abs("slope_long_pct") < drain_slope_pct)).cast("int")))


def drain_reaches(reaches: DataFrame, stations: DataFrame) -> DataFrame:
    """(road, reach, side, sti_p90, sti_max, sti_class, siltation_m) of ``reaches`` (road, reach, start_m, end_m) from classified ``stations`` within (the end left out, but for a road's last station)."""
    w = Window.partitionBy("road", "side").orderBy("chainage_m")
    lo = F.coalesce((F.col("chainage_m") + F.lag("chainage_m").over(w)) / 2, F.col("chainage_m"))
    hi = F.coalesce((F.col("chainage_m") + F.lead("chainage_m").over(w)) / 2, F.col("chainage_m"))
    own = stations.withColumn("_len", hi - lo).withColumn("_last", F.lead("chainage_m").over(w).isNull())
    both = own.join(reaches.select("road", "reach", "start_m", "end_m"), "road").filter((F.col("chainage_m") >= F.col("start_m") - 1e-9) & ((F.col("chainage_m") < F.col("end_m") - 1e-9) | F.col("_last") & (F.col("chainage_m") <= F.col("end_m") + 1e-9)))
    got = both.groupBy("road", "reach", "side").agg(F.percentile("sti_p90", 0.9).alias("sti_p90"), F.max("sti_p90").alias("sti_max"), F.first("class_breaks").alias("class_breaks"), F.sum(F.when(F.col("siltation").isNotNull(), F.col("siltation") * F.col("_len"))).alias("siltation_m"))
    k = F.size(F.filter("class_breaks", lambda b: b < F.col("sti_p90")))
    return got.withColumn("sti_class", F.when(F.col("sti_p90").isNotNull(), F.get(F.array(*[F.lit(c) for c in CLASSES]), k))).drop("class_breaks")


# --- mapped drainage lines --------------------------------------------------------------------------


def mapped_samples(lines: DataFrame, info: GridInfo, per_cell: float = 2.0) -> DataFrame:
    """(line, r, c, w): samples of mapped lines (segments with ``line``) half a cell apart, each with the length it stands for, on the grid."""
    step = min(info.cw, info.ch) / per_cell
    n = F.greatest(F.ceil(F.col("seg_len") / step), F.lit(1))
    t = F.col("_k") / n
    at = lines.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n))).withColumn("w", F.col("seg_len") / n * F.when((F.col("_k") == 0) | (F.col("_k") == n), 0.5).otherwise(1.0))
    at = at.select("line", info.row(F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("r"), info.col(F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("c"), "w")
    return at.filter(F.col("r").between(0, info.rows - 1) & F.col("c").between(0, info.cols - 1))


def line_segments(vertices: DataFrame) -> DataFrame:
    """Segments of lines (line, pos, x, y), as of an alignment each, with ``line``."""
    seg = linear.alignment(vertices.select(F.col("line").alias("road"), F.lit(0).alias("part"), "pos", "x", "y"))
    return seg.withColumn("line", F.col("road"))


def mapped_agreement(stream: DataFrame, flow: DataFrame, lines: DataFrame, info: GridInfo, tolerance_m: float = 60.0, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, agreeing): precision, recall and F1 of the stream cells (id, r, c) against mapped ``lines`` (segments with ``line``), by length, and the stream cells near a line.

    A cell weighs its link (half a mean cell without one). ``regions`` (outlet, id) gives a row for each region, cells in several counting in each.
    """
    disk = stencil.disk(tolerance_m + 1e-9, info.cw, info.ch)
    near_map = stencil.dilate(cells_of(line_points(lines, 0.25 * min(info.cw, info.ch)), info), disk, info)
    near_stream = stencil.dilate(stream.select("r", "c"), disk, info).withColumn("hit", F.lit(True))
    weigh = F.when(F.col("parent").isNotNull(), link_length(info)).otherwise(0.25 * (info.cw + info.ch))
    own = cut(stream.select("id", "r", "c").join(flow.select("id", "parent", "dir", weigh.alias("w")), "id").join(near_map.withColumn("agree", F.lit(True)), ["r", "c"], "left").select("id", "r", "c", "w", F.coalesce("agree", F.lit(False)).alias("agree")), "agreement")
    valid = flow.select("id", "r", "c")
    seen = mapped_samples(lines, info).join(valid, ["r", "c"]).join(near_stream, ["r", "c"], "left").select("id", "w", F.coalesce("hit", F.lit(False)).alias("hit"))
    key = ["outlet"] if regions is not None else []
    a = own.join(regions.select("outlet", "id"), "id") if regions is not None else own
    b = seen.join(regions.select("outlet", "id"), "id") if regions is not None else seen
    p = a.groupBy(*key).agg((F.sum(F.when(F.col("agree"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("precision"))
    r = b.groupBy(*key).agg((F.sum(F.when(F.col("hit"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("recall"))
    both = p.join(r, key, "full") if key else p.join(r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return both.withColumn("f1", f1), own.filter("agree").select("id", "r", "c")


def mapped_crossings(crossings: DataFrame, lines: DataFrame, tolerance_m: float = 60.0, threshold_km2: float = 1.0, far_m: float = 1000.0) -> DataFrame:
    """``crossings`` (uid, x, y, area_km2) with the distance and number of the nearest mapped line within ``far_m``, whether it agrees, and why not: below the threshold of area, or none that near."""
    near = linear.locate(crossings.select(F.col("uid").alias("fid"), "x", "y"), lines, radius=tolerance_m, within=far_m).select(F.col("fid").alias("uid"), F.col("distance").alias("map_dist_m"), F.col("road").alias("line"))
    out = crossings.join(near, "uid", "left")
    small = F.coalesce(F.col("area_km2") < threshold_km2, F.lit(False))
    agrees = F.when(~small & F.col("map_dist_m").isNotNull(), (F.col("map_dist_m") <= tolerance_m).cast("int"))
    note = F.when(small, "below the comparison threshold").when(F.col("map_dist_m").isNull(), "no mapped line near").when(F.col("map_dist_m") > tolerance_m, "nearest mapped line beyond the tolerance")
    return out.withColumn("map_agrees", agrees).withColumn("map_note", note)


def uncovered_rivers(lines: DataFrame, segments: DataFrame, crossings: DataFrame, search_m: float = 50.0) -> DataFrame:
    """(line, road, chainage_m, x, y, nearest_m): where mapped lines cross the road with no crossing (road, chainage_m) within ``search_m`` along it."""
    links = lines.select(F.struct("line", "seg_id").alias("id"), F.col("x0").alias("ax"), F.col("y0").alias("ay"), F.col("x1").alias("bx"), F.col("y1").alias("by"))
    hit = linear.intersections(links, segments).select("road", F.col("chainage").alias("chainage_m"), F.col("id.line").alias("line"), "x", "y")
    return linear.nearest_along(hit, crossings).drop("near_m").filter(F.coalesce(F.col("nearest_m") > search_m, F.lit(True)))


def divergence(stream: DataFrame, agreeing: DataFrame, flow: DataFrame, info: GridInfo, min_cells: int = 10) -> DataFrame:
    """(head, cells, length_m, area_km2, rejoins): runs of stream cells off the mapped lines that begin below an agreeing one; where several heads share cells, the largest keeps them.

    A cell belongs to the head of the greatest accumulation among those that drain to it over disagreeing cells (then the least id); ``length_m`` includes the link out of the run.
    """
    ag = agreeing.select("id", F.lit(True).alias("ag"))
    own = flow.join(stream.select("id").distinct(), "id", "left_semi").join(ag, "id", "left").select("id", "parent", "acc", F.coalesce("ag", F.lit(False)).alias("ag"), link_length(info).alias("link"))
    own = cut(own, "divergence")
    dis = own.filter("not ag")
    heads = own.filter("ag and parent is not null").select(F.col("parent").alias("id")).distinct().join(dis, "id").select("id", "acc")
    # a rank of the heads; the best that reaches a cell is the least number from above
    ranked, _ = numbered(heads, [F.desc("acc"), F.col("id")], "rank")
    inside = dis.select(F.col("id").alias("parent"), F.lit(True).alias("_in"))
    nodes = dis.join(inside, "parent", "left").select("id", F.when(F.col("_in"), F.col("parent")).alias("parent")).join(ranked.select("id", "rank"), "id", "left")
    best = graph.accumulate(nodes.select("id", "parent", F.lit(0.0).alias("w"), F.coalesce(-F.col("rank").cast("double"), F.lit(float("-inf"))).alias("s")), how="max")
    member = best.filter(F.col("total") > float("-inf")).select("id", (-F.col("total")).cast("long").alias("rank")).join(ranked.select(F.col("id").alias("head"), F.col("acc").alias("head_acc"), "rank"), "rank")
    rows = member.join(dis.select("id", "parent", "link"), "id").join(own.select(F.col("id").alias("parent"), F.col("ag").alias("below")), "parent", "left").join(member.select(F.col("id").alias("parent"), F.col("head").alias("next")), "parent", "left")
    last = F.coalesce(F.col("next") != F.col("head"), F.lit(True))
    got = rows.groupBy("head").agg(F.count("*").alias("cells"), F.sum("link").alias("length_m"), ((F.max("head_acc") + 1) * info.cell_area_km2).alias("area_km2"), F.max(F.when(last, F.coalesce("below", F.lit(False)))).cast("int").alias("rejoins"))
    return got.filter(F.col("cells") >= min_cells)


def clip_lines(lines: DataFrame, info: GridInfo, per_cell: float = 2.0) -> DataFrame:
    """(line, run, pos, x, y): the parts of lines (segments with ``line``) inside the grid, as runs of points at most half a cell apart; runs of a single point are left out."""
    step = min(info.cw, info.ch) / per_cell
    at = linear._sampled(lines, step).select("line", "seg_id", F.col("px").alias("x"), F.col("py").alias("y"), (F.sqrt((F.col("px") - F.col("x0")) ** 2 + (F.col("py") - F.col("y0")) ** 2) + F.col("ch0")).alias("at")).dropDuplicates(["line", "x", "y", "at"])
    inside = F.col("x").between(info.x0, info.x0 + info.cols * info.cw) & F.col("y").between(info.y0 - info.rows * info.ch, info.y0)
    own = linear.runs(at, inside, key="at", keys=("line",))
    n = F.count("*").over(Window.partitionBy("line", "run"))
    pos = F.row_number().over(Window.partitionBy("line", "run").orderBy("at", "seg_id"))
    return own.withColumn("_n", n).withColumn("pos", pos).filter("_n > 1").select("line", "run", "pos", "x", "y")
