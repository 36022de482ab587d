"""Streams, catchments, paths and networks on a routed grid.

``flow`` here is (id, r, c, dir, parent, acc), as ``flow_accumulation`` returns it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.grids import GridInfo, cut
from . import graph
from .ranks import quantiles
from .stencil import distances


def link_length(info: GridInfo) -> Column:
    """Length of a cell's own link in metres, 0 without one."""
    d = F.array(*[F.lit(x) for x in distances(info.cw, info.ch)])
    return F.when(F.col("parent").isNotNull(), F.element_at(d, F.col("dir") + 1)).otherwise(0.0)


def streams(flow: DataFrame, threshold_cells: float | None = None, threshold_km2: float | None = None, info: GridInfo | None = None) -> DataFrame:
    """Cells whose accumulation reaches the threshold."""
    least = threshold_cells if threshold_cells is not None else threshold_km2 / info.cell_area_km2
    return flow.filter(F.col("acc") >= least)


def roots(flow: DataFrame, info: GridInfo | None = None) -> DataFrame:
    """(id, root): the terminal cell below each cell."""
    return graph.descend(flow.select("id", "parent", F.col("parent").isNull().alias("marked")), info=info).select("id", F.col("target").alias("root"))


def catchments(flow: DataFrame, outlets: DataFrame, full: bool = False, info: GridInfo | None = None) -> DataFrame:
    """(outlet, id): membership of ``outlets`` (outlet, id).

    Local catchments are cut at other outlets: each cell belongs to the first outlet below it. Full ones overlap:
    an outlet's catchment also holds those of the outlets above it, found on the small graph of outlets.
    """
    marked = flow.select("id", "parent").join(outlets.select("id", F.lit(True).alias("marked")).distinct(), "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    first = cut(graph.descend(marked, info=info).filter("target is not null").select("id", F.col("target").alias("at")), "first")
    named = outlets.select(F.col("id").alias("at"), "outlet")
    local = first.join(named, "at")
    if not full:
        return local.select("outlet", "id")
    # the next outlet strictly below each outlet: the first one at or below its receiver
    below = outlets.select("outlet", "id").join(flow.select("id", "parent"), "id").join(first.select(F.col("id").alias("parent"), "at"), "parent").select("outlet", "at")
    upper = below.join(named.select("at", F.col("outlet").alias("lower")), "at").select("outlet", "lower")
    reach = cut(outlets.select("outlet", F.col("outlet").alias("member")), "nested")
    step = cut(upper.select(F.col("outlet").alias("member"), "lower"), "nested")
    while True:
        more = reach.join(step, "member").select("outlet", F.col("lower").alias("member")).join(reach, ["outlet", "member"], "left_anti").distinct()
        more = cut(more, "nested")
        if not more.limit(1).count():
            break
        reach = cut(reach.union(more), "nested")
    return local.select(F.col("outlet").alias("up"), "id").join(reach.select(F.col("outlet").alias("up"), F.col("member").alias("outlet")), "up").select("outlet", "id")


def upstream_lengths(flow: DataFrame, info: GridInfo) -> DataFrame:
    """(id, up_len): the longest path length arriving at each cell, 0 at sources."""
    return graph.upstream_longest(flow.select("id", "parent", link_length(info).alias("link")), info).select("id", F.col("total").alias("up_len"))


def longest_paths(flow: DataFrame, outlets: DataFrame, info: GridInfo) -> DataFrame:
    """(outlet, pos, id, cum_m): the cells of the longest path to each outlet, from the outlet (pos 0) to its head.

    Ties go to the donor of the greater accumulation, then the lesser id. Every cell knows its best donor, and the path is
    a walk up these.
    """
    lengths = cut(flow.join(upstream_lengths(flow, info), "id").select("id", "parent", "acc", "up_len", link_length(info).alias("link")), "lengths")
    best = lengths.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.max_by(F.struct(F.col("id").alias("donor"), "link"), F.struct((F.col("up_len") + F.col("link")).alias("l"), "acc", (-F.col("id")).alias("t"))).alias("b"))
    ways = lengths.select("id").join(best, "id", "left").select("id", F.col("b.donor").alias("parent"), F.coalesce("b.link", F.lit(0.0)).alias("link"))
    return graph.walk_down(ways, outlets.select(F.col("outlet").alias("start"), "id"), info, float("inf")).select(F.col("start").alias("outlet"), "pos", "id", "cum_m")


def slope_1085(paths: DataFrame, z: DataFrame) -> DataFrame:
    """(outlet, length_m, z10, z85, slope_1085): elevations at 10 % and 85 % of the path from the outlet, linearly interpolated."""
    own = paths.join(z.select("id", "z"), "id")
    w = Window.partitionBy("outlet").orderBy("pos")
    total = F.max("cum_m").over(Window.partitionBy("outlet"))
    seg = own.select("outlet", "cum_m", "z", F.lead("cum_m").over(w).alias("c2"), F.lead("z").over(w).alias("z2"), total.alias("length_m"))

    def at(share: float) -> Column:
        target = F.col("length_m") * F.lit(share)
        hit = (F.col("cum_m") <= target) & (F.col("c2") > target)
        return F.max(F.when(hit, F.col("z") + (F.col("z2") - F.col("z")) * (target - F.col("cum_m")) / (F.col("c2") - F.col("cum_m"))))

    got = seg.groupBy("outlet").agg(F.max("length_m").alias("length_m"), at(0.1).alias("z10"), at(0.85).alias("z85"))
    return got.withColumn("slope_1085", F.when(F.col("length_m") > 0, (F.col("z85") - F.col("z10")) / (0.75 * F.col("length_m"))))


def slope_1085_steps(paths: DataFrame, z: DataFrame) -> DataFrame:
    """(outlet, slope): the older figure, from the divide and without interpolation: between the first cells at or past 10 % and 85 % of the way from the head. Kept to compare with old results."""
    own = paths.join(z.select("id", "z"), "id").withColumn("total", F.max("cum_m").over(Window.partitionBy("outlet"))).withColumn("d", F.col("total") - F.col("cum_m"))
    at = lambda share: F.min(F.when(F.col("d") >= F.lit(share) * F.col("total"), F.struct("d", "z")))
    got = own.groupBy("outlet").agg(at(0.1).alias("a"), at(0.85).alias("b"), F.count("*").alias("n"))
    return got.select("outlet", F.when((F.col("n") >= 3) & (F.col("b.d") > F.col("a.d")), (F.col("a.z") - F.col("b.z")) / (F.col("b.d") - F.col("a.d"))).alias("slope"))


def path_figures(paths: DataFrame, z: DataFrame, rise_m: float = 0.5) -> DataFrame:
    """(outlet, lfp_length_m, lfp_elev_max_m, lfp_elev_min_m, lfp_drop_m, lfp_z_head_m, lfp_z_outlet_m, lfp_nonmonotonic, lfp_slope, lfp_slope_1085, lfp_z10_m, lfp_z85_m) of longest paths.

    The drop is that between the highest and the lowest point; a path on which it exceeds that from head to outlet by more than ``rise_m`` is not monotonic.
    """
    own = paths.join(z.select("id", "z"), "id", "left")
    got = own.groupBy("outlet").agg(F.max("cum_m").alias("lfp_length_m"), F.max("z").alias("lfp_elev_max_m"), F.min("z").alias("lfp_elev_min_m"), F.max_by("z", F.when(F.col("z").isNotNull(), F.col("pos"))).alias("lfp_z_head_m"), F.min_by("z", F.when(F.col("z").isNotNull(), F.col("pos"))).alias("lfp_z_outlet_m"))
    got = got.withColumn("lfp_drop_m", F.col("lfp_elev_max_m") - F.col("lfp_elev_min_m"))
    got = got.withColumn("lfp_nonmonotonic", (F.col("lfp_drop_m") - (F.col("lfp_z_head_m") - F.col("lfp_z_outlet_m")) > rise_m).cast("int")).withColumn("lfp_slope", F.when(F.col("lfp_length_m") > 0, F.col("lfp_drop_m") / F.col("lfp_length_m")))
    s = slope_1085(paths, z).select("outlet", F.col("slope_1085").alias("lfp_slope_1085"), F.col("z10").alias("lfp_z10_m"), F.col("z85").alias("lfp_z85_m"))
    return got.join(s, "outlet", "left")


def path_split(paths: DataFrame, flow: DataFrame, z: DataFrame, threshold_cells: float, sheet_cap_m: float = 100.0) -> DataFrame:
    """Overland and channel parts of each path: the channel starts at the first cell from the head that reaches the threshold; without one all is overland (``no_channel``)."""
    own = paths.join(flow.select("id", "acc"), "id").join(z.select("id", "z"), "id")
    head = F.max(F.when(F.col("acc") >= threshold_cells, F.struct("cum_m", "z"))).alias("h")
    got = own.groupBy("outlet").agg(F.max(F.struct("cum_m", "z")).alias("top"), F.min(F.struct("cum_m", "z")).alias("low"), head)
    inside = cut(own.join(got.select("outlet", F.coalesce("h.cum_m", F.lit(0.0)).alias("_c")), "outlet").filter(F.col("cum_m") <= F.col("_c")).select("outlet", "pos", "id", "cum_m"), "channel-paths")
    steep = slope_1085(inside, z).select("outlet", F.col("slope_1085").alias("channel_slope_1085"))
    channel = F.coalesce(F.col("h.cum_m"), F.lit(0.0))
    over = F.col("top.cum_m") - channel
    out = got.select(
        "outlet", F.col("top.cum_m").alias("length_m"), channel.alias("channel_m"), over.alias("overland_m"), F.least(over, F.lit(sheet_cap_m)).alias("sheet_m"), F.greatest(over - sheet_cap_m, F.lit(0.0)).alias("shallow_m"),
        F.when(over > 0, (F.col("top.z") - F.coalesce(F.col("h.z"), F.col("low.z"))) / over).alias("overland_slope"), F.when(channel > 0, (F.col("h.z") - F.col("low.z")) / channel).alias("channel_slope"), F.col("h").isNull().cast("int").alias("no_channel"),
    )
    return out.join(steep, "outlet", "left").withColumn("channel_slope_1085", F.when(F.col("channel_m") > 0, F.col("channel_slope_1085")))


def network_stats(flow: DataFrame, stream: DataFrame, member: DataFrame, info: GridInfo, orders: DataFrame | None = None) -> DataFrame:
    """(outlet, channel_length_m, links, max_order): links within each zone (outlet, id) and its channel cells; a link begins at a source or a confluence."""
    own = flow.join(stream.select("id").distinct(), "id", "left_semi").select("id", "parent", link_length(info).alias("link"))
    own = cut(member.select("outlet", "id").join(own, "id"), "channels")
    inside = own.join(own.select("outlet", F.col("id").alias("parent"), F.lit(True).alias("_in")), ["outlet", "parent"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    donors = inside.filter("_in").groupBy("outlet", F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    rows = inside.join(donors, ["outlet", "id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.join(orders.select("id", "order"), "id", "left") if orders is not None else rows.withColumn("order", F.lit(None).cast("int"))
    return rows.groupBy("outlet").agg(F.sum(F.when(F.col("_in"), F.col("link")).otherwise(0.0)).alias("channel_length_m"), F.sum((F.col("n") != 1).cast("int")).alias("links"), F.max("order").alias("max_order"))


def snap_greatest(points: DataFrame, flow: DataFrame, info: GridInfo, radius_cells: int) -> DataFrame:
    """(fid, r, c, snap_r, snap_c): the cell of the greatest accumulation within the radius, the first in row order of equal ones; the older way, wrong near confluences."""
    p = points.select("fid", info.row(F.col("y")).alias("r"), info.col(F.col("x")).alias("c"))
    near = p.withColumn("sr", F.explode(F.sequence(F.col("r") - radius_cells, F.col("r") + radius_cells))).withColumn("sc", F.explode(F.sequence(F.col("c") - radius_cells, F.col("c") + radius_cells)))
    best = near.join(flow.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "acc"), ["sr", "sc"]).groupBy("fid").agg(F.min(F.struct((-F.col("acc")).alias("a"), "sr", "sc")).alias("b"))
    return p.join(best, "fid", "left").select("fid", "r", "c", F.coalesce("b.sr", "r").alias("snap_r"), F.coalesce("b.sc", "c").alias("snap_c"))


def hand(flow: DataFrame, z: DataFrame, stream: DataFrame, info: GridInfo | None = None) -> DataFrame:
    """(id, hand): height above the first stream cell downstream, null if there is none; may be negative."""
    marked = flow.select("id", "parent").join(stream.select("id", F.lit(True).alias("marked")).distinct(), "id", "left").withColumn("marked", F.coalesce("marked", F.lit(False)))
    to = graph.descend(marked, info=info)
    return to.join(z.select("id", "z"), "id").join(z.select(F.col("id").alias("target"), F.col("z").alias("zs")), "target", "left").select("id", (F.col("z") - F.col("zs")).alias("hand"))


def strahler(flow: DataFrame, stream: DataFrame, info: GridInfo | None = None) -> DataFrame:
    """(id, order): Strahler order on the stream cells, by peeling: a cell is settled when all its stream donors are.

    The network is first contracted to reaches, so that the number of rounds is the depth in junctions, not in cells.
    """
    own = flow.select("id", "parent").join(stream.select("id").distinct(), "id")
    own = own.join(stream.select(F.col("id").alias("parent"), F.lit(True).alias("in")).distinct(), "parent", "left").select("id", F.when(F.col("in"), F.col("parent")).alias("parent"))
    degree = own.filter("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n"))
    own = cut(own.join(degree, "id", "left").withColumn("n", F.coalesce("n", F.lit(0))), "network")
    # the reach of a cell is named by its lowest cell: the last before a junction or the end
    bends = own.select(F.col("id").alias("parent"), (F.col("n") != 1).alias("junction"))
    ends = own.join(bends, "parent", "left").withColumn("marked", F.coalesce("junction", F.lit(True)))
    reach = cut(graph.descend(ends.select("id", "parent", "marked"), info=info).select("id", F.col("target").alias("reach")), "reach")
    tails = own.join(reach, "id").filter("id = reach").select("reach", F.col("parent").alias("to"))
    up = cut(tails.join(reach.select(F.col("id").alias("to"), F.col("reach").alias("below")), "to", "left").select("reach", "below"), "reaches")
    fed = up.filter("below is not null").select("below").distinct()
    done = cut(up.join(fed.withColumnRenamed("below", "reach"), "reach", "left_anti").select("reach", F.lit(1).alias("order")), "orders")
    while True:
        rest = up.select("reach").join(done, "reach", "left_anti")
        feeds = up.join(done, "reach", "left").filter("below is not null").groupBy(F.col("below").alias("reach")).agg(F.count("*").alias("n"), F.count("order").alias("known"), F.max("order").alias("top"), F.collect_list("order").alias("orders"))
        ready = rest.join(feeds.filter("n = known"), "reach").select("reach", (F.col("top") + F.when(F.size(F.filter("orders", lambda o: o == F.col("top"))) >= 2, 1).otherwise(0)).alias("order"))
        ready = cut(ready, "orders")
        if not ready.limit(1).count():
            break
        done = cut(done.union(ready), "orders")
    return reach.join(done, "reach").select("id", "reach", "order")


def reaches(flow: DataFrame, z: DataFrame, orders: DataFrame, info: GridInfo) -> DataFrame:
    """(reach, order, n_cells, length_m, drop_m, slope): from a source or junction to the next junction or the outlet; a reach's last link leads into the junction."""
    own = orders.join(flow.select("id", "parent", "dir"), "id").join(z.select("id", "z"), "id").withColumn("link", link_length(info))
    next_z = z.select(F.col("id").alias("parent"), F.col("z").alias("zp"))
    own = own.join(next_z, "parent", "left").join(orders.select(F.col("id").alias("parent"), F.lit(True).alias("in")), "parent", "left")
    link = F.when(F.col("in"), F.col("link")).otherwise(0.0)
    end = F.when(F.col("in"), F.col("zp")).otherwise(F.col("z"))
    got = own.groupBy("reach").agg(F.max("order").alias("order"), (F.count("*") + F.max(F.when((F.col("id") == F.col("reach")) & F.col("in"), 1).otherwise(0))).alias("n_cells"), F.sum(link).alias("length_m"), F.max("z").alias("top"), F.max(F.when(F.col("id") == F.col("reach"), end)).alias("end"))
    got = got.filter("n_cells >= 2").withColumn("drop_m", F.col("top") - F.col("end"))
    return got.select("reach", "order", "n_cells", "length_m", "drop_m", F.when(F.col("length_m") > 0, F.col("drop_m") / F.col("length_m")).alias("slope"))


def network_summary(lines: DataFrame, area_km2: float) -> DataFrame:
    return lines.groupBy("order").agg(F.count("*").alias("n_reaches"), F.sum("length_m").alias("length_m"), F.avg("length_m").alias("mean_length_m"), F.avg("slope").alias("mean_slope")).withColumn("density_km_km2", F.col("length_m") / 1000 / F.lit(area_km2))


def snap(points: DataFrame, stream: DataFrame, info: GridInfo, radius_cells: int) -> DataFrame:
    """(fid, r, c, snap_r, snap_c, moved_m): the nearest stream cell by ring, then the greater accumulation, then row-major; unmoved when none is near."""
    p = points.select("fid", info.row(F.col("y")).alias("r"), info.col(F.col("x")).alias("c"))
    # a bounded window: the points' candidate cells meet the stream by equality
    near = p.select("fid", "r", "c", F.explode(F.sequence(F.col("r") - radius_cells, F.col("r") + radius_cells)).alias("sr")).select("*", F.explode(F.sequence(F.col("c") - radius_cells, F.col("c") + radius_cells)).alias("sc"))
    hit = near.join(stream.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "acc"), ["sr", "sc"])
    ring = F.greatest(F.abs(F.col("sr") - F.col("r")), F.abs(F.col("sc") - F.col("c")))
    best = hit.groupBy("fid").agg(F.min(F.struct(ring.alias("ring"), (-F.col("acc")).alias("na"), "sr", "sc")).alias("b"))
    got = p.join(best, "fid", "left").select("fid", "r", "c", F.coalesce("b.sr", "r").alias("snap_r"), F.coalesce("b.sc", "c").alias("snap_c"))
    return got.withColumn("moved_m", F.sqrt(((F.col("snap_r") - F.col("r")) * F.lit(info.ch)) ** 2 + ((F.col("snap_c") - F.col("c")) * F.lit(info.cw)) ** 2))


def path_down(flow: DataFrame, starts: DataFrame, info: GridInfo, limit_m: float) -> DataFrame:
    """(start, pos, id, cum_m): receivers of each start, down to ``limit_m``."""
    return graph.walk_down(flow.select("id", "parent", link_length(info).alias("link")), starts.select(F.col("id").alias("start"), "id"), info, limit_m)


def characteristics(cells: DataFrame, member: DataFrame, info: GridInfo) -> DataFrame:
    """Zonal figures of each outlet's catchment from ``cells`` (id, z, slope)."""
    own = cut(member.join(cells.select("id", "z", "slope"), "id"), "zone-cells")
    median = quantiles(own, {"slope_median": (F.col("slope"), 0.5)}, ("outlet",))
    figures = own.groupBy("outlet").agg(
        F.count("*").alias("n_cells"), (F.count("*") * F.lit(info.cell_area_km2)).alias("area_km2"), F.max("z").alias("elev_max_m"), F.min("z").alias("elev_min_m"), F.avg("z").alias("elev_mean_m"),
        (F.max("z") - F.min("z")).alias("relief_m"), F.avg("slope").alias("catch_slope_horn"),
    )
    return figures.join(median, "outlet", "left")

