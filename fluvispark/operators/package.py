"""The package of a road's crossings: outlets, catchments and longest paths under one key, with their figures, and the checks between its layers.

``outlets`` and all figures are keyed by ``outlet_uid``; layers are tables, geometry is well-known binary.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..sources.grids import GridInfo, cut
from . import channel, conditioning, drainage, geometry, review, stencil
from .ranks import numbered, padded

LAYERS = ("crossings", "catchments", "flowpaths")


class PackageError(ValueError):
    pass


def snapped(points: DataFrame, flow: DataFrame, stream: DataFrame | None, info: GridInfo, radius: int = 5) -> tuple[DataFrame, DataFrame]:
    """(points with id, r, c, acc, outlet_x, outlet_y and snap_dist_m; problems (fid, problem)) of pour points (fid, x, y and perhaps outlet_x, outlet_y, source_id, chainage).

    A point with an outlet of its own stays there. Others go to the nearest stream cell, without streams to the greatest accumulation within ``radius`` cells, or stay. Points outside
    the grid or on no data are problems and left out; two points on one cell are an error.
    """
    own = points
    for c, kind in (("outlet_x", "double"), ("outlet_y", "double"), ("source_id", "string"), ("chainage", "double")):
        if c not in own.columns:
            own = own.withColumn(c, F.lit(None).cast(kind))
    fixed = F.col("outlet_x").isNotNull() & F.col("outlet_y").isNotNull()
    own = own.withColumn("fixed", fixed).withColumn("px", F.when(fixed, F.col("outlet_x")).otherwise(F.col("x"))).withColumn("py", F.when(fixed, F.col("outlet_y")).otherwise(F.col("y")))
    own = cut(own.withColumn("r0", info.row(F.col("py"))).withColumn("c0", info.col(F.col("px"))), "points")
    inside = F.coalesce(F.col("r0").between(0, info.rows - 1) & F.col("c0").between(0, info.cols - 1), F.lit(False))
    free = own.filter(inside & ~F.col("fixed")).select("fid", F.col("px").alias("x"), F.col("py").alias("y"))
    if radius > 0:
        moved = drainage.snap(free, stream, info, radius) if stream is not None else drainage.snap_greatest(free, flow, info, radius)
        moved = moved.select("fid", "snap_r", "snap_c")
        own = own.join(moved, "fid", "left")
    else:
        own = own.withColumn("snap_r", F.lit(None).cast("int")).withColumn("snap_c", F.lit(None).cast("int"))
    own = own.withColumn("r", F.coalesce("snap_r", "r0").cast("int")).withColumn("c", F.coalesce("snap_c", "c0").cast("int"))
    own = own.join(flow.select("r", "c", "id", "acc"), ["r", "c"], "left").withColumn("inside", inside)
    own = cut(own.drop("outlet_x", "outlet_y", "snap_r", "snap_c"), "snapped")
    problems = own.filter("not inside or id is null").select("fid", F.when(~F.col("inside"), "outside the grid").otherwise("on no data").alias("problem"))
    good = own.filter("inside and id is not null").withColumn("outlet_x", info.x(F.col("c"))).withColumn("outlet_y", info.y(F.col("r")))
    good = good.withColumn("snap_dist_m", F.sqrt((F.col("outlet_x") - F.col("x")) ** 2 + (F.col("outlet_y") - F.col("y")) ** 2))
    twice = good.groupBy("id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("fid")).alias("fids")).filter("n > 1").limit(5).collect()
    if twice:
        raise PackageError("points on the same cell: " + "; ".join(", ".join(map(str, t.fids)) for t in twice))
    return good.drop("r0", "c0", "px", "py", "inside"), problems


def with_uids(points: DataFrame, scheme: str = "sequential", order: str = "downstream", prefix: str = "X", width: int = 3, start: int = 1) -> DataFrame:
    """``points`` with outlet_uid: numbered downstream first (greatest accumulation), in input order (fid) or along the road (chainage), or by an attribute (source_id), which must be there and unlike in all."""
    if scheme == "attribute":
        out = points.withColumn("outlet_uid", F.concat(F.lit(prefix), F.trim(F.coalesce("source_id", F.lit("")))))
        own = F.trim(F.coalesce("source_id", F.lit("")))
        bad = points.select(own.alias("v")).groupBy("v").agg(F.count("*").alias("n")).filter("v = '' or n > 1").orderBy("v").limit(20).collect()
        if bad:
            raise PackageError("ids empty or repeated: " + ", ".join(repr(b.v) for b in bad))
        return out
    by = {"downstream": [F.desc("acc"), F.col("fid")], "input": [F.col("fid")], "chainage": [F.col("chainage"), F.col("fid")]}[order]
    if order == "chainage" and points.filter("chainage is null").limit(1).count():
        raise PackageError("numbering along the road needs every chainage")
    own, n = numbered(points, by, "_k", start)
    return own.withColumn("outlet_uid", F.concat(F.lit(prefix), padded(F.col("_k"), n + start - 1, width))).drop("_k")


def build_records(flow: DataFrame, cells: DataFrame, points: DataFrame, info: GridInfo, stream: DataFrame | None = None, radius: int = 5, local: bool = False, orders: DataFrame | None = None, channel_cells: float | None = None, sheet_cap_m: float = 100.0, slope_m: float = 200.0, blocks: dict[str, DataFrame] | None = None, polygons: bool = True, **numbering) -> dict[str, DataFrame]:
    """``crossings``, ``catchments``, ``flowpaths``, ``paths`` (outlet_uid, pos, id, cum_m), ``members`` (outlet, id) and ``issues`` (outlet_uid, issue) of pour points.

    ``flow`` is (id, r, c, dir, parent, acc), ``cells`` the measured surface (id, r, c, z), ``stream`` the cells points snap to, ``orders`` (id, order) Strahler orders. ``channel_cells`` is the accumulation at which
    channels begin; with it paths are split into overland and channel parts and the network is measured. ``blocks`` are further figures of catchments (tables keyed by ``outlet``). Catchments
    are full, or ``local``: without those of outlets upstream.
    """
    good, problems = snapped(points, flow, stream, info, radius)
    own = cut(with_uids(good, **numbering), "outlets")
    if not own.limit(1).count():
        raise PackageError("no usable pour point")
    outlets = own.select(F.col("outlet_uid").alias("outlet"), "id")
    member = cut(drainage.catchments(flow, outlets, full=not local, info=info), "members")
    slope = cut(stencil.horn(cells.select("r", "c", "z"), info).select("r", "c", "slope"), "slope")
    ground = cut(cells.select("id", "r", "c", "z").join(slope, ["r", "c"]), "ground")
    figures = drainage.characteristics(ground, member, info)
    if local:  # the longest path of a local catchment ends where it leaves the zone upstream
        inner = flow.join(member.select("id", "outlet"), "id").select("id", "r", "c", "dir", "acc", "parent", "outlet")
        same = member.select(F.col("id").alias("parent"), F.col("outlet").alias("_o"))
        inner = inner.join(same, "parent", "left").withColumn("parent", F.when(F.col("_o") == F.col("outlet"), F.col("parent"))).drop("_o", "outlet")
        paths = cut(drainage.longest_paths(cut(inner, "zones"), outlets, info), "paths")
    else:
        paths = cut(drainage.longest_paths(flow, outlets, info), "paths")
    figures = figures.join(drainage.path_figures(paths, ground), "outlet", "left").withColumn("catch_relief_ratio", F.when(F.col("lfp_length_m") > 0, F.col("relief_m") / F.col("lfp_length_m")))
    figures = figures.join(conditioning.truncation(member, cells, outlets, info), "outlet", "left")
    length = F.col("lfp_length_m")
    figures = figures.join(geometry.perimeters(member.select("outlet", F.expr(f"cast(id div {info.cols} as int)").alias("r"), F.expr(f"cast(id % {info.cols} as int)").alias("c")), info), "outlet", "left")
    figures = figures.withColumn("form_factor", F.when(length > 0, H.form_factor(F.col("area_km2"), length))).withColumn("elongation_ratio", F.when(length > 0, H.elongation(F.col("area_km2"), length))).withColumn("circularity_ratio", F.when(F.col("perimeter_m") > 0, H.circularity(F.col("area_km2"), F.col("perimeter_m"))))
    if channel_cells:
        begins = drainage.streams(flow, threshold_cells=channel_cells)
        figures = figures.join(drainage.path_split(paths, flow, ground, channel_cells, sheet_cap_m).drop("length_m"), "outlet", "left")
        figures = figures.join(drainage.network_stats(flow, begins, member, info, orders), "outlet", "left").withColumn("drainage_density", H.drainage_density(F.coalesce("channel_length_m", F.lit(0.0)), F.col("area_km2"))).withColumn("stream_frequency", H.stream_frequency(F.coalesce("links", F.lit(0)), F.col("area_km2")))
    for block in (blocks or {}).values():
        figures = figures.join(block, "outlet", "left")
    figures = cut(figures.withColumn("catchment_mode", F.lit("local" if local else "full")).withColumnRenamed("outlet", "outlet_uid"), "figures")
    near = channel.channel_slopes(flow, cells, outlets, info, slope_m).select(F.col("outlet").alias("outlet_uid"), F.col("slope_up").alias("ch_slope_us"), F.col("slope_down").alias("ch_slope_ds"), F.col("len_up_m").alias("ch_len_us_m"), F.col("len_down_m").alias("ch_len_ds_m"))
    crossings = own.join(near, "outlet_uid", "left")
    crossings = crossings.join(orders.select("id", F.col("order").alias("stream_order")), "id", "left") if orders is not None else crossings.withColumn("stream_order", F.lit(None).cast("int"))
    crossings = crossings.select("outlet_uid", F.col("fid").alias("outlet_id"), "source_id", F.col("x").alias("input_x"), F.col("y").alias("input_y"), "outlet_x", "outlet_y", "snap_dist_m", ((F.col("acc") + 1) * info.cell_area_km2).alias("acc_at_outlet_km2"), "stream_order", F.col("chainage").alias("chainage_m"), F.lit("existing").alias("status"), "ch_slope_us", "ch_slope_ds", "ch_len_us_m", "ch_len_ds_m")
    catchments, flowpaths = figures, figures.filter("lfp_length_m > 0")
    if polygons:
        zones = geometry.zone_polygons(member.select("outlet", F.expr(f"cast(id div {info.cols} as int)").alias("r"), F.expr(f"cast(id % {info.cols} as int)").alias("c")), info)
        catchments = figures.join(zones.select(F.col("outlet").alias("outlet_uid"), F.col("n_vertices"), F.col("area_m2").alias("polygon_m2"), "wkb"), "outlet_uid")
        lines = geometry.path_lines(paths, info)
        flowpaths = flowpaths.join(lines.select(F.col("outlet").alias("outlet_uid"), "n_vertices", "wkb"), "outlet_uid")
        crossings = crossings.withColumn("wkb", _point("outlet_x", "outlet_y"))
    issues = problems.select(F.lit(None).cast("string").alias("outlet_uid"), F.concat(F.lit("point "), F.col("fid").cast("string"), F.lit(": "), "problem").alias("issue"))
    issues = issues.union(figures.filter("truncated = 1").select("outlet_uid", F.concat(F.lit("catchment reaches the edge of the data in "), F.col("truncated_cells").cast("string"), F.lit(" cells; its area is a lower bound"))))
    issues = issues.union(figures.filter("coalesce(lfp_length_m, 0) = 0").select("outlet_uid", F.lit("catchment of a single cell; no flow path")))
    return {"crossings": crossings, "catchments": catchments, "flowpaths": flowpaths, "paths": paths.withColumnRenamed("outlet", "outlet_uid"), "members": member, "issues": issues}


def _point(x: str, y: str):
    """Well-known binary of points."""

    @F.pandas_udf("binary")
    def encode(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([geometry.wkb_point(p, q) for p, q in zip(a.tolist(), b.tolist(), strict=True)])

    return encode(x, y)


def check(layers: dict[str, DataFrame]) -> None:
    """Stops on an empty or repeated key in a layer, or a row of a layer that no crossing has."""
    for name in LAYERS:
        if name in layers:
            bad = review.id_problems(layers[name], "outlet_uid").orderBy("value").limit(20).collect()
            if bad:
                raise PackageError(f"{name}: " + ", ".join(f"{b.problem} {b.value!r}" for b in bad))
    lost = review.link_problems(layers["crossings"], {n: layers[n] for n in LAYERS[1:] if n in layers}).filter("severity = 'error'").orderBy("layer", "outlet_uid").limit(20).collect()
    if lost:
        raise PackageError("rows without a crossing: " + ", ".join(f"{r.layer} {r.outlet_uid}" for r in lost))


#: What fields of the layers mean: name, unit, text.
DICTIONARY = (
    ("outlet_uid", "", "key of a crossing, its catchment and its flow path"), ("outlet_id", "", "feature number of the input point; not a key"), ("source_id", "", "the input's own id"),
    ("input_x", "m", "input point"), ("input_y", "m", "input point"), ("outlet_x", "m", "centre of the outlet's cell"), ("outlet_y", "m", "centre of the outlet's cell"), ("snap_dist_m", "m", "from the input point to the outlet"),
    ("acc_at_outlet_km2", "km2", "area by the accumulation at the outlet"), ("stream_order", "", "Strahler order"), ("chainage_m", "m", "along the road"), ("status", "", "existing or proposed"),
    ("ch_slope_us", "m/m", "slope of the channel above"), ("ch_slope_ds", "m/m", "slope of the channel below"), ("ch_len_us_m", "m", "length of the channel above"), ("ch_len_ds_m", "m", "length of the channel below"),
    ("catchment_mode", "", "full, or local without catchments upstream"), ("area_km2", "km2", "catchment area"), ("n_cells", "", "cells of the catchment"), ("truncated", "", "whether it reaches the edge of the data"), ("truncated_cells", "", "cells on that edge"),
    ("elev_max_m", "m", "highest ground"), ("elev_min_m", "m", "lowest ground"), ("elev_mean_m", "m", "mean elevation"), ("relief_m", "m", "highest less lowest"), ("catch_slope_horn", "m/m", "mean slope of the ground"), ("slope_median", "m/m", "median slope of the ground"),
    ("catch_relief_ratio", "m/m", "relief over the length of the longest path"), ("perimeter_m", "m", "smoothed outline"), ("form_factor", "", "area over length squared"), ("elongation_ratio", "", "diameter of an equal circle over length"), ("circularity_ratio", "", "area over that of a circle of equal outline"),
    ("drainage_density", "km/km2", "channel length over area"), ("stream_frequency", "1/km2", "channel links over area"), ("max_order", "", "highest Strahler order"), ("lfp_length_m", "m", "length of the longest path"), ("lfp_elev_max_m", "m", "highest point on it"), ("lfp_elev_min_m", "m", "lowest point on it"),
    ("lfp_drop_m", "m", "highest less lowest on it"), ("lfp_slope", "m/m", "drop over length"), ("lfp_slope_1085", "m/m", "between 10 and 85 % from the outlet"), ("lfp_z10_m", "m", "elevation at 10 %"), ("lfp_z85_m", "m", "elevation at 85 %"), ("lfp_z_head_m", "m", "elevation of its head"),
    ("lfp_z_outlet_m", "m", "elevation of its outlet"), ("lfp_nonmonotonic", "", "whether it rises by more than half a metre"), ("overland_m", "m", "part above the channel"), ("channel_m", "m", "part in the channel"), ("sheet_m", "m", "sheet flow within the overland part"), ("shallow_m", "m", "the rest of it"),
    ("overland_slope", "m/m", "slope of the overland part"), ("channel_slope", "m/m", "slope of the channel part"), ("no_channel", "", "whether the path has no channel"),
)


def dictionary(layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, position, field, type, unit, description) of the layers' fields."""
    texts = {n: (u, t) for n, u, t in DICTIONARY}
    rows = [(name, k, f, t, *texts.get(f, ("", ""))) for name, layer in layers.items() for k, (f, t) in enumerate(layer.dtypes) if t != "binary"]
    return next(iter(layers.values())).sparkSession.createDataFrame(rows, "layer string, position int, field string, type string, unit string, description string")


def fingerprint(spark, path: str, most: int = 512 << 20) -> str:
    """``sha256:...`` of a file, or its size and time if it is larger than ``most`` bytes."""
    f = spark.read.format("binaryFile").load(path).select("length", "modificationTime").first()
    if f is None:
        return ""
    if f.length > most:
        return f"size={f.length};mtime={int(f.modificationTime.timestamp())}"
    return "sha256:" + spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first().h


def metadata(spark, values: dict) -> DataFrame:
    """(key, value) of a run, sorted by key; values that are not texts become JSON with sorted keys."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True, default=str)
    return spark.createDataFrame([(k, text(v)) for k, v in sorted(values.items())], "key string, value string")


def validate(layers: dict[str, DataFrame], version: str, major: int = 1) -> list[str]:
    """Problems of a package: another major version, missing key fields, empty or repeated keys, orphans (errors) and crossings without a row (warnings)."""
    out = []
    if not version or version.split(".")[0] != str(major):
        out.append(f"error: version {version!r} is not {major}.x")
    for name in LAYERS:
        if name not in layers:
            out.append(f"error: no layer {name}")
        elif "outlet_uid" not in layers[name].columns:
            out.append(f"error: {name} has no outlet_uid")
    if any(x.startswith("error: no layer crossings") or "outlet_uid" in x for x in out):
        return out
    for name in LAYERS:
        if name in layers:
            out += [f"error: {name}: {b.problem} {b.value!r}" for b in review.id_problems(layers[name], "outlet_uid").orderBy("value").limit(50).collect()]
    found = review.link_problems(layers["crossings"], {n: layers[n] for n in LAYERS[1:] if n in layers}).orderBy("severity", "layer", "outlet_uid").limit(200).collect()
    return out + [f"{r.severity}: {r.layer} {r.outlet_uid}" for r in found]


def characteristics_rows(layers: dict[str, DataFrame], fields: list[tuple[str, str]]) -> DataFrame:
    """One row a crossing with ``fields`` (layer, field) of the layers, along the road; crossings without a chainage last, then by key. Fields without any value are left out."""
    out = layers["crossings"].select("outlet_uid", F.col("chainage_m").alias("_ch"))
    for name in dict.fromkeys(n for n, _ in fields):
        own = [f for n, f in fields if n == name and f in layers[name].columns and f != "outlet_uid"]
        out = out.join(layers[name].select("outlet_uid", *own), "outlet_uid", "left")
    held = out.agg(*[F.count(c).alias(c) for c in out.columns]).first()
    keep = [c for c in out.columns if c in ("outlet_uid", "_ch") or held[c]]
    return out.select(*keep).orderBy(F.col("_ch").asc_nulls_last(), "outlet_uid").drop("_ch")


def renumber(old: DataFrame, records: dict[str, DataFrame]) -> DataFrame:
    """(old_uid, new_uid, change, chainage_m, moved_m) between the crossings before (outlet_id, outlet_uid, outlet_x, outlet_y; a point that was added has no uid) and those built anew; uids that are gone are ``deleted``."""
    before = old.select("outlet_id", F.nullif(F.trim("outlet_uid"), F.lit("")).alias("old_uid"), F.col("outlet_x").alias("ox"), F.col("outlet_y").alias("oy"))
    new = records["crossings"].select("outlet_id", F.col("outlet_uid").alias("new_uid"), "chainage_m", "outlet_x", "outlet_y")
    both = new.join(before, "outlet_id", "left")
    change = F.when(F.col("old_uid").isNull(), "new").when(F.col("old_uid") == F.col("new_uid"), "unchanged").otherwise("renumbered")
    kept = both.select("old_uid", "new_uid", change.alias("change"), "chainage_m", F.sqrt((F.col("outlet_x") - F.col("ox")) ** 2 + (F.col("outlet_y") - F.col("oy")) ** 2).alias("moved_m"))
    gone = before.filter("old_uid is not null").join(kept.select("old_uid"), "old_uid", "left_anti").select("old_uid").distinct()
    return kept.union(gone.select("old_uid", F.lit(None).cast("string"), F.lit("deleted"), F.lit(None).cast("double"), F.lit(None).cast("double")))
