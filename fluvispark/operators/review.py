"""Identity, links between layers, renumbering, findings and sensitivity summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.grids import cut
from .ranks import numbered, padded


def sequential_ids(rows: DataFrame, order: list, prefix: str = "X") -> DataFrame:
    """Adds outlet_uid: prefix and number in ``order``, zero-padded to three digits or as many as are needed."""
    own, n = numbered(rows, order, "_k")
    return own.withColumn("outlet_uid", F.concat(F.lit(prefix), padded(F.col("_k"), n))).drop("_k")


def id_problems(rows: DataFrame, column: str) -> DataFrame:
    """(value, n, problem) of empty or repeated ids."""
    value = F.trim(F.coalesce(F.col(column).cast("string"), F.lit("")))
    by = rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return by.filter("value = '' or n > 1").withColumn("problem", F.when(F.col("value") == "", "empty").otherwise("duplicate"))


def link_problems(crossings: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """(layer, outlet_uid, severity): rows of a layer without a crossing are errors, crossings without a row warnings."""
    parts = []
    for name, layer in layers.items():
        parts.append(layer.select("outlet_uid").distinct().join(crossings, "outlet_uid", "left_anti").select(F.lit(name).alias("layer"), "outlet_uid", F.lit("error").alias("severity")))
        parts.append(crossings.select("outlet_uid").join(layer, "outlet_uid", "left_anti").select(F.lit(name), "outlet_uid", F.lit("warning")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def renumber_log(before: DataFrame, after: DataFrame) -> DataFrame:
    """(source_id, old_uid, new_uid, action) between two numberings (source_id, outlet_uid)."""
    both = before.select("source_id", F.col("outlet_uid").alias("old_uid")).join(after.select("source_id", F.col("outlet_uid").alias("new_uid")), "source_id", "full")
    action = F.when(F.col("old_uid").isNull(), "added").when(F.col("new_uid").isNull(), "deleted").when(F.col("old_uid") == F.col("new_uid"), "kept").otherwise("renumbered")
    return both.withColumn("action", action)


SEVERITIES = ("high", "medium", "low", "info")


def register(rows: DataFrame, rules: list[tuple]) -> DataFrame:
    """Findings of ``rows`` (outlet_uid, chainage_m, ...) by rules (condition, severity, title, and perhaps an evidence column and a check): most severe first, then along the road.

    Severity is a number (greater is worse) or one of ``SEVERITIES``. Ids are padded to three digits, or as many as the number of findings has.
    """
    level = lambda v: len(SEVERITIES) - 1 - SEVERITIES.index(v) if isinstance(v, str) else v
    evidence = any(len(r) > 3 for r in rules)
    parts = []
    for condition, severity, title, *more in rules:
        extra = [(more[0] if more else F.lit("")).cast("string").alias("evidence"), F.lit(more[1] if len(more) > 1 else "").alias("check")] if evidence else []
        parts.append(rows.filter(condition).select("outlet_uid", "chainage_m", F.lit(level(severity)).alias("severity"), F.lit(title).alias("finding"), *extra))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    own, n = numbered(out, [F.desc("severity"), F.col("chainage_m").asc_nulls_last(), F.col("outlet_uid"), F.col("finding")], "_k")
    return own.withColumn("finding_id", F.concat(F.lit("F"), padded(F.col("_k"), n))).drop("_k")


def register_counts(findings: DataFrame) -> DataFrame:
    """(severity, n), every severity present once."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


METHODS = ("kirpich", "kerby_kirpich", "scs_lag", "tr55", "bransby")


@dataclass(frozen=True)
class Limit:
    """A figure of a crossing and what makes it a finding: ``passed`` is over the figure's column, ``level`` 0 (a note) to 3 (do not use)."""

    code: str
    figure: str
    passed: Callable[[Column], Column]
    level: int
    unit: str = ""
    unless: str | None = None


def package_limits(cell_m: float) -> list[Limit]:
    """What is asked of the figures of a package's crossings, by what they describe: the outlet's place, the area above it, the path, the derived quantities, the record itself."""
    yes, above = (lambda c: c == 1), (lambda most: lambda c: c > most)
    outlet = [
        Limit("outlet.far", "snap_dist_m", above(2.5 * cell_m), 1, "m"),
        Limit("outlet.unmapped", "map_agrees", lambda c: c == 0, 2),
        Limit("outlet.other-channel", "flat_moved", yes, 3),
        Limit("outlet.unsteady", "sens_max_area_pct", lambda c: F.abs(c) > 25, 2, "%"),
    ]
    area = [
        Limit("area.open", "truncated", yes, 3, "cells"),
        Limit("area.clipped", "clip_edge", yes, 3),
        Limit("area.flats", "flat_sensitive", yes, 2, "%", unless="flat_moved"),
        Limit("area.noise", "unc_worst_pct", above(0), 2, "%"),
    ]
    derived = [
        Limit("path.rises", "lfp_nonmonotonic", yes, 1),
        Limit("time.extrapolated", "tc_outside_share", above(0.5), 1),
        Limit("soil.no-erodibility", "soil_unknown", yes, 1),
    ]
    return [*outlet, *area, *derived, Limit("record.proposed", "is_proposed", yes, 0)]


def package_findings(rows: DataFrame, cell_m: float) -> DataFrame:
    """The register of ``package_limits`` over ``rows`` (outlet_uid, chainage_m and whatever figures they have): severity, finding (the limit's code), figure, value, unit and finding_id, worst first, then along the road."""
    kinds = {"status": "string", "has_soil": "boolean"} | {f"{m}_flag": "string" for m in METHODS}
    limits = package_limits(cell_m)
    plain = {"switch_pct", "lost_pct", "k_williams", *kinds, *(f"tc_{m}" for m in METHODS)} | {x.figure for x in limits} - {"unc_worst_pct", "tc_outside_share", "soil_unknown", "is_proposed"}
    for n in sorted(plain - set(rows.columns)):
        rows = rows.withColumn(n, F.lit(None).cast(kinds.get(n, "double")))
    known = [F.col(f"tc_{m}").isNotNull().cast("int") for m in METHODS]
    beyond = [(F.col(f"tc_{m}").isNotNull() & F.coalesce(F.lower(f"{m}_flag").startswith("outside"), F.lit(False))).cast("int") for m in METHODS]
    rows = rows.withColumns({
        "unc_worst_pct": F.greatest(F.col("switch_pct"), F.col("lost_pct")), "tc_outside_share": F.try_divide(sum(beyond[1:], beyond[0]).cast("double"), sum(known[1:], known[0])),
        "soil_unknown": (F.col("has_soil") & F.col("k_williams").isNull()).cast("int"), "is_proposed": (F.col("status") == "proposed").cast("int"),
    })
    found = []
    for x in limits:
        hit = x.passed(F.col(x.figure)) & ((F.coalesce(F.col(x.unless), F.lit(0)) != 1) if x.unless else F.lit(True))
        found.append(F.when(hit, F.struct(F.lit(x.level).alias("severity"), F.lit(x.code).alias("finding"), F.lit(x.figure).alias("figure"), F.col(x.figure).cast("double").alias("value"), F.lit(x.unit).alias("unit"))))
    out = rows.select("outlet_uid", "chainage_m", F.explode(F.filter(F.array(*found), lambda f: f.isNotNull())).alias("f")).select("outlet_uid", "chainage_m", "f.*")
    own, n = numbered(out, [F.desc("severity"), F.col("chainage_m").asc_nulls_last(), F.col("outlet_uid"), F.col("finding")], "_k")
    return own.withColumn("finding_id", F.concat(F.lit("F"), padded(F.col("_k"), n))).drop("_k")


def depressions(labels: DataFrame, cell_area_m2: float, most: int = 5000, least_depth: float = 0.5) -> DataFrame:
    """(component, n_cells, area_m2, max_depth_m, mean_depth_m, volume_m3, deepest_r, deepest_c) of labelled depressions, deepest first: the ``most`` deepest."""
    got = labels.groupBy("component").agg(F.count("*").alias("n_cells"), F.max(F.struct("depth", (-F.col("r")).alias("r"), (-F.col("c")).alias("c"))).alias("d"), F.sum("depth").alias("s"))
    got = got.select("component", "n_cells", (F.col("n_cells") * cell_area_m2).alias("area_m2"), F.col("d.depth").alias("max_depth_m"), (F.col("s") / F.col("n_cells")).alias("mean_depth_m"), (F.col("s") * cell_area_m2).alias("volume_m3"), (-F.col("d.r")).alias("deepest_r"), (-F.col("d.c")).alias("deepest_c"))
    return got.filter(F.col("max_depth_m") >= least_depth).orderBy(F.desc("max_depth_m"), "component").limit(most)


def depressions_by_road(found: DataFrame, labels: DataFrame, segments: DataFrame, info, crossings: DataFrame | None = None, deep_m: float = 1.0, half_width_m: float = 15.0, near_m: float = 100.0) -> DataFrame:
    """``found`` (of ``depressions``) with dist_road_m, road, chainage_m, nearest_m, touches_road and flag: ``deep_at_road`` or ``deep_near_road``.

    The distance is that of the nearest cell's centre less half a diagonal; the chainage that of the deepest cell. Cells farther than ``near_m`` and half a diagonal from any road have none.
    """
    from . import linear

    half = 0.5 * (info.cw**2 + info.ch**2) ** 0.5
    cells = labels.join(found.select("component"), "component", "left_semi").select(F.struct("component", "r", "c").alias("fid"), info.x(F.col("c")).alias("x"), info.y(F.col("r")).alias("y"))
    near = linear.locate(cells, segments, radius=near_m + half, within=near_m + half).groupBy(F.col("fid.component").alias("component")).agg(F.greatest(F.min("distance") - half, F.lit(0.0)).alias("dist_road_m"))
    deep = linear.locate(found.select(F.col("component").alias("fid"), info.x(F.col("deepest_c")).alias("x"), info.y(F.col("deepest_r")).alias("y")), segments).select(F.col("fid").alias("component"), "road", F.col("chainage").alias("chainage_m"))
    out = found.join(near, "component", "left").join(deep, "component", "left").withColumn("touches_road", F.coalesce(F.col("dist_road_m") <= half_width_m, F.lit(False)))
    if crossings is not None:
        along = linear.nearest_along(out.filter("chainage_m is not null").select("road", "chainage_m", "component"), crossings).select("component", "nearest_m")
        out = out.join(along, "component", "left")
    deep_ = F.col("max_depth_m") >= deep_m
    return out.withColumn("flag", F.when(deep_ & F.col("touches_road"), "deep_at_road").when(deep_ & (F.col("dist_road_m") <= near_m), "deep_near_road"))


def flat_sensitivity(flows: dict[str, DataFrame], outlets: DataFrame, flats: DataFrame, info, members: DataFrame | None = None, paths: DataFrame | None = None, tolerance: float = 0.10, search: int = 1, threshold_cells: float | None = None) -> DataFrame:
    """(outlet, area_barnes_km2, area_toward_km2, flat_sensitivity_pct, flat_sensitive, flat_area_ratio, flat_moved, flat_catch_share_pct, flat_lfp_share_pct).

    ``flows`` has the routings ``barnes`` and ``toward``; an outlet's area is the greatest within ``search`` cells. The channel has moved if one routing reaches the stream threshold there and the other does not (without a threshold:
    if the smaller area is under a tenth of the larger). ``flats`` (id) are cells without descent off the boundary; shares are those of zones (outlet, id) and longest paths (outlet, id).
    """
    here = outlets.select("outlet", F.expr(f"cast(id div {info.cols} as int)").alias("r0"), F.expr(f"cast(id % {info.cols} as int)").alias("c0"))
    near = here.withColumn("r", F.explode(F.sequence(F.col("r0") - search, F.col("r0") + search))).withColumn("c", F.explode(F.sequence(F.col("c0") - search, F.col("c0") + search))).select("outlet", "r", "c")
    out = outlets.select("outlet").distinct()
    for name in ("barnes", "toward"):
        out = out.join(near.join(flows[name].select("r", "c", "acc"), ["r", "c"]).groupBy("outlet").agg((F.max("acc") + 1).alias(f"n_{name}")), "outlet", "left")
    a, b = F.col("n_barnes"), F.col("n_toward")
    rel = F.abs(a - b) / F.greatest(a, b)
    moved = (a >= threshold_cells) != (b >= threshold_cells) if threshold_cells else F.least(a, b) < 0.1 * F.greatest(a, b)
    out = out.select("outlet", (a * info.cell_area_km2).alias("area_barnes_km2"), (b * info.cell_area_km2).alias("area_toward_km2"), (100 * rel).alias("flat_sensitivity_pct"), (rel > tolerance).cast("int").alias("flat_sensitive"), (b / a).alias("flat_area_ratio"), moved.cast("int").alias("flat_moved"))
    mark = flats.select("id", F.lit(1.0).alias("flat")).distinct()
    for rows, name in ((members, "flat_catch_share_pct"), (paths, "flat_lfp_share_pct")):
        if rows is not None:
            out = out.join(rows.select("outlet", "id").join(mark, "id", "left").groupBy("outlet").agg((100 * F.avg(F.coalesce("flat", F.lit(0.0)))).alias(name)), "outlet", "left")
    return out


def crossing_sensitivity(flows: dict[str, tuple[DataFrame, DataFrame]], points: DataFrame, info, threshold_cells: float = 200.0, radius: int = 5, method: str = "barnes", dem_error: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(long table (outlet_uid, factor, setting, area_km2, d_area_pct, lfp_length_m, d_lfp_pct, outlet_moved, outlet_lost), summary (outlet_uid, base_area_km2, base_lfp_length_m, sens_max_area_pct, sens_area_factor, sens_max_lfp_pct,
    sens_lfp_factor, sens_moved)) of crossings (outlet_uid, x, y and perhaps outlet_x, outlet_y).

    ``flows`` maps a flat method to (flow, longest upstream lengths (id, up_len)). The base is the outlet, where there is one; else, as all variants but that of the flat method, which starts at the outlet, the input point is snapped. Variants are the other flat
    method, half and twice the snap radius, half and twice the threshold, and ``dem_error`` (outlet_uid, q, area_km2, lfp_length_m).
    """
    from . import drainage

    other = "toward" if method == "barnes" else "barnes"
    flow, lengths = flows[method]
    has_outlet = "outlet_x" in points.columns

    def at(cells: DataFrame, name: str) -> DataFrame:
        f, up = flows[name]
        return cells.join(f.select("r", "c", "id", "acc"), ["r", "c"]).join(up.select("id", "up_len"), "id").select("outlet_uid", "r", "c", ((F.col("acc") + 1) * info.cell_area_km2).alias("area_km2"), F.col("up_len").alias("lfp_length_m"))

    def snap(name: str, n: int, threshold: float, x: str = "x", y: str = "y") -> DataFrame:
        f, _ = flows[name]
        stream = drainage.streams(f, threshold_cells=threshold)
        got = drainage.snap(points.select(F.col("outlet_uid").alias("fid"), F.col(x).alias("x"), F.col(y).alias("y")), stream, info, n).select(F.col("fid").alias("outlet_uid"), F.col("snap_r").alias("r"), F.col("snap_c").alias("c"))
        # a row a crossing; written down, so that no task runs the joins of all variants
        return cut(at(got.join(stream.select("r", "c"), ["r", "c"], "left_semi"), name), "snapped")

    if has_outlet:
        base = at(points.select("outlet_uid", info.row(F.col("outlet_y")).alias("r"), info.col(F.col("outlet_x")).alias("c")), method)
    else:
        base = snap(method, radius, threshold_cells)
    ox, oy = ("outlet_x", "outlet_y") if has_outlet else ("x", "y")
    variants = [("flat method", other, snap(other, max(1, radius), threshold_cells, ox, oy))]
    variants += [("snap radius", f"{n} cells", snap(method, n, threshold_cells)) for n in (max(1, radius // 2), max(2, 2 * radius))]
    variants += [("stream threshold", f"{t:g} cells", snap(method, radius, t)) for t in (max(1.0, threshold_cells / 2), threshold_cells * 2)]
    every = points.select("outlet_uid")
    b = base.select("outlet_uid", F.col("area_km2").alias("ba"), F.col("lfp_length_m").alias("bl"), F.col("r").alias("br"), F.col("c").alias("bc"))
    b = cut(every.join(b, "outlet_uid", "left"), "base")
    pct = lambda v, w: F.when(F.col(w) != 0, 100 * (F.col(v) - F.col(w)) / F.col(w))
    long = b.select("outlet_uid", F.lit("base").alias("factor"), F.lit(method).alias("setting"), F.col("ba").alias("area_km2"), F.when(F.col("ba").isNotNull(), 0.0).alias("d_area_pct"), F.col("bl").alias("lfp_length_m"), F.when(F.col("bl").isNotNull(), 0.0).alias("d_lfp_pct"), F.lit(0).alias("outlet_moved"), F.col("ba").isNull().cast("int").alias("outlet_lost"))
    for factor, setting, got in variants:
        own = b.join(got, "outlet_uid", "left")
        moved = F.coalesce(F.greatest(F.abs(F.col("r") - F.col("br")), F.abs(F.col("c") - F.col("bc"))) > 1, F.lit(False)).cast("int")
        long = long.union(own.select("outlet_uid", F.lit(factor), F.lit(setting), "area_km2", pct("area_km2", "ba"), "lfp_length_m", pct("lfp_length_m", "bl"), moved, F.col("area_km2").isNull().cast("int")))
    if dem_error is not None:
        own = b.join(dem_error, "outlet_uid")
        long = long.union(own.select("outlet_uid", F.lit("elevation error"), F.upper("q"), "area_km2", pct("area_km2", "ba"), "lfp_length_m", pct("lfp_length_m", "bl"), F.lit(None).cast("int"), F.lit(None).cast("int")))
    name = F.concat("factor", F.lit(" ("), "setting", F.lit(")"))
    other_rows = long.filter("factor <> 'base'")
    worst = lambda v: F.max(F.when(F.col(v).isNotNull(), F.struct(F.abs(v).alias("d"), name.alias("n"))))
    summary = other_rows.groupBy("outlet_uid").agg(worst("d_area_pct").alias("a"), worst("d_lfp_pct").alias("l"), F.array_join(F.array_sort(F.collect_set(F.when((F.col("outlet_moved") == 1) | (F.col("outlet_lost") == 1), name))), "; ").alias("sens_moved"))
    summary = b.select("outlet_uid", F.col("ba").alias("base_area_km2"), F.col("bl").alias("base_lfp_length_m")).join(summary, "outlet_uid", "left").select("outlet_uid", "base_area_km2", "base_lfp_length_m", F.col("a.d").alias("sens_max_area_pct"), F.col("a.n").alias("sens_area_factor"), F.col("l.d").alias("sens_max_lfp_pct"), F.col("l.n").alias("sens_lfp_factor"), "sens_moved")
    return long, summary


def agreement(stream: DataFrame, mapped: DataFrame) -> DataFrame:
    """Precision, recall and F1 of stream cells (r, c, w) against mapped cells (r, c, w), weighted by length."""
    tp = stream.join(mapped.select("r", "c"), ["r", "c"], "left_semi").agg(F.sum("w").alias("tp"))
    back = mapped.join(stream.select("r", "c"), ["r", "c"], "left_semi").agg(F.sum("w").alias("tm"))
    sums = stream.agg(F.sum("w").alias("s")).join(mapped.agg(F.sum("w").alias("m"))).join(tp).join(back)
    p, r = F.coalesce("tp", F.lit(0.0)) / F.col("s"), F.coalesce("tm", F.lit(0.0)) / F.col("m")
    return sums.select(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1"))


def variant_summary(rows: DataFrame) -> DataFrame:
    """Long table (outlet, variant, value; variant 'base' among them) to the change of each variant and the worst one."""
    base = rows.filter("variant = 'base'").select("outlet", F.col("value").alias("base"))
    other = rows.filter("variant <> 'base'").join(base, "outlet").withColumn("change_pct", 100 * (F.col("value") - F.col("base")) / F.col("base"))
    worst = other.groupBy("outlet").agg(F.max_by(F.struct("variant", "change_pct"), F.struct(F.abs("change_pct").alias("a"), "variant")).alias("w"))
    return worst.select("outlet", F.col("w.variant").alias("worst_variant"), F.col("w.change_pct").alias("worst_change_pct"))


def realisation_summary(rows: DataFrame) -> DataFrame:
    """(outlet, n, p10, p50, p90, cv, lost_pct) of realisations (outlet, realisation, value; null where lost)."""
    return rows.groupBy("outlet").agg(
        F.count("*").alias("n"), F.percentile("value", 0.1).alias("p10"), F.percentile("value", 0.5).alias("p50"), F.percentile("value", 0.9).alias("p90"), (F.stddev_pop("value") / F.avg("value")).alias("cv"), (100 * F.sum(F.col("value").isNull().cast("int")) / F.count("*")).alias("lost_pct")
    )
