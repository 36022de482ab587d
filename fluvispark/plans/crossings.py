"""Queries over crossings: packages, zones, channels, coverage, sensitivity; on the derived grids, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import channel, conditioning, coverage, drainage, fill, geometry, graph, linear, package, review, stencil, uncertainty, zonal
from ..sources.grids import GRID_SQL, cut, grid
from .analysis import road
from .terrain import ACC, CLOSURE, D8, OUT, PAIRS, PATHS, along, ctes, dem, routed, rounded, top_outlets

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


MEMBER = "m AS (SELECT outlet, src AS id FROM up JOIN outs ON up.dst = oid UNION ALL SELECT outlet, oid FROM outs)"
BASE = f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, {MEMBER}"


def zones(spark, sf_dir):
    """(flow, info, outlets (outlet, id), members): the catchments of the twelve cells of the greatest accumulation."""
    flow, info = routed(spark, sf_dir)
    outlets = cut(top_outlets(flow).select("outlet", "id"), "outlets")
    return flow, info, outlets, cut(drainage.catchments(flow, outlets, full=True, info=info), "members")


# zones' cells, their corners (one for a convex or concave one, two where cells meet crosswise) and runs of cells, joined to parts
SHAPES = """z AS (SELECT outlet, id // nc AS r, id % nc AS c FROM m, dims), v AS (SELECT outlet, vr, vc, count(*) AS n, count(DISTINCT (q // 2 + q % 2) % 2) AS sides FROM (SELECT outlet, r + q // 2 AS vr, c + q % 2 AS vc, q FROM z, range(4) AS t(q)) GROUP BY ALL),
k AS (SELECT outlet, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND sides = 1 THEN 2 ELSE 0 END) AS n_corners FROM v GROUP BY outlet),
s AS (SELECT outlet, r, min(c) AS a, max(c) AS b FROM (SELECT *, c - row_number() OVER (PARTITION BY outlet, r ORDER BY c) AS g FROM z) GROUP BY outlet, r, g),
near AS (SELECT x.outlet, x.r AS r0, x.a AS a0, y.r AS r1, y.a AS a1 FROM s x JOIN s y ON x.outlet = y.outlet AND abs(x.r - y.r) = 1 AND x.a <= y.b AND y.a <= x.b),
reach AS (SELECT outlet, r, a, r AS pr, a AS pa FROM s UNION SELECT n.outlet, n.r1, n.a1, pr, pa FROM reach JOIN near n ON n.outlet = reach.outlet AND n.r0 = reach.r AND n.a0 = reach.a),
p AS (SELECT outlet, count(DISTINCT root) AS n_parts FROM (SELECT outlet, r, a, min(pr * 1000000 + pa) AS root FROM reach GROUP BY ALL) GROUP BY outlet)"""


@query(f"{BASE}, {SHAPES} SELECT outlet, round(CAST(count(*) * 900 AS DOUBLE), 6) AS area_m2, CAST(any_value(n_parts) AS INT) AS n_parts, CAST(any_value(n_corners) AS INT) AS n_corners FROM m JOIN p USING (outlet) JOIN k USING (outlet) GROUP BY outlet")
def zone_polygons(spark, sf_dir):
    flow, info, _, member = zones(spark, sf_dir)
    got = geometry.zone_polygons(member.join(flow.select("id", "r", "c"), "id"), info)
    return rounded(got.select("outlet", "area_m2", "n_parts", (F.col("n_vertices") - F.col("n_parts") - F.col("n_holes")).alias("n_corners")))


@query(f"{BASE}, edge AS (SELECT g.cell_id AS id FROM g LEFT JOIN pair USING (cell_id) GROUP BY g.cell_id HAVING count(nid) < 8), t AS (SELECT m.outlet, count(*) AS n FROM m JOIN edge USING (id) JOIN outs ON outs.outlet = m.outlet JOIN g a ON a.cell_id = m.id JOIN g b ON b.cell_id = oid WHERE abs(a.r - b.r) > 1 OR abs(a.c - b.c) > 1 GROUP BY m.outlet) SELECT outs.outlet, coalesce(n, 0) AS truncated_cells, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS INT) AS truncated FROM outs LEFT JOIN t ON t.outlet = outs.outlet")
def zone_truncation(spark, sf_dir):
    flow, info, outlets, member = zones(spark, sf_dir)
    return conditioning.truncation(member, flow, outlets, info)


@query(f"{BASE}, s AS (SELECT flow.cell_id, parent, CASE WHEN dir % 2 = 1 THEN sqrt(1800.0) ELSE 30.0 END AS len FROM flow JOIN acc USING (cell_id) WHERE acc.acc >= 20), x AS (SELECT m.outlet, s.* FROM m JOIN s ON s.cell_id = m.id), y AS (SELECT x.*, p.cell_id IS NOT NULL AS inside FROM x LEFT JOIN x p ON p.outlet = x.outlet AND p.cell_id = x.parent), d AS (SELECT outlet, parent, count(*) AS n FROM y WHERE inside GROUP BY 1, 2) SELECT y.outlet, round(sum(CASE WHEN inside THEN len ELSE 0 END), 6) AS channel_length_m, CAST(sum(CASE WHEN coalesce(d.n, 0) <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS links FROM y LEFT JOIN d ON d.outlet = y.outlet AND d.parent = y.cell_id GROUP BY y.outlet")
def zone_network(spark, sf_dir):
    flow, info, _, member = zones(spark, sf_dir)
    return rounded(drainage.network_stats(flow, drainage.streams(flow, threshold_cells=20), member, info).select("outlet", "channel_length_m", "links"))


@query()
def zone_perimeters(spark, sf_dir):
    flow, info, _, member = zones(spark, sf_dir)
    return rounded(geometry.perimeters(member.join(flow.select("id", "r", "c"), "id"), info))


@query(f"""{BASE}, {PATHS}, {along('pz', 's')}, e AS (SELECT outlet, max(cum) AS l, max(z) AS hi, min(z) AS lo, arg_max(z, pos) AS head, arg_min(z, pos) AS foot FROM pz GROUP BY outlet)
SELECT outlet, round(l, 6) AS lfp_length_m, hi AS lfp_elev_max_m, lo AS lfp_elev_min_m, head AS lfp_z_head_m, foot AS lfp_z_outlet_m, round(hi - lo, 6) AS lfp_drop_m, CAST(CASE WHEN hi - lo - (head - foot) > 0.5 THEN 1 ELSE 0 END AS INT) AS lfp_nonmonotonic, round(CASE WHEN l > 0 THEN (hi - lo) / l END, 6) AS lfp_slope,
round(CASE WHEN length_m > 0 THEN (z85 - z10) / (0.75 * length_m) END, 6) AS lfp_slope_1085, round(z10, 6) AS lfp_z10_m, round(z85, 6) AS lfp_z85_m FROM e JOIN s USING (outlet)""")
def lfp_figures(spark, sf_dir):
    flow, info, outlets, _ = zones(spark, sf_dir)
    return rounded(drainage.path_figures(drainage.longest_paths(flow, outlets, info), flow))


@query()
def chan_slopes(spark, sf_dir):
    flow, info, outlets, _ = zones(spark, sf_dir)
    return rounded(channel.channel_slopes(flow, flow, outlets, info))


def eroded(flow, info):
    slope = stencil.horn(flow.select("r", "c", "z"), info).select("r", "c", "slope")
    return zonal.erosion_layers(flow.select("id", "r", "c", "acc", "z").join(slope, ["r", "c"]).withColumn("channel", F.col("acc") >= 30), info.cw, info.ch)


@query()
def chan_deposition(spark, sf_dir):
    flow, info, outlets, _ = zones(spark, sf_dir)
    return rounded(channel.deposition(flow, cut(eroded(flow, info), "erosion"), outlets, info, 60.0, 200.0))


@query()
def chan_sections(spark, sf_dir):
    flow, info, outlets, _ = zones(spark, sf_dir)
    return rounded(channel.sections(flow, flow, outlets, info).drop("xs_stations"))


@query()
def crossing_erosion(spark, sf_dir):
    flow, info, outlets, _ = zones(spark, sf_dir)
    cells = zonal.erosion_classes(eroded(flow, info).withColumn("a_loss", F.col("ls") * 10))
    return rounded(channel.crossing_erosion(flow, cut(cells, "erosion"), outlets, info))


@query()
def pkg_records(spark, sf_dir):
    """The package of all pour points that snap to cells of their own (the first by id on each cell)."""
    flow, info = routed(spark, sf_dir)
    stream = cut(drainage.streams(flow, threshold_cells=50), "streams")
    points = grid(spark, sf_dir, "outlets")
    first = drainage.snap(points, stream, info, 5).groupBy("snap_r", "snap_c").agg(F.min("fid").alias("fid")).select("fid")
    got = package.build_records(flow, flow, cut(points.join(first, "fid"), "points"), info, stream, channel_cells=50, polygons=False)
    return rounded(got["crossings"].join(got["catchments"], "outlet_uid"))


def conditioned(spark, sf_dir, name="dem_part"):
    cells, info = dem(spark, sf_dir, name)
    surface = cut(fill.fill_depressions(cells, info).select("r", "c", F.col("filled").alias("z")), "filled")
    plain = cut(stencil.d8_surface(surface, info), "plain")
    flows = {m: cut(graph.flow_accumulation(fill.resolve_flats(plain, info, m), info), "flow") for m in ("barnes", "toward")}
    return cells, surface, plain, flows, info


@query()
def sens_flats(spark, sf_dir):
    _, surface, plain, flows, info = conditioned(spark, sf_dir)
    outlets = cut(top_outlets(flows["barnes"]).select("outlet", "id"), "outlets")
    flats = plain.filter("dir is null and boundary = 0").select((F.col("r").cast("long") * info.cols + F.col("c")).alias("id"))
    return rounded(review.flat_sensitivity(flows, outlets, flats, info, drainage.catchments(flows["barnes"], outlets, full=True, info=info), drainage.longest_paths(flows["barnes"], outlets, info), threshold_cells=20))


@query()
def sens_crossings(spark, sf_dir):
    *_, flows, info = conditioned(spark, sf_dir)
    both = {m: (f, cut(drainage.upstream_lengths(f, info), "lengths")) for m, f in flows.items()}
    points = top_outlets(flows["barnes"]).select(F.col("outlet").alias("outlet_uid"), "id").withColumn("x", info.x(F.expr(f"id % {info.cols}"))).withColumn("y", info.y(F.expr(f"id div {info.cols}"))).drop("id")
    return rounded(review.crossing_sensitivity(both, points, info, 20, 3)[1])


@query()
def unc_crossings(spark, sf_dir):
    """Twenty realisations of the valley with pits; its outlets are the ends of its valley line."""
    cells, info = dem(spark, sf_dir, "dem_part")
    points = cells.filter("c = 20").groupBy().agg(F.max("r").alias("a"), F.min("r").alias("b")).select(F.explode(F.array(F.struct(F.lit("low").alias("uid"), F.col("a").alias("r")), F.struct(F.lit("high").alias("uid"), (F.col("b") + 2).alias("r")))).alias("p")).select("p.uid", info.x(F.lit(20)).alias("x"), info.y(F.col("p.r")).alias("y"))
    return rounded(uncertainty.summarise(uncertainty.crossings(cells, points, info, 20, uncertainty.PRESETS["FABDEM"], threshold_cells=20)))


@query(f"""WITH {ctes('dem_part')}, {PAIRS}, l AS (SELECT 'row' AS axis, r AS line, c AS pos, z FROM g UNION ALL SELECT 'col', c, r, z FROM g),
j AS (SELECT a.axis, a.line, count(*) AS n, sum(CASE WHEN a.z = b.z THEN 1 ELSE 0 END) AS n_equal, min(a.z) AS lo, max(a.z) AS hi FROM l a JOIN l b ON a.axis = b.axis AND a.pos = b.pos AND b.line = a.line - 1 GROUP BY 1, 2),
k AS (SELECT axis, sum(CASE WHEN n >= 50 AND n_equal >= 0.99 * n AND lo < hi THEN 1 ELSE 0 END) AS rep, sum(CASE WHEN n >= 50 THEN 1 ELSE 0 END) AS cmp FROM j GROUP BY axis),
lines AS (SELECT CAST(coalesce(max(CASE WHEN axis = 'row' THEN rep END), 0) AS BIGINT) AS rn, coalesce(max(CASE WHEN axis = 'row' THEN rep / greatest(cmp, 1) END), 0) AS rs, CAST(coalesce(max(CASE WHEN axis = 'col' THEN rep END), 0) AS BIGINT) AS cn, coalesce(max(CASE WHEN axis = 'col' THEN rep / greatest(cmp, 1) END), 0) AS cs FROM k),
rel AS (SELECT g.cell_id, greatest(g.z, coalesce(max(zn), g.z)) - least(g.z, coalesce(min(zn), g.z)) AS rel FROM g LEFT JOIN pair USING (cell_id) GROUP BY g.cell_id, g.z),
ties AS (SELECT count(*) AS n, sum(CASE WHEN z = zn THEN 1 ELSE 0 END) AS tied, sum(CASE WHEN z = zn AND a.rel > 0.1 AND b.rel > 0.1 THEN 1 ELSE 0 END) AS sloped FROM pair JOIN rel a ON a.cell_id = pair.cell_id JOIN rel b ON b.cell_id = nid WHERE k IN (0, 2)),
q(q) AS (VALUES (CAST(1.0 AS DOUBLE)), (0.5), (0.25), (0.2), (0.1), (0.05), (0.02), (0.01)), ulp AS (SELECT 4 * pow(2.0, floor(log2(max(abs(z)))) - 23) AS e FROM g),
step AS (SELECT max(CASE WHEN share >= 0.999 THEN q END) AS quantum FROM (SELECT q, avg(CASE WHEN abs(z - round(z / q) * q) <= greatest(0.02 * q, e) THEN 1.0 ELSE 0.0 END) AS share FROM g, q, ulp GROUP BY q)),
fall AS (SELECT avg(d) AS mean_drop, count(*) AS n_cells FROM (SELECT max(greatest(0.0, z - zn)) AS d FROM pair GROUP BY cell_id)),
none AS (SELECT max(CASE WHEN n > 0.005 * total AND hi > lo AND lo - value > 0.25 * (hi - lo) THEN value END) AS nodata FROM (SELECT value, sum(CASE WHEN z = value THEN 1 ELSE 0 END) AS n, count(*) AS total, min(CASE WHEN z <> value THEN z END) AS lo, max(CASE WHEN z <> value THEN z END) AS hi FROM g, (VALUES (CAST(0.0 AS DOUBLE)), (-9999.0), (-32768.0), (CAST(-3.4028235e38 AS DOUBLE))) v(value) GROUP BY value))
SELECT rn AS repeated_row_n, round(rs, 6) AS repeated_row_share, cn AS repeated_col_n, round(cs, 6) AS repeated_col_share, quantum, round(mean_drop, 6) AS mean_drop, n_cells, nodata, round(sloped / greatest(n, 1), 6) AS sloped_tied_share, round(tied / greatest(n, 1), 6) AS tied_share,
CASE WHEN greatest(rs, cs) >= 0.002 THEN 'repeated lines' WHEN coalesce(quantum, 0) <= 0.01 AND sloped / greatest(n, 1) >= 0.02 THEN 'tied cells' ELSE 'ok' END AS resampling, round(mean_drop / quantum, 6) AS precision_ratio, CASE WHEN mean_drop / quantum < 1 THEN 'warning' WHEN mean_drop / quantum < 10 THEN 'caution' ELSE 'ok' END AS precision FROM lines, ties, step, fall, none""")
def audit_grid(spark, sf_dir):
    return rounded(conditioning.audit(*dem(spark, sf_dir, "dem_part")))


@query()
def cond_autoclip(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    return conditioning.autoclip(cells, road(spark, info), info, 60.0, 120.0, k=3)[0]


@query()
def cond_burn(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    line = road(spark, info)
    marks = linear.stations(line, 400.0).filter("part = 1").select(F.concat(F.lit("B"), F.col("chainage_m").cast("int").cast("string")).alias("uid"), F.col("chainage_m").cast("long").alias("pos"), "x", "y", F.lit(90.0).alias("azimuth_deg"))
    return rounded(conditioning.burn(cells, marks, info, 60.0)[1])


@query()
def road_side_drain(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(coverage.drain_classes(coverage.side_drain(road(spark, info), cut(eroded(flow, info).select("id", "sti", "channel"), "erosion"), flow, info, 50.0, 120.0, 30.0, 15.0)).drop("class_breaks"))


@query()
def road_coverage(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    flow, _ = routed(spark, sf_dir)
    line = cut(road(spark, info), "road")
    filled = cut(fill.fill_depressions(cells, info), "filled")
    found = linear.candidates(flow, drainage.streams(flow, threshold_cells=20), line, info).select("road", F.col("chainage").alias("chainage_m"), F.col("area_km2").alias("acc_km2"), F.lit(1).alias("stream_order"))
    profile = cut(linear.profile(line, cells, info, 30.0, filled, flow, found), "profile")
    design = profile.filter("stream = 1").select(F.concat(F.lit("X"), F.col("chainage_m").cast("int").cast("string")).alias("uid"), "road", "chainage_m", "x", "y", F.col("acc_km2").alias("area_km2")).filter("cast(chainage_m as int) % 4 = 0")
    return rounded(coverage.run_coverage(line, cells, filled.select("r", "c", F.col("filled").alias("z")), flow, profile, cut(design, "design"), info, min_area_km2=0.02, sag_min_area_km2=0.005)["coverage"])


@query(f"WITH u AS ({GRID_SQL['soil_units']}), l AS (SELECT soil_unit AS profile, 20.0 * k AS top, 20.0 * k + 20.0 AS bottom, sand, silt, clay + k AS clay, oc_pct FROM u, (VALUES (0), (1), (2)) v(k)), w AS (SELECT profile, least(bottom, 30.0) - greatest(top, 0.0) AS w, sand, silt, clay, oc_pct FROM l), p AS (SELECT profile, sum(w * clay) / sum(w) AS clay, avg(sand) AS sand FROM w WHERE w > 0 GROUP BY profile) SELECT profile AS unit, round(CAST(sand AS DOUBLE), 6) AS sand, round(CAST(clay AS DOUBLE), 6) AS clay, CAST(1 AS BIGINT) AS n_components, CAST(100 AS DOUBLE) AS share_with_data FROM p")
def soil_components(spark, sf_dir):
    units = grid(spark, sf_dir, "soil_units")
    none = F.lit(None).cast("double")
    layers = units.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.col("soil_unit").alias("profile"), (F.col("k") * 20.0).alias("top"), (F.col("k") * 20.0 + 20.0).alias("bottom"), "sand", "silt", (F.col("clay") + F.col("k")).alias("clay"), "oc_pct", none.alias("bulk"), none.alias("cfrag"), F.lit("W").alias("drain"))
    parts = units.select(F.col("soil_unit").alias("unit"), F.col("soil_unit").alias("profile"), F.lit(100.0).alias("share"))
    return rounded(zonal.combine_components(parts, layers, 0, 30).select("unit", "sand", "clay", "n_components", "share_with_data"))
