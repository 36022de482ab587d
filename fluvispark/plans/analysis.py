"""Queries over road stations, zonal layers, identity and review tables; with their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..operators import drainage, fill, linear, review, stencil, uncertainty, zonal
from ..sources.grids import GRID_SQL, grid, info_of, table
from . import terrain
from .terrain import ACC, CLOSURE, D8, PAIRS, ctes, routed, rounded, top_outlets

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def road(spark, info):
    """The fixture's road: eastwards along the middle row, start chainage 1000, and a second part back."""
    y = -(info.rows // 2 + 0.5) * 30.0
    rows = [(1, 0, 75.0, y), (1, 1, 2925.0, y), (2, 0, 2925.0, y - 120.0), (2, 1, 75.0, y - 120.0)]
    return linear.alignment(spark.createDataFrame(rows, "part int, pos int, x double, y double"), start=1000.0)


ROAD = f"d AS (SELECT -(floor((max(r) + 1) / 2) + 0.5) * 30.0 AS y FROM ({GRID_SQL['dem_orders']}) q), seg AS (SELECT 0 AS seg_id, 1 AS part, CAST(75.0 AS DOUBLE) AS x0, y AS y0, CAST(2925.0 AS DOUBLE) AS x1, y AS y1, CAST(1000.0 AS DOUBLE) AS ch0 FROM d UNION ALL SELECT 1, 2, 2925.0, y - 120.0, 75.0, y - 120.0, 3850.0 FROM d)"


@query(f"""WITH {ROAD}, p AS ({GRID_SQL['outlets']}), j AS (SELECT fid, seg_id, ch0, y0, least(greatest(CASE WHEN part = 1 THEN p.x - 75.0 ELSE 2925.0 - p.x END, 0.0), 2850.0) AS s, CASE WHEN part = 1 THEN p.y - y0 ELSE y0 - p.y END AS side, p.x, p.y, part FROM p, seg),
k AS (SELECT *, (p_x - x) * (p_x - x) + (y0 - y) * (y0 - y) AS d2 FROM (SELECT *, CASE WHEN part = 1 THEN 75.0 + s ELSE 2925.0 - s END AS p_x FROM j))
SELECT fid, round(ch0 + s, 6) AS chainage, round(CASE WHEN side >= 0 THEN sqrt(d2) ELSE -sqrt(d2) END, 6) + 0.0 AS "offset", round(sqrt(d2), 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY fid ORDER BY d2, seg_id) = 1""")
def road_locate(spark, sf_dir):
    segments = road(spark, info_of(grid(spark, sf_dir, "dem_orders")))
    return rounded(linear.locate(grid(spark, sf_dir, "outlets"), segments).select("fid", "chainage", "offset", "distance"))


@query(f"WITH {ROAD}, s AS (SELECT 1000.0 + 50.0 * unnest(range(0, 115)) AS ch) SELECT CAST(ch AS DOUBLE) AS chainage_m, CAST(CASE WHEN ch < 3850 THEN 75.0 + ch - 1000 ELSE 2925.0 - (ch - 3850) END AS DOUBLE) AS x, y - CASE WHEN ch < 3850 THEN 0.0 ELSE 120.0 END AS y, CAST(CASE WHEN ch < 3850 THEN 1 ELSE 2 END AS INT) AS part FROM s, d")
def road_stations(spark, sf_dir):
    return rounded(linear.stations(road(spark, info_of(grid(spark, sf_dir, "dem_orders"))), 50.0).drop("road"))


PROFILE = f"""{ROAD}, g AS ({GRID_SQL['dem_orders']}), s AS (SELECT 1000.0 + 50.0 * unnest(range(0, 115)) AS ch), p AS (SELECT ch, CASE WHEN ch < 3850 THEN 1 ELSE 2 END AS part, CASE WHEN ch < 3850 THEN 75.0 + ch - 1000 ELSE 2925.0 - (ch - 3850) END AS x, y - CASE WHEN ch < 3850 THEN 0.0 ELSE 120.0 END AS y FROM s, d),
q AS (SELECT ch, part, x / 30.0 - 0.5 AS fc, -y / 30.0 - 0.5 AS fr FROM p), b AS (SELECT ch, part, fc - floor(fc) AS u, CAST(floor(fc) AS INT) AS c0, CAST(floor(fr) AS INT) AS r0, fr - floor(fr) AS v FROM q),
z AS (SELECT ch, part, sum(g.z * (CASE WHEN g.c = c0 THEN 1 - u ELSE u END) * (CASE WHEN g.r = r0 THEN 1 - v ELSE v END)) AS z FROM b JOIN g ON g.r IN (r0, r0 + 1) AND g.c IN (c0, c0 + 1) GROUP BY ch, part HAVING count(*) = 4)"""


@query(f"WITH {PROFILE}, w AS (SELECT ch, part, z, coalesce(lag(z) OVER o, z) AS z0, coalesce(lead(z) OVER o, z) AS z1, coalesce(lag(ch) OVER o, ch) AS c0, coalesce(lead(ch) OVER o, ch) AS c1 FROM z WINDOW o AS (PARTITION BY part ORDER BY ch)) SELECT CAST(ch AS DOUBLE) AS chainage_m, CAST(part AS INT) AS part, round(CAST(z AS DOUBLE), 6) AS z_dem_m, round(CAST(100 * (z1 - z0) / (c1 - c0) AS DOUBLE), 6) + 0.0 AS slope_long_pct FROM w")
def road_profile(spark, sf_dir):
    cells = grid(spark, sf_dir, "dem_orders")
    info = info_of(cells)
    return rounded(linear.profile(road(spark, info), cells, info, 50.0).select("chainage_m", "part", "z_dem_m", "slope_long_pct"))


@query(f"""WITH RECURSIVE {ROAD}, {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, lk AS (SELECT f.cell_id AS id, f.c * 30.0 + 15.0 AS ax, -(f.r * 30.0 + 15.0) AS ay, n.c * 30.0 + 15.0 AS bx, -(n.r * 30.0 + 15.0) AS b_y FROM flow f JOIN acc USING (cell_id) JOIN g n ON n.cell_id = f.parent WHERE acc.acc >= 20),
h AS (SELECT id, seg_id, (y0 - ay) / (b_y - ay) AS t, ax, ay, bx, b_y, x0, part, ch0, y0 FROM lk, seg WHERE b_y <> ay)
SELECT id, CAST(seg_id AS INT) AS seg_id, round(ax + t * (bx - ax), 6) AS x, round(y0, 6) AS y, round(ch0 + CASE WHEN part = 1 THEN ax + t * (bx - ax) - 75.0 ELSE 2925.0 - ax - t * (bx - ax) END, 6) AS chainage, round(degrees(acos(abs(bx - ax) / sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)))), 6) AS angle_deg FROM h WHERE t >= 0 AND t < 1 AND ax + t * (bx - ax) BETWEEN 75.0 AND 2925.0""")
def road_intersections(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    stream = drainage.streams(flow, threshold_cells=20).filter("parent is not null")
    pts = stream.select("id", "parent", info.x(F.col("c")).alias("ax"), info.y(F.col("r")).alias("ay"))
    ends = flow.select(F.col("id").alias("parent"), info.x(F.col("c")).alias("bx"), info.y(F.col("r")).alias("by"))
    return rounded(linear.intersections(pts.join(ends, "parent"), road(spark, info)).select("id", "seg_id", "x", "y", "chainage", "angle_deg"))


@query()
def road_candidates(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(linear.candidates(flow, drainage.streams(flow, threshold_cells=20), road(spark, info), info))


ST = f"st AS ({GRID_SQL['stations']})"


def profile_fixture(spark, sf_dir):
    return grid(spark, sf_dir, "stations").withColumn("part", F.lit(1))  # roads of 500 stations


@query(f"WITH {ST} SELECT road, chainage_m, round(avg(z_dem_m) OVER (PARTITION BY road ORDER BY chainage_m RANGE BETWEEN 50.0 PRECEDING AND 50.0 FOLLOWING), 6) AS smooth FROM st")
def road_smooth(spark, sf_dir):
    return rounded(linear.smooth(profile_fixture(spark, sf_dir), 100.0).select("road", "chainage_m", "smooth"))


@query(f"""WITH {ST}, s AS (SELECT road, chainage_m AS c, round(avg(z_dem_m) OVER (PARTITION BY road ORDER BY chainage_m RANGE BETWEEN 50.0 PRECEDING AND 50.0 FOLLOWING), 6) AS z FROM st), n AS (SELECT road, c, z, lag(z) OVER (PARTITION BY road ORDER BY c) AS b FROM s), u AS (SELECT road, c, z, b, lead(z) OVER (PARTITION BY road ORDER BY c) AS a FROM n WHERE b IS NULL OR b <> z),
m AS (SELECT road, c, z FROM u WHERE b > z AND a > z), e AS (SELECT m.road, m.c, m.z, max(CASE WHEN s.c < m.c AND s.z < m.z THEN s.c END) AS l, min(CASE WHEN s.c > m.c AND s.z < m.z THEN s.c END) AS r FROM m JOIN s USING (road) GROUP BY m.road, m.c, m.z),
p AS (SELECT e.road, e.c, e.z, max(CASE WHEN s.c < e.c AND (l IS NULL OR s.c > l) THEN s.z END) AS lz, max(CASE WHEN s.c > e.c AND (r IS NULL OR s.c < r) THEN s.z END) AS rz FROM e JOIN s USING (road) GROUP BY e.road, e.c, e.z)
SELECT road, c AS chainage_m, z, round(least(lz, rz) - z, 6) AS prominence_m FROM p WHERE least(lz, rz) - z >= 0.3""")
def road_sags(spark, sf_dir):
    smooth = linear.smooth(profile_fixture(spark, sf_dir), 100.0).withColumn("smooth", F.round("smooth", 6))
    return rounded(linear.sags(smooth).select("road", "chainage_m", "z", "prominence_m"))


@query(f"""WITH {ST}, s AS (SELECT *, abs(z_dem_m - 50) < 45 AS f, (chainage_m + coalesce(lag(chainage_m) OVER o, chainage_m)) / 2 AS lo, (chainage_m + coalesce(lead(chainage_m) OVER o, chainage_m)) / 2 AS hi FROM st WINDOW o AS (PARTITION BY road ORDER BY chainage_m)),
n AS (SELECT *, sum(CASE WHEN f AND NOT coalesce(pf, false) THEN 1 ELSE 0 END) OVER (PARTITION BY road ORDER BY chainage_m) AS run FROM (SELECT *, lag(f) OVER (PARTITION BY road ORDER BY chainage_m) AS pf FROM s)) SELECT road, CAST(run AS BIGINT) AS run, min(lo) AS start_m, max(hi) AS end_m, max(hi) - min(lo) AS length_m FROM n WHERE f GROUP BY road, run HAVING max(hi) - min(lo) >= 30""")
def road_flat_runs(spark, sf_dir):
    p = profile_fixture(spark, sf_dir).withColumn("slope", F.when(F.abs(F.col("z_dem_m") - 50) < 45, 0.0).otherwise(1.0)).withColumn("cross_fall", F.lit(0.0))
    return linear.flat_stretches(p, least_m=30.0).select("road", "run", "start_m", "end_m", "length_m")


@query(f"""WITH {ST}, s AS (SELECT road, chainage_m AS c, z_dem_m AS a, sum(CASE WHEN chainage_m - p <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY road ORDER BY chainage_m) AS run FROM (SELECT *, lag(chainage_m) OVER (PARTITION BY road ORDER BY chainage_m) AS p FROM st WHERE stream = 1)),
b AS (SELECT road, run, max(a) AS a, min(c) FILTER (WHERE a = m) AS c FROM (SELECT *, max(a) OVER (PARTITION BY road, run) AS m FROM s) GROUP BY road, run), x AS (SELECT 400.0 * unnest(range(0, 12)) AS ce)
SELECT road, CAST(run AS BIGINT) AS run, c AS chainage_m, a AS acc_km2, CAST(min(abs(ce - c)) AS DOUBLE) AS nearest_m, min(abs(ce - c)) <= 50 AS covered FROM b, x GROUP BY road, run, c, a""")
def road_missing(spark, sf_dir):
    stations = profile_fixture(spark, sf_dir).withColumn("acc_km2", F.col("z_dem_m"))
    existing = stations.select("road").distinct().select("road", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k")).select("road", (F.col("k") * 400.0).alias("chainage_m"))
    return linear.missing_crossings(stations, existing)


@query(f"""WITH {ST}, lo AS (SELECT road, min(z_dem_m) AS z FROM st GROUP BY road), ix AS (SELECT st.*, row_number() OVER (PARTITION BY road ORDER BY chainage_m) AS k FROM st),
b AS (SELECT ix.road, arg_min(k, (ix.z_dem_m, chainage_m)) AS k FROM ix GROUP BY ix.road), r(rise) AS (VALUES (CAST(0.5 AS DOUBLE)), (1.0), (2.0)),
w AS (SELECT ix.road, rise, lo.z AS bed, ix.k, b.k AS kb, chainage_m AS c, z_dem_m AS v, lo.z + rise AS lv FROM ix JOIN lo USING (road) JOIN b USING (road), r),
e AS (SELECT road, rise, bed, lv, kb, coalesce(max(k) FILTER (WHERE v > lv AND k < kb), 0) AS l, min(k) FILTER (WHERE v > lv AND k > kb) AS h, max(k) AS n FROM w GROUP BY ALL),
p AS (SELECT e.*, a.c AS la, a.v AS lav, a2.c AS lb, a2.v AS lbv, z.c AS ra, z.v AS rav, z2.c AS rb, z2.v AS rbv FROM e LEFT JOIN w a ON a.road = e.road AND a.rise = e.rise AND a.k = e.l LEFT JOIN w a2 ON a2.road = e.road AND a2.rise = e.rise AND a2.k = e.l + 1 LEFT JOIN w z ON z.road = e.road AND z.rise = e.rise AND z.k = coalesce(e.h, e.n + 1) - 1 LEFT JOIN w z2 ON z2.road = e.road AND z2.rise = e.rise AND z2.k = e.h)
SELECT road, rise AS rise_m, round(bed, 6) AS bed_m, round(CASE WHEN l = 0 THEN lb ELSE la + (lv - lav) / (lbv - lav) * (lb - la) END, 6) AS from_m, round(CASE WHEN h IS NULL THEN ra ELSE ra + (lv - rav) / (rbv - rav) * (rb - ra) END, 6) AS to_m, l = 0 AS open_left, h IS NULL AS open_right FROM p""")
def road_floodplain_widths(spark, sf_dir):
    p = profile_fixture(spark, sf_dir)
    low = p.groupBy("road").agg(F.min_by("chainage_m", F.struct("z_dem_m", "chainage_m")).alias("chainage_m")).withColumn("uid", F.col("road")).withColumn("area_km2", F.lit(12.0))
    return rounded(linear.floodplain(p, low, window_m=0.0).select("road", "rise_m", "bed_m", "from_m", "to_m", "open_left", "open_right"))


@query()
def road_corridor(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(linear.corridor(road(spark, info), flow, info, "z", 50.0, [30.0, 60.0, 90.0]))


# --- zonal blocks ---------------------------------------------------------------------------------

MEM = "member AS (SELECT cell_id AS id, CAST(floor(cell_id / 400) AS INT) AS outlet FROM attrs)"
ATTRS = f"attrs AS ({GRID_SQL['attrs']})"
CN = ", ".join(f"({k}, {i + 1}, {float(v)})" for k, row in H.CURVE_NUMBERS.items() for i, v in enumerate(row))


def attrs(spark, sf_dir):
    cells = grid(spark, sf_dir, "attrs").withColumnRenamed("cell_id", "id")
    return cells, cells.select("id", F.floor(F.col("id") / 400).cast("int").alias("outlet"))


def shares_sql(column: str = "lc_class") -> str:
    return ", ".join(f"round(100.0 * count(*) FILTER (WHERE {column} IN {codes if len(codes) > 1 else f'({codes[0]})'}) / count({column}), 6) AS lc_pct_{k}" for k, codes in H.COVER_GROUPS.items())


@query(f"WITH {ATTRS}, {MEM}, cn(lc, g, cn) AS (VALUES {CN}) SELECT outlet, round(avg(cn), 6) AS cn_ii, round(100.0 * count(cn) / count(*), 6) AS cn_coverage_pct, {shares_sql()} FROM member JOIN attrs ON cell_id = id LEFT JOIN cn ON lc = lc_class AND g = hsg GROUP BY outlet")
def zonal_curve_number(spark, sf_dir):
    cells, member = attrs(spark, sf_dir)
    return rounded(zonal.runoff_block(zonal.curve_number(cells, zonal.cn_table(spark)), member).drop("cn_export"))


@query(f"WITH {ATTRS}, {MEM}, cn(lc, g, cn) AS (VALUES {CN}) SELECT outlet, round(avg(a.cn), 6) AS cn_base, round(avg(b.cn), 6) AS cn_scenario, round(avg(b.cn) - avg(a.cn), 6) AS cn_change FROM member JOIN attrs ON cell_id = id LEFT JOIN cn a ON a.lc = lc_class AND a.g = hsg LEFT JOIN cn b ON b.lc = CASE WHEN lc_class IN (20, 30) THEN 50 ELSE lc_class END AND b.g = hsg GROUP BY outlet")
def zonal_scenario(spark, sf_dir):
    cells, member = attrs(spark, sf_dir)
    numbers = zonal.cn_table(spark)
    built = cells.withColumn("lc_class", F.when(F.col("lc_class").isin(20, 30), 50).otherwise(F.col("lc_class")))
    return rounded(zonal.scenario_block(zonal.runoff_block(zonal.curve_number(cells, numbers), member), zonal.runoff_block(zonal.curve_number(built, numbers), member)).select("outlet", "cn_base", "cn_scenario", "cn_change"))


@query(f"""WITH {ATTRS}, {MEM}, z AS (SELECT outlet, id % 25 AS zone, map_mm FROM member JOIN attrs ON cell_id = id), n AS (SELECT outlet, n_name AS name, count(*) AS n FROM z JOIN nation ON n_nationkey = zone GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY outlet ORDER BY n DESC, lower(name), name) AS k, sum(n) OVER (PARTITION BY outlet) AS t, count(*) OVER (PARTITION BY outlet) AS m FROM n),
a AS (SELECT outlet, avg(map_mm) AS map_mm, avg(CASE WHEN map_mm <= 850 THEN 0.0483 * pow(map_mm, 1.61) ELSE 587.8 - 1.219 * map_mm + 0.004105 * map_mm * map_mm END) AS r FROM z GROUP BY outlet)
SELECT outlet, name AS rain_zone, round(100.0 * n / t, 6) AS rain_zone_pct, m AS n_zones, round(map_mm, 6) AS map_mm, round(r, 6) AS r_factor FROM k JOIN a USING (outlet) WHERE k = 1""")
def zonal_rain_zone(spark, sf_dir):
    cells, member = attrs(spark, sf_dir)
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("zone"), F.col("n_name").alias("name"))
    return rounded(zonal.rain_block(cells.withColumn("zone", F.col("id") % 25), member, names).select("outlet", "rain_zone", "rain_zone_pct", "n_zones", "map_mm", "r_factor"))


UNITS = f"u AS ({GRID_SQL['soil_units']})"
KW = "(0.2 + 0.3 * exp(-0.0256 * sand * (1 - silt / 100))) * pow(silt / (clay + silt), 0.3) * (1 - 0.25 * oc_pct / (oc_pct + exp(3.72 - 2.95 * oc_pct))) * (1 - 0.7 * (1 - sand / 100) / (1 - sand / 100 + exp(-5.51 + 22.9 * (1 - sand / 100)))) * 0.1317"
# the triangle as a list of its classes' conditions on fractions of 100, in the order they are tried
TRIANGLE = (
    ("sand", "si + 1.5 * cl < 15"), ("loamy sand", "si + 1.5 * cl < 30"), ("sandy loam", "(cl >= 7 AND cl < 20 AND sa > 52 AND si + 2 * cl >= 30) OR (cl < 7 AND si < 50 AND si + 2 * cl >= 30)"), ("loam", "cl >= 7 AND cl < 27 AND si >= 28 AND si < 50 AND sa <= 52"),
    ("silt loam", "(si >= 50 AND cl >= 12 AND cl < 27) OR (si >= 50 AND si < 80 AND cl < 12)"), ("silt", "si >= 80 AND cl < 12"), ("sandy clay loam", "cl >= 20 AND cl < 35 AND si < 28 AND sa > 45"), ("clay loam", "cl >= 27 AND cl < 40 AND sa > 20 AND sa <= 45"),
    ("silty clay loam", "cl >= 27 AND cl < 40 AND sa <= 20"), ("sandy clay", "cl >= 35 AND sa > 45"), ("silty clay", "cl >= 40 AND si >= 40"), ("clay", "cl >= 40 AND sa <= 45 AND si < 40"),
)
TEX = "(SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in TRIANGLE) + " ELSE 'loam' END FROM (SELECT 100 * sand / (sand + silt + clay) AS sa, 100 * silt / (sand + silt + clay) AS si, 100 * clay / (sand + silt + clay) AS cl))"
HSG = "CASE WHEN texture IN ('sand', 'loamy sand') THEN 'A' WHEN texture IN ('sandy loam', 'loam', 'silt loam', 'silt') THEN 'B' WHEN texture = 'sandy clay loam' THEN 'C' ELSE 'D' END"


@query(f"WITH {UNITS} SELECT soil_unit, round({KW}, 6) AS k_williams, round(0.0034 + 0.0405 * exp(-0.5 * pow(((clay * ln(0.001) + silt * ln(0.026) + sand * ln(1.025)) / (sand + silt + clay) / ln(10) + 1.659) / 0.7101, 2)), 6) AS k_diameter FROM u")
def soil_k(spark, sf_dir):
    return rounded(zonal.soil_properties(grid(spark, sf_dir, "soil_units")).select("soil_unit", "k_williams", "k_diameter"))


@query(f"WITH {UNITS}, t AS (SELECT soil_unit, {TEX} AS texture FROM u) SELECT soil_unit, texture, {HSG} AS hsg FROM t")
def soil_texture_hsg(spark, sf_dir):
    return zonal.soil_properties(grid(spark, sf_dir, "soil_units")).select("soil_unit", "texture", "hsg")


@query(f"""WITH {ATTRS}, {MEM}, {UNITS}, p AS (SELECT *, {HSG} AS g FROM (SELECT *, {TEX} AS texture, {KW} AS k FROM u)), j AS (SELECT outlet, p.* FROM member JOIN attrs ON cell_id = id LEFT JOIN p USING (soil_unit)),
d AS (SELECT outlet, soil_unit FROM j GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY count(*) DESC, soil_unit) = 1)
SELECT outlet, round(100.0 * count(sand) / count(*), 6) AS soil_coverage_pct, round(avg(sand), 6) AS sand, round(avg(silt), 6) AS silt, round(avg(clay), 6) AS clay, round(avg(oc_pct), 6) AS oc_pct, round(avg(k), 6) AS k_williams, round(100.0 * count(*) FILTER (WHERE g = 'A') / count(g), 6) AS hsg_pct_a, round(100.0 * count(*) FILTER (WHERE g = 'B') / count(g), 6) AS hsg_pct_b, round(100.0 * count(*) FILTER (WHERE g = 'C') / count(g), 6) AS hsg_pct_c, round(100.0 * count(*) FILTER (WHERE g = 'D') / count(g), 6) AS hsg_pct_d, any_value(d.soil_unit) AS dominant_unit FROM j JOIN d USING (outlet) GROUP BY outlet""")
def zonal_soil(spark, sf_dir):
    cells, member = attrs(spark, sf_dir)
    return rounded(zonal.soil_block(cells, member, zonal.soil_properties(grid(spark, sf_dir, "soil_units"))).select("outlet", "soil_coverage_pct", "sand", "silt", "clay", "oc_pct", "k_williams", "hsg_pct_a", "hsg_pct_b", "hsg_pct_c", "hsg_pct_d", "dominant_unit"))


@query(f"""WITH {UNITS}, l AS (SELECT soil_unit AS unit, 20.0 * k AS top, 20.0 * k + 20.0 AS bottom, clay + k AS clay FROM u, (VALUES (0), (1), (2)) v(k)), o AS (SELECT unit, clay, least(bottom, 30.0) - greatest(top, 0.0) AS w FROM l) SELECT unit, round(CAST(sum(w * clay) / sum(w) AS DOUBLE), 6) AS clay FROM o WHERE w > 0 GROUP BY unit""")
def soil_unit_depth(spark, sf_dir):
    layers = grid(spark, sf_dir, "soil_units").select(F.col("soil_unit").alias("unit"), "clay", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("unit", (F.col("k") * 20.0).alias("top"), (F.col("k") * 20.0 + 20.0).alias("bottom"), (F.col("clay") + F.col("k")).alias("clay"))
    return rounded(zonal.depth_weighted(layers, 0, 30, "clay"))


ERO = f"""{PAIRS}, {D8}, {CLOSURE}, {ACC}, {terrain.HORN}, e0 AS (SELECT g.cell_id AS id, acc.acc, sqrt(dzdx * dzdx + dzdy * dzdy) AS slope, (acc.acc + 1) * 30.0 AS a FROM g JOIN acc USING (cell_id) JOIN horn USING (cell_id)),
e1 AS (SELECT *, greatest(slope, 0.001) AS s, acc >= 30 AS channel FROM e0), e2 AS (SELECT *, s / sqrt(1 + s * s) AS sn FROM e1), ero AS (SELECT *, a * s AS spi, ln(a * s) AS ln_spi, ln(a / s) AS twi, pow(a / 22.13, 0.4) * pow(sn / 0.0896, 1.3) AS ls, CASE WHEN NOT channel THEN pow(least(a, 100.0) / 22.13, 0.6) * pow(sn / 0.0896, 1.3) END AS sti FROM e2)"""


def erosion_cells(spark, sf_dir):
    flow, info = routed(spark, sf_dir, "dem_part")
    slope = stencil.horn(flow.select("r", "c", "z"), info).select("r", "c", "slope")
    cells = flow.select("id", "r", "c", "acc").join(slope, ["r", "c"]).withColumn("channel", F.col("acc") >= 30)
    return zonal.erosion_layers(cells, info.cw, info.ch), info


@query(f"WITH RECURSIVE {ctes('dem_part')}, {ERO} SELECT id, round(spi, 6) AS spi, round(twi, 6) AS twi, round(ls, 6) AS ls, round(sti, 6) AS sti FROM ero")
def erosion_indices(spark, sf_dir):
    return rounded(erosion_cells(spark, sf_dir)[0].select("id", "spi", "twi", "ls", "sti"))


@query(f"WITH RECURSIVE {ctes('dem_part')}, {ERO}, q AS (SELECT id, channel, 1 + (ln_spi >= 0)::INT + (ln_spi >= 5)::INT + (ln_spi >= 10)::INT AS k FROM ero), x AS (SELECT k, 'all' AS part, count(*) AS n FROM q GROUP BY k UNION ALL SELECT k, CASE WHEN channel THEN 'channel' ELSE 'hillslope' END, count(*) FROM q GROUP BY 1, 2) SELECT CAST(k AS INT) AS class, part, n AS n_cells, round(n * 0.0009, 6) AS area_km2, round(100.0 * n / (SELECT count(*) FROM q), 6) AS pct FROM x")
def erosion_extents(spark, sf_dir):
    cells, info = erosion_cells(spark, sf_dir)
    return rounded(zonal.class_extents(cells.withColumn("k", H.classify(F.col("ln_spi"), [0, 5, 10]).cast("int")), "k", info.cell_area_km2))


@query(f"WITH RECURSIVE {ctes('dem_part')}, {ERO} SELECT round(quantile_cont(ls, 0.5), 6) AS break_1, round(quantile_cont(ls, 0.75), 6) AS break_2, round(quantile_cont(ls, 0.9), 6) AS break_3, round(quantile_cont(ls, 0.97), 6) AS break_4 FROM ero")
def erosion_percentile_breaks(spark, sf_dir):
    return rounded(zonal.percentile_breaks(erosion_cells(spark, sf_dir)[0], "ls"))


def cover_case(values: dict, default: str = "NULL") -> str:
    return "CASE lc_class " + " ".join(f"WHEN {k} THEN CAST({v} AS DOUBLE)" for k, v in values.items()) + f" ELSE {default} END"


@query(f"""WITH RECURSIVE {ctes('dem_part')}, {ATTRS}, {MEM}, {UNITS}, {ERO}, f AS (SELECT outlet, ero.ls, ero.ln_spi, ero.channel, (CASE WHEN map_mm <= 850 THEN 0.0483 * pow(map_mm, 1.61) ELSE 587.8 - 1.219 * map_mm + 0.004105 * map_mm * map_mm END) * ({KW}) * ls * ({cover_case(H.COVER_C)}) * ({cover_case(H.SUPPORT_P, '1.0')}) AS a FROM ero JOIN member USING (id) JOIN attrs ON cell_id = id JOIN u USING (soil_unit)),
b AS (SELECT outlet, avg(a) AS a_mean, quantile_cont(a, 0.9) AS a_p90, avg(ls) AS ls_mean, quantile_cont(ls, 0.9) AS ls_p90, quantile_cont(CASE WHEN channel THEN ln_spi END, 0.9) AS spi90, count(*) * 0.0009 AS km2 FROM f GROUP BY outlet)
SELECT outlet, round(a_mean, 6) AS a_mean, round(a_p90, 6) AS a_p90, round(ls_mean, 6) AS ls_mean, round(ls_p90, 6) AS ls_p90, round(spi90, 6) AS ln_spi_p90, round(a_mean * km2 * 100 * least(1.0, 0.565 * pow(km2, -0.125)) * 1000 / 1400, 4) AS yield_m3 FROM b""")
def erosion_catchment(spark, sf_dir):
    cells, info = erosion_cells(spark, sf_dir)
    layers, member = attrs(spark, sf_dir)
    units = zonal.soil_properties(grid(spark, sf_dir, "soil_units")).select("soil_unit", F.col("k_williams").alias("k_factor"))
    full = cells.join(layers, "id").join(units, "soil_unit").withColumn("r_factor", H.rainfall_erosivity(F.col("map_mm"))).withColumn("c_factor", H.lookup(F.col("lc_class"), H.COVER_C)).withColumn("p_factor", H.lookup(F.col("lc_class"), H.SUPPORT_P, 1.0))
    got = zonal.erosion_block(zonal.soil_loss(full), member, info.cell_area_km2)
    return rounded(got.select("outlet", "a_mean", "a_p90", "ls_mean", "ls_p90", "ln_spi_p90", F.round("yield_m3", 4).alias("yield_m3")))


@query(f"WITH {ATTRS}, x AS (SELECT {cover_case(H.COVER_C)} AS f FROM attrs) SELECT min(f) AS least, max(f) AS most, round(quantile_cont(f, 0.5), 6) AS median, round(quantile_cont(f, 0.995), 6) AS p995, count(f) AS n, round(avg(CASE WHEN f IN (10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100) THEN 1.0 ELSE 0.0 END), 6) AS code_share, min(f) < 0 OR quantile_cont(f, 0.995) > 1 AS implausible FROM x")
def erosion_factor_check(spark, sf_dir):
    cells, _ = attrs(spark, sf_dir)
    return rounded(zonal.check_factor(cells.withColumn("c_factor", H.lookup(F.col("lc_class"), H.COVER_C)), "c_factor", 0, 1))


TC_IN = "SELECT s_suppkey AS outlet, CAST(500 + 25 * (s_suppkey % 100) AS DOUBLE) AS lfp_length_m, 0.01 + 0.0005 * (s_suppkey % 200) AS lfp_slope_1085, CAST(50 + s_suppkey % 400 AS DOUBLE) AS lfp_overland_m, 0.02 + 0.0002 * (s_suppkey % 100) AS lfp_overland_slope, CAST(100 + s_suppkey % 300 AS DOUBLE) AS lfp_channel_m, 0.03 + 0.0001 * (s_suppkey % 100) AS lfp_channel_slope, 0.05 + 0.01 * (s_suppkey % 900) AS area_km2, 0.05 + 0.001 * (s_suppkey % 100) AS catch_slope_horn, CAST(45 + s_suppkey % 60 AS DOUBLE) AS cn_ii, CAST(0.4 AS DOUBLE) AS kerby_n, CAST(0.24 AS DOUBLE) AS sheet_n, CAST(80.0 AS DOUBLE) AS p2_mm, CAST(3.0 AS DOUBLE) AS xs_area_m2, CAST(6.0 AS DOUBLE) AS xs_perimeter_m FROM supplier"
FT3 = "3.280839895013123"


@query(f"""WITH t AS (SELECT outlet, lfp_length_m AS l, CAST(lfp_slope_1085 AS DOUBLE) AS s, lfp_overland_m AS lo, CAST(lfp_overland_slope AS DOUBLE) AS so, lfp_channel_m AS lc, CAST(lfp_channel_slope AS DOUBLE) AS sc, CAST(area_km2 AS DOUBLE) AS a, CAST(catch_slope_horn AS DOUBLE) AS y, cn_ii AS cn FROM ({TC_IN}))
SELECT outlet, round(0.0195 * pow(l, 0.77) * pow(s, -0.385), 4) AS tc_kirpich, round(1.44 * pow(lo * 0.4, 0.467) * pow(so, -0.235) + 0.0195 * pow(lc, 0.77) * pow(sc, -0.385), 4) AS tc_kerby_kirpich, round(100 * pow(l * {FT3}, 0.8) * pow(1000 / cn - 9, 0.7) / (1900 * sqrt(y * 100)), 4) AS tc_scs_lag, round(14.6 * l / 1000 / (pow(a, 0.1) * pow(s * 1000, 0.2)), 4) AS tc_bransby,
round(60 * 0.007 * pow(0.24 * least(lo, 30.0) * {FT3}, 0.8) / (sqrt(80.0 / 25.4) * pow(so, 0.4)) + greatest(lo - 30, 0) * {FT3} / (16.1345 * sqrt(so)) / 60 + lc / (pow(0.5, 2.0 / 3) * sqrt(sc) / 0.035) / 60, 4) AS tc_tr55,
CASE WHEN a BETWEEN 0.004 AND 0.45 AND s BETWEEN 0.03 AND 0.1 THEN 'within' ELSE 'outside: ' || concat_ws('; ', CASE WHEN a NOT BETWEEN 0.004 AND 0.45 THEN 'area' END, CASE WHEN s NOT BETWEEN 0.03 AND 0.1 THEN 'slope' END) END AS kirpich_flag, CASE WHEN lo > 365 THEN 'outside: overland length' ELSE 'within' END AS kerby_kirpich_flag,
CASE WHEN a <= 8 AND cn BETWEEN 50 AND 95 THEN 'within' ELSE 'outside: ' || concat_ws('; ', CASE WHEN a > 8 THEN 'area' END, CASE WHEN cn NOT BETWEEN 50 AND 95 THEN 'curve number' END) END AS scs_lag_flag FROM t""")
def tc_methods(spark, sf_dir):
    rows = spark.sql(TC_IN.replace("FROM supplier", "FROM {src}"), src=table(spark, sf_dir, "supplier"))
    rows = rows.select("outlet", *[F.col(c).cast("double") for c in rows.columns[1:]])
    got = zonal.tc_block(rows)
    return got.select("outlet", *[F.round(c, 4).alias(c) for c in ("tc_kirpich", "tc_kerby_kirpich", "tc_scs_lag", "tc_bransby", "tc_tr55")], "kirpich_flag", "kerby_kirpich_flag", "scs_lag_flag")


@query(f"""WITH s AS (SELECT CAST(floor(p_partkey / 40) AS INT) AS outlet, CAST(p_partkey % 40 AS DOUBLE) AS dist, CAST(p_size AS DOUBLE) / 4 AS z FROM part), w AS (SELECT *, sum(CASE WHEN z <= 5 THEN 0 ELSE 1 END) OVER o AS run, lead(dist) OVER o - dist AS dx, lead(z) OVER o AS z2, 5.0 - z AS h1, 5.0 - lead(z) OVER o AS h2 FROM s WINDOW o AS (PARTITION BY outlet ORDER BY dist)),
b AS (SELECT outlet, arg_min(run, (z, dist)) AS run, min(z) AS bed FROM w GROUP BY outlet), v AS (SELECT w.*, CASE WHEN h1 > 0 AND h2 > 0 THEN 1.0 WHEN h1 > 0 THEN h1 / (h1 - h2) WHEN h2 > 0 THEN h2 / (h2 - h1) ELSE 0.0 END AS f, CASE WHEN h1 > 0 AND h2 > 0 THEN (h1 + h2) / 2 ELSE greatest(h1, h2, 0.0) / 2 END AS d FROM w JOIN b ON b.outlet = w.outlet AND b.run = w.run AND bed <= 5 WHERE dx IS NOT NULL)
SELECT outlet, round(sum(f * dx * d), 6) AS area_m2, round(sum(sqrt(f * dx * f * dx + f * (z2 - z) * f * (z2 - z))), 6) AS perimeter_m, round(sum(f * dx), 6) AS top_m FROM v GROUP BY outlet""")
def section_hydraulics(spark, sf_dir):
    s = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 40).cast("int").alias("outlet"), (F.col("p_partkey") % 40).cast("double").alias("dist"), (F.col("p_size").cast("double") / 4).alias("z"))
    return rounded(zonal.section_hydraulics(s, F.lit(5.0)))


@query("SELECT s_suppkey AS outlet, round(km2 / (l * l), 6) AS form_factor, round(2 * sqrt(km2 / 3.141592653589793) / l, 6) AS elongation, round(4 * 3.141592653589793 * km2 / (p * p), 6) AS circularity FROM (SELECT s_suppkey, CAST(1 + s_suppkey % 7 AS DOUBLE) AS km2, CAST(2 + s_suppkey % 5 AS DOUBLE) AS l, CAST(8 + s_suppkey % 9 AS DOUBLE) AS p FROM supplier)")
def shape_indices(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("outlet"), (1 + F.col("s_suppkey") % 7).cast("double").alias("a"), ((2 + F.col("s_suppkey") % 5) * 1000.0).alias("l"), ((8 + F.col("s_suppkey") % 9) * 1000.0).alias("p"))
    return rounded(s.select("outlet", H.form_factor(F.col("a"), F.col("l")).alias("form_factor"), H.elongation(F.col("a"), F.col("l")).alias("elongation"), H.circularity(F.col("a"), F.col("p")).alias("circularity")))


# --- identity and review -----------------------------------------------------------------------------


@query("SELECT s_suppkey AS fid, 'X' || lpad(CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INT), '0') AS outlet_uid FROM supplier")
def ids_sequential(spark, sf_dir):
    return review.sequential_ids(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"), "s_acctbal"), [F.desc("s_acctbal"), "fid"]).select("fid", "outlet_uid")


@query("SELECT v AS value, count(*) AS n, CASE WHEN v = '' THEN 'empty' ELSE 'duplicate' END AS problem FROM (SELECT CASE WHEN p_partkey % 97 = 0 THEN '' ELSE p_brand END AS v FROM part) GROUP BY v HAVING v = '' OR count(*) > 1")
def ids_duplicates(spark, sf_dir):
    return review.id_problems(table(spark, sf_dir, "part").withColumn("v", F.when(F.col("p_partkey") % 97 == 0, F.lit(None)).otherwise(F.col("p_brand"))), "v")


LINKS = "c AS (SELECT s_suppkey AS u FROM supplier WHERE s_suppkey % 5 <> 0), a AS (SELECT s_suppkey AS u FROM supplier WHERE s_suppkey % 7 <> 0)"


@query(f"WITH {LINKS} SELECT 'catchments' AS layer, u AS outlet_uid, 'error' AS severity FROM a WHERE u NOT IN (SELECT u FROM c) UNION ALL SELECT 'catchments', u, 'warning' FROM c WHERE u NOT IN (SELECT u FROM a)")
def pkg_links(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("outlet_uid"))
    return review.link_problems(s.filter("outlet_uid % 5 <> 0"), {"catchments": s.filter("outlet_uid % 7 <> 0")})


@query("WITH b AS (SELECT s_suppkey AS s, 'X' || s_suppkey AS u FROM supplier WHERE s_suppkey % 4 <> 0), a AS (SELECT s_suppkey AS s, 'X' || (s_suppkey - s_suppkey % 3) AS u FROM supplier WHERE s_suppkey % 5 <> 0) SELECT coalesce(b.s, a.s) AS source_id, b.u AS old_uid, a.u AS new_uid, CASE WHEN b.u IS NULL THEN 'added' WHEN a.u IS NULL THEN 'deleted' WHEN a.u = b.u THEN 'kept' ELSE 'renumbered' END AS action FROM b FULL JOIN a ON a.s = b.s")
def pkg_renumber(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"))
    uid = lambda x: F.concat(F.lit("X"), x.cast("string"))
    return review.renumber_log(s.filter("source_id % 4 <> 0").withColumn("outlet_uid", uid(F.col("source_id"))), s.filter("source_id % 5 <> 0").withColumn("outlet_uid", uid(F.col("source_id") - F.col("source_id") % 3)))


@query("""WITH r AS (SELECT 'X' || s_suppkey AS u, CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(s_suppkey * 10 AS DOUBLE) END AS ch, s_acctbal AS b, s_nationkey AS n FROM supplier), f AS (SELECT u, ch, 3 AS severity, 'balance below zero' AS finding FROM r WHERE b < 0 UNION ALL SELECT u, ch, 1, 'first nations' FROM r WHERE n < 3)
SELECT u AS outlet_uid, ch AS chainage_m, severity, finding, 'F' || lpad(CAST(row_number() OVER (ORDER BY severity DESC, ch NULLS LAST, u, finding) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INT), '0') AS finding_id FROM f""")
def pkg_register(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    rows = s.select(F.concat(F.lit("X"), F.col("s_suppkey").cast("string")).alias("outlet_uid"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_suppkey") * 10.0).alias("chainage_m"), "s_acctbal", "s_nationkey")
    return review.register(rows, [(F.col("s_acctbal") < 0, 3, "balance below zero"), (F.col("s_nationkey") < 3, 1, "first nations")])


@query(terrain.fill_sql("SELECT component, n_cells").replace(" SELECT component, n_cells", f""", {terrain.WET}, d AS (SELECT component, count(*) AS n_cells, max(depth) AS deep, sum(depth) AS s FROM wc JOIN w USING (id) GROUP BY component),
a AS (SELECT component, w.r, w.c, row_number() OVER (PARTITION BY component ORDER BY depth DESC, w.r, w.c) AS k FROM wc JOIN w USING (id))
SELECT component, n_cells, round(CAST(n_cells * 900.0 AS DOUBLE), 6) AS area_m2, round(deep, 6) AS max_depth_m, round(s / n_cells, 6) AS mean_depth_m, round(s * 900.0, 6) AS volume_m3, r AS deepest_r, c AS deepest_c FROM d JOIN a USING (component) WHERE k = 1 AND deep >= 0.5 ORDER BY deep DESC, component LIMIT 50"""))
def review_depressions(spark, sf_dir):
    cells, info = terrain.dem(spark, sf_dir, "dem_part")
    labels = fill.depression_labels(fill.fill_depth(fill.fill_depressions(cells, info)), info)
    return rounded(review.depressions(labels, info.cw * info.ch, most=50))


@query(f"WITH {ctes('dem_part')}, n AS (SELECT count(*) FILTER (WHERE z < 225 AND abs(c - 20) <= 5) AS tp, count(*) FILTER (WHERE z < 225) AS s, count(*) FILTER (WHERE abs(c - 20) <= 5) AS m FROM g), q AS (SELECT tp / s AS p, tp / m AS r FROM n) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 6) AS f1 FROM q")
def map_agreement(spark, sf_dir):
    cells, _ = terrain.dem(spark, sf_dir, "dem_part")
    w = cells.withColumn("w", F.lit(30.0))
    return rounded(review.agreement(w.filter("z < 225").select("r", "c", "w"), w.filter("abs(c - 20) <= 5").select("r", "c", "w")))


@query("SELECT CAST(l_suppkey % 10 AS INT) AS outlet, count(*) AS n, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(stddev_pop(v) / avg(v), 6) AS cv, round(100.0 * count(*) FILTER (WHERE v IS NULL) / count(*), 6) AS lost_pct FROM (SELECT l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS v FROM lineitem) GROUP BY 1")
def unc_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("outlet"), F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("double")).alias("value"))
    return rounded(review.realisation_summary(rows))


@query()
def unc_realisations(spark, sf_dir):
    """Mean elevation and relief of 20 perturbed surfaces and the base run."""
    cells, info = terrain.dem(spark, sf_dir, "dem_part")
    every = uncertainty.realisations(cells, 20, uncertainty.PRESETS["FABDEM"], 90.0, info.cw)
    return rounded(every.groupBy("realisation").agg(F.avg("z").alias("mean_z"), (F.max("z") - F.min("z")).alias("relief")))


@query("WITH v AS (SELECT p_partkey % 50 AS outlet, CASE p_size % 4 WHEN 0 THEN 'base' ELSE 'v' || (p_size % 4) END AS variant, avg(p_retailprice) AS value FROM part GROUP BY 1, 2), b AS (SELECT outlet, value AS base FROM v WHERE variant = 'base'), d AS (SELECT outlet, variant, 100 * (value - base) / base AS ch FROM v JOIN b USING (outlet) WHERE variant <> 'base') SELECT CAST(outlet AS BIGINT) AS outlet, variant AS worst_variant, round(ch, 6) AS worst_change_pct FROM d QUALIFY row_number() OVER (PARTITION BY outlet ORDER BY abs(ch) DESC, variant DESC) = 1")
def sens_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).cast("long").alias("outlet"), F.when(F.col("p_size") % 4 == 0, "base").otherwise(F.concat(F.lit("v"), (F.col("p_size") % 4).cast("string"))).alias("variant"), "p_retailprice")
    return rounded(review.variant_summary(p.groupBy("outlet", "variant").agg(F.avg("p_retailprice").alias("value"))))


@query("SELECT event_id, CAST(CASE WHEN lat > 84 THEN 32661 WHEN lat < -80 THEN 32761 ELSE (CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END) + CASE WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE least(floor((lon + 180) / 6) + 1, 60) END END AS INT) AS epsg FROM (SELECT event_id, CAST(event_id * 37 % 361 - 180 AS DOUBLE) AS lon, CAST(event_id * 53 % 179 - 89 AS DOUBLE) AS lat FROM events)")
def utm_zones(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 37 % 361 - 180).cast("double").alias("lon"), (F.col("event_id") * 53 % 179 - 89).cast("double").alias("lat"))
    return e.select("event_id", H.utm_epsg(F.col("lon"), F.col("lat")).alias("epsg"))
