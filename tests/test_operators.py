"""Operators on fixtures with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import window_router
from fluvispark.functions import hydrology as H
from fluvispark.operators import channel, conditioning, coverage, drainage, fill, geometry, graph, linear, package, review, stencil, uncertainty, zonal
from fluvispark.operators.stencil import OFFSETS
from fluvispark.sources.grids import GridInfo


def cells(spark, z):
    return spark.createDataFrame([(i * z.shape[1] + j, i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])], "id long, r int, c int, z double")


def route(spark, z, info, conditioned=True):
    own = cells(spark, z)
    surface = fill.fill_depressions(own, info).select("r", "c", F.col("filled").alias("z")) if conditioned else own.select("r", "c", "z")
    flow = stencil.d8(surface, info).join(surface, ["r", "c"])
    flow = graph.flow_accumulation(fill.resolve_flats(flow, info) if conditioned else flow, info)
    return own, flow


def road(spark, vertices, start=0.0):
    return linear.alignment(spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(vertices)], "part int, pos int, x double, y double"), start)


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in inputs.items()))
    return row.select(column.alias("v")).first().v


# --- soils: literal cases -------------------------------------------------------------------------

TEXTURES = [  # sand, silt, clay and the class of the triangle
    (92, 5, 3, "sand"), (82, 12, 6, "loamy sand"), (75, 22, 5, "loamy sand"), (65, 25, 10, "sandy loam"), (40, 40, 20, "loam"), (20, 65, 15, "silt loam"), (5, 88, 7, "silt"), (60, 13, 27, "sandy clay loam"),
    (32, 34, 34, "clay loam"), (10, 56, 34, "silty clay loam"), (52, 6, 42, "sandy clay"), (6, 47, 47, "silty clay"), (20, 20, 60, "clay"), (4, 2, 2, "sandy clay loam"),
]


@pytest.mark.parametrize(("sand", "silt", "clay", "name"), TEXTURES)
def test_textures(spark, sand, silt, clay, name):
    c = [F.col(x) for x in ("sand", "silt", "clay")]
    assert value(spark, H.usda_texture(*c), sand=float(sand), silt=float(silt), clay=float(clay)) == name


def test_soils_without_data(spark):
    c = [F.col(x) for x in ("sand", "silt", "clay")]
    rows = spark.createDataFrame([(None, 10.0, 10.0, 1.0), (-1.0, 50.0, 51.0, 1.0), (0.0, 0.0, 0.0, 1.0)], "sand double, silt double, clay double, oc double")
    for r in rows.select(H.usda_texture(*c).alias("t"), H.hsg_of_texture(H.usda_texture(*c)).alias("g"), H.diameter_k(*c).alias("k"), H.williams_k(*c, F.col("oc")).alias("w")).collect():
        assert (r.t, r.g, r.k, r.w) == (None, None, None, None)


def test_soil_groups(spark):
    cases = [("sand", None, "A"), ("loam", "W", "B"), ("loam", "i", "C"), ("sand", "P", "D"), ("clay", "I", "D"), ("sandy clay loam", "I", "C"), ("sand", "V", "D")]
    rows = spark.createDataFrame([c[:2] for c in cases], "t string, d string").select(H.hsg_of_texture(F.col("t"), F.col("d")).alias("g")).collect()
    assert [r.g for r in rows] == [c[2] for c in cases]
    codes = spark.createDataFrame([(1.0,), (4.0,), (13.0,), (9.0,), (None,)], "c double").select(H.hsg_of_codes(F.col("c")).alias("g")).collect()
    assert [r.g for r in codes] == [1, 4, 14, 0, 0]
    letters = spark.createDataFrame([(" b ",), ("B/D",), ("x",), (None,)], "c string").select(H.hsg_of_letters(F.col("c")).alias("g")).collect()
    assert [r.g for r in letters] == [2, 14, 0, 0]


def test_diameter_erodibility_does_not_depend_on_the_sum(spark):
    c = [F.col(x) for x in ("sand", "silt", "clay")]
    a, b = (value(spark, H.diameter_k(*c), sand=40 * f, silt=40 * f, clay=20 * f) for f in (1.0, 0.5))
    dg = math.exp(0.01 * (20 * math.log(0.001) + 40 * math.log(0.026) + 40 * math.log(1.025)))
    assert abs(a - b) < 1e-12 and abs(a - (0.0034 + 0.0405 * math.exp(-0.5 * ((math.log10(dg) + 1.659) / 0.7101) ** 2))) < 1e-12


def test_published_numbers(spark):
    assert abs(value(spark, H.rainfall_erosivity(F.col("p")), p=1000.0) - 3473.8) < 1e-6
    assert abs(value(spark, H.rainfall_erosivity(F.col("p"), linear=True), p=1000.0) - 3518.46) < 1e-6
    assert value(spark, H.combine_scores(F.col("a"), F.col("b")), a=2.0, b=5.0) == 5 and value(spark, H.combine_scores(F.col("a"), F.col("b")), a=0.0, b=5.0) == 0
    assert abs(value(spark, H.composite(F.col("a"), F.col("b"), F.col("c")), a=5.0, b=3.0, c=1.0) - 3.2) < 1e-12
    assert value(spark, H.composite(F.col("a"), F.col("b"), F.lit(None).cast("double")), a=5.0, b=3.0) is None
    assert abs(value(spark, H.amc(F.col("c"), "III"), c=75.0) - 23 * 75 / (10 + 0.13 * 75)) < 1e-12
    x, y = H.utm_xy(F.col("lon"), F.col("lat"))
    assert abs(value(spark, x, lon=3.0, lat=0.0) - 500000) < 1e-3 and abs(value(spark, y, lon=3.0, lat=0.0)) < 1e-3
    assert abs(value(spark, y, lon=3.0, lat=45.0) - 0.9996 * 4984944.378) < 0.01


def test_coordinate_systems():
    metre = 'PROJCS["x",GEOGCS["g",UNIT["degree",0.0174]],UNIT["metre",1],AUTHORITY["EPSG","32737"]]'
    assert H.crs_problem(metre) == (32737, "")
    assert H.crs_problem('GEOGCS["g",UNIT["degree",0.0174]]')[1] and H.crs_problem("")[1] and H.crs_problem(metre.replace('UNIT["metre",1]', 'UNIT["foot",0.3]'))[1]


def test_depth_and_components(spark):
    layers = spark.createDataFrame([("p", 0.0, 5.0, 30.0, 30.0, 40.0, 1.0, None, None, "W"), ("p", 5.0, 15.0, 40.0, 30.0, 30.0, 1.0, None, None, "I"), ("p", 15.0, 30.0, 60.0, 20.0, 20.0, 1.0, None, None, None), ("q", 0.0, 20.0, 10.0, 80.0, 10.0, 2.0, None, None, "P")], "profile string, top double, bottom double, sand double, silt double, clay double, oc_pct double, bulk double, cfrag double, drain string")
    parts = spark.createDataFrame([("u", "p", 60.0), ("u", "q", 30.0), ("u", "missing", 10.0)], "unit string, profile string, share double")
    got = zonal.combine_components(parts, layers).first()
    p = (30 * 5 + 40 * 10 + 60 * 5) / 20
    assert abs(got.sand - (60 * p + 30 * 10) / 90) < 1e-9 and abs(got.share_with_data - 90) < 1e-9 and got.dominant_profile == "p" and got.drain == "W" and got.n_components == 3


# --- roads ------------------------------------------------------------------------------------------


def test_locate_against_all_pairs(spark):
    r = random.Random(3)
    way = [(0.0, 0.0)]
    for _ in range(25):
        way.append((way[-1][0] + r.uniform(-50, 300), way[-1][1] + r.uniform(-200, 200)))
    seg = road(spark, way)
    points = [(k, r.uniform(-3000, 6000), r.uniform(-3000, 3000)) for k in range(150)] + [(999, 90000.0, 5.0)]
    got = {x.fid: x for x in linear.locate(spark.createDataFrame(points, "fid long, x double, y double"), seg, radius=40.0).collect()}
    rows = seg.orderBy("seg_id").collect()
    for k, x, y in points:
        best = None
        for s in rows:
            dx, dy = s.x1 - s.x0, s.y1 - s.y0
            t = min(1, max(0, ((x - s.x0) * dx + (y - s.y0) * dy) / (dx * dx + dy * dy)))
            d = math.hypot(x - s.x0 - t * dx, y - s.y0 - t * dy)
            if best is None or d < best[0] - 1e-12:
                best = (d, s.ch0 + t * s.seg_len)
        assert abs(got[k].distance - best[0]) < 1e-6 and abs(got[k].chainage - best[1]) < 1e-4, k


def test_profile_of_a_plane(spark):
    z = np.array([[100 + 0.02 * (55 + 10 * j - 50) + 0.005 * (495 - 10 * i) for j in range(80)] for i in range(50)])
    info = GridInfo(50, 80, 0.0, 500.0, 10.0, 10.0)
    got = linear.profile(road(spark, [(55, 250), (705, 250)], 1000.0), cells(spark, z), info, 10.0).orderBy("chainage_m").collect()
    assert len(got) == 66 and got[0].chainage_m == 1000 and got[-1].chainage_m == 1650
    assert all(abs(x.slope_long_pct - 2) < 1e-9 for x in got)


def test_sags_of_gaussians(spark):
    ch = np.arange(0, 1001, 10.0)
    z = 50 - sum(d * np.exp(-(((ch - at) / 40) ** 2)) for at, d in ((300, 1.0), (700, 0.5), (900, 0.1)))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(ch, z)], "chainage_m double, z_dem_m double").withColumn("smooth", F.col("z_dem_m"))
    got = linear.sags(linear.by_road(rows)).orderBy("chainage_m").collect()
    assert [(x.chainage_m, x.low_m) for x in got] == [(300, 300), (700, 700)] and abs(got[0].prominence_m - 1) < 1e-3 and abs(got[1].prominence_m - 0.5) < 0.05


def test_prominence_against_scans():
    r = np.random.default_rng(1)
    for _ in range(30):
        z = r.integers(0, 6, 40).astype(float)
        want = []
        for i in range(1, 39):
            if z[i] < z[i - 1]:
                j = i
                while j + 1 < 40 and z[j + 1] == z[i]:
                    j += 1
                if j + 1 < 40 and z[j + 1] > z[i]:
                    a, b = i - 1, j + 1
                    left, right = [], []
                    while a >= 0 and z[a] >= z[i]:
                        left.append(z[a])
                        a -= 1
                    while b < 40 and z[b] >= z[i]:
                        right.append(z[b])
                        b += 1
                    want.append((i, j, min(max(left), max(right)) - z[i]))
        assert linear._prominences(z) == want


def test_widths_of_a_trapezoid(spark):
    ch = np.arange(0, 1001, 10.0)
    z = np.maximum(0, np.maximum((480 - ch) / 20, (ch - 520) / 20))
    rows = linear.by_road(spark.createDataFrame([(float(a), float(b)) for a, b in zip(ch, z)], "chainage_m double, z_dem_m double"))
    marks = spark.createDataFrame([("a", 500.0, 12.0), ("b", 500.0, 3.0)], "uid string, chainage_m double, area_km2 double")
    got = {(x.uid, x.rise_m): round(x.width_m, 9) for x in linear.floodplain(rows, marks).collect()}
    assert got == {("a", 0.5): 60.0, ("a", 1.0): 80.0, ("a", 2.0): 120.0}


def test_nearest_along(spark):
    rows = spark.createDataFrame([(0, float(c)) for c in (0, 10, 25, 99)] + [(1, 5.0)], "road int, chainage_m double")
    marks = spark.createDataFrame([(0, 0.0), (0, 20.0), (0, 30.0)], "road int, chainage_m double")
    got = {(x.road, x.chainage_m): (x.near_m, x.nearest_m) for x in linear.nearest_along(rows, marks).collect()}
    assert got == {(0, 0.0): (0, 0), (0, 10.0): (0, 10), (0, 25.0): (20, 5), (0, 99.0): (30, 69), (1, 5.0): (None, None)}


def test_candidates_of_valleys_and_a_weaving_stream(spark):
    info = GridInfo(100, 90, 0.0, 1000.0, 10.0, 10.0)
    i, j = np.mgrid[0:100, 0:90]
    centre = 45 + 1.2 * np.sin(i / 4.0)
    z = 200 - 0.5 * i + 2.0 * np.abs(j - np.round(centre))
    own, flow = route(spark, z, info)
    flow = flow.join(own.select("id", "z"), "id")
    across = linear.candidates(flow, drainage.streams(flow, threshold_cells=100), road(spark, [(5, 505), (895, 505)]), info)
    one = across.filter("recommended").collect()
    assert len(one) == 1 and 30 < one[0].angle_deg <= 90
    beside = linear.candidates(flow, drainage.streams(flow, threshold_cells=100), road(spark, [(455.0, 995.0), (455.0, 5.0)]), info).collect()
    assert len(beside) >= 5 and len({x.cluster for x in beside}) == 1 and sum(x.recommended for x in beside) == 1 and all(x.parallel for x in beside)
    assert [x.candidate_id for x in sorted(beside, key=lambda x: x.chainage)] == [f"C{k + 1:03d}" for k in range(len(beside))]


def test_select_crossings(spark):
    rows = [("a", "candidate", True), ("b", "rejected", True), ("c", None, False)]
    f = lambda r: sorted(x.i for x in linear.select_crossings(spark.createDataFrame(r, "i string, status string, recommended boolean")).collect())
    assert f(rows) == ["a"] and f([*rows, ("d", " Accepted", False)]) == ["d"]


# --- channels ---------------------------------------------------------------------------------------


def valley(rows=81, cols=90, cell=1.0):
    i, j = np.mgrid[0:rows, 0:cols].astype(float)
    bank = np.clip((np.abs(j - 45) - 3) / 2, 0, 2.0)  # a bed of 6 cells, banks 2:1 and 2 high
    return 100 - 0.02 * i + bank + 0.001 * np.abs(j - 45)


def test_section_of_a_trapezoid(spark):
    z = valley()
    info = GridInfo(81, 90, 0.0, 81.0, 1.0, 1.0)
    own, flow = route(spark, z, info)
    flow = flow.join(own.select("id", "z"), "id")
    got = channel.sections(flow, own, spark.createDataFrame([("X001", 40 * 90 + 45)], "outlet string, id long"), info, 10.0, 20.0).first()
    assert got.xs_dist_m == 10 and abs(got.xs_bed_m - z[50, 45]) < 1e-6 and got.xs_quality == "high", got
    assert abs(got.xs_bankfull_d_m - 2) < 0.1 and abs(got.xs_w_1p0_m - 10) < 0.6 and abs(got.xs_side_slope_l - 2) < 0.3 and abs(got.xs_side_slope_r - 2) < 0.3


def test_slopes_and_deposition_of_a_broken_valley(spark):
    i, j = np.mgrid[0:120, 0:21].astype(float)
    fall = np.where(i < 90, 0.05 * i, 0.05 * 90 + 0.005 * (i - 90))
    z = 200 - 10 * fall + 2.0 * np.abs(j - 10)
    info = GridInfo(120, 21, 0.0, 1200.0, 10.0, 10.0)
    own, flow = route(spark, z, info)
    flow = flow.join(own.select("id", "z"), "id").cache()
    out = spark.createDataFrame([("X001", 105 * 21 + 10)], "outlet string, id long")
    s = channel.channel_slopes(flow, own, out, info, 100.0).first()
    assert abs(s.slope_up - 0.005) < 1e-9 and abs(s.slope_down - 0.005) < 1e-9 and s.len_up_m == 100 and s.len_down_m == 100
    slope = stencil.horn(own, info).select("r", "c", "slope")
    full = zonal.erosion_layers(flow.select("id", "r", "c", "acc", "z").join(slope, ["r", "c"]).withColumn("channel", F.col("acc") >= 50), 10.0, 10.0)
    d = channel.deposition(flow, full, out, info, 100.0, 500.0).first()
    assert d.flag == "deposition-prone" and d.ratio < 0.7 and abs(d.slope_near_pct - 0.5) < 1e-6
    short = channel.deposition(flow, full, spark.createDataFrame([("X001", 12 * 21 + 10)], "outlet string, id long"), info, 100.0, 500.0).first()
    assert short.ratio is None and short.note
    steps = channel.approach_cells(flow, full.filter("channel"), out, 10)
    assert {(x.step, x.id // 21) for x in steps.filter("id % 21 = 10").collect()} >= {(k, 105 - k) for k in range(1, 11)}


def test_burning_through_a_dam(spark):
    i, j = np.mgrid[0:40, 0:21].astype(float)
    z = 100 - 0.5 * i + 2.0 * np.abs(j - 10)
    z[20] = np.maximum(z[20], 120)
    info = GridInfo(40, 21, 0.0, 400.0, 10.0, 10.0)
    marks = spark.createDataFrame([("a", 0, 105.0, 195.0, 90.0), ("b", 1, 5.0, 3.0, 90.0)], "uid string, pos long, x double, y double, azimuth_deg double")
    own = cells(spark, z)
    burnt, log = conditioning.burn(own, marks, info)
    after = {(x.r, x.c): x.z for x in burnt.collect()}
    assert all(after[r, c] <= z[r, c] + 1e-12 for r, c in after) and after[20, 10] < 95
    logs = {x.uid: x for x in log.collect()}
    assert logs["a"].cells >= 1 and logs["a"].max_cut_m > 25 and logs["b"].note
    _, flow = route(spark, np.array([[after[r, c] for c in range(21)] for r in range(40)]), info)
    assert flow.filter("id = 39 * 21 + 10").first().acc > 600


def test_bresenham_is_the_error_rule():
    def plain(a, b):
        out, (r, c), (dr, dc) = [], a, (abs(b[0] - a[0]), abs(b[1] - a[1]))
        sr, sc, e = (1 if b[0] >= a[0] else -1), (1 if b[1] >= a[1] else -1), abs(b[1] - a[1]) - abs(b[0] - a[0])
        while True:
            out.append((r, c))
            if (r, c) == b:
                return out
            twice = 2 * e
            if twice > -dr:
                e, c = e - dr, c + sc
            if twice < dc:
                e, r = e + dc, r + sr

    for b in [(p, q) for p in range(-7, 8) for q in range(-7, 8)]:
        assert geometry.line_cells((0, 0), b) == plain((0, 0), b)


# --- coverage -----------------------------------------------------------------------------------------


def test_wall_has_no_slit(spark):
    info = GridInfo(20, 20, 0.0, 200.0, 10.0, 10.0)
    for way in ([(5, 195), (195, 5)], [(5, 5), (195, 195)], [(5, 100), (195, 160)]):
        wall = {(x.r, x.c) for x in coverage.wall_cells(road(spark, way), info).collect()}
        assert all((r, c + s) in wall or (r + 1, c) in wall for r, c in wall for s in (-1, 1) if (r + 1, c + s) in wall)
    gaps = spark.createDataFrame([(100.0, 100.0)], "x double, y double")
    assert not any(abs(x.r - 10) <= 1 and abs(x.c - 10) <= 1 for x in coverage.wall_cells(road(spark, [(5, 195), (195, 5)]), info, gaps).collect())


def test_side_drains_of_a_plane(spark):
    i, j = np.mgrid[0:60, 0:80].astype(float)
    z = 200 - 1.0 * i  # falls southwards; the road runs east along row 30
    info = GridInfo(60, 80, 0.0, 600.0, 10.0, 10.0)
    own, flow = route(spark, z, info, conditioned=False)
    sti = own.select("id", (F.lit(30.0) - (F.lit(30) - F.col("r"))).alias("sti"), F.lit(False).alias("channel"))
    got = coverage.side_drain(road(spark, [(105, 295), (605, 295)]), sti, flow, info)
    mid = {x.side: x for x in got.filter("chainage_m = 200").collect()}
    assert mid["L"].n == 5 and mid["R"].n == 0 and mid["L"].sti_p50 == 27 and abs(mid["L"].sti_p90 - 28.6) < 1e-9
    classed = coverage.drain_classes(got, got.select("road", "chainage_m").distinct().withColumn("slope_long_pct", F.lit(0.2)))
    assert {x.sti_class for x in classed.filter("n > 0").collect()} == {"low"} and {x.siltation for x in classed.filter("n > 0").collect()} == {0}


def test_mapped_lines(spark):
    i, j = np.mgrid[0:60, 0:41].astype(float)
    z = 200 - 0.5 * i + np.abs(j - 20)
    info = GridInfo(60, 41, 0.0, 600.0, 10.0, 10.0)
    _, flow = route(spark, z, info)
    flow = flow.cache()
    stream = drainage.streams(flow, threshold_cells=60).filter("c = 20")
    line = lambda x: coverage.line_segments(spark.createDataFrame([(7, 0, x, 595.0), (7, 1, x, 5.0)], "line int, pos int, x double, y double"))
    top = stream.agg(F.min("r")).first()[0]
    scores, agreeing = coverage.mapped_agreement(stream, flow, line(205.0), info, 15.0)
    s = scores.first()
    assert s.precision == 1 and s.recall > (60 - top) / 60 - 0.02 and agreeing.count() == stream.count()
    far, none = coverage.mapped_agreement(stream, flow, line(255.0), info, 20.0)
    assert far.first().precision == 0 and far.first().recall == 0 and none.count() == 0
    marks = spark.createDataFrame([("a", 215.0, 100.0, 2.0), ("b", 215.0, 100.0, 0.1), ("c", 400.0, 100.0, 2.0)], "uid string, x double, y double, area_km2 double")
    got = {x.uid: (x.map_agrees, x.map_note is None) for x in coverage.mapped_crossings(marks, line(205.0), 60.0).collect()}
    assert got == {"a": (1, True), "b": (None, False), "c": (0, False)}
    seg = road(spark, [(5, 300), (405, 300)])
    assert [round(x.chainage_m, 6) for x in coverage.uncovered_rivers(line(205.0), seg, spark.createDataFrame([(0, 500.0)], "road int, chainage_m double")).collect()] == [200.0]
    assert coverage.uncovered_rivers(line(205.0), seg, spark.createDataFrame([(0, 230.0)], "road int, chainage_m double")).count() == 0
    half = stream.filter("r < 30")
    runs = coverage.divergence(stream, half, flow, info, 5).collect()
    assert len(runs) == 1 and runs[0].cells == stream.filter("r >= 30 and c = 20").count() and runs[0].rejoins == 0


# --- zones --------------------------------------------------------------------------------------------


def test_perimeter_of_a_disk_and_a_square(spark):
    info = GridInfo(120, 120, 0.0, 1200.0, 10.0, 10.0)
    disk = [("d", i, j) for i in range(120) for j in range(120) if (i - 60) ** 2 + (j - 60) ** 2 <= 40**2]
    square = [("s", i, j) for i in range(20, 100) for j in range(20, 100)]
    for tile in (32, 256):
        got = {x.outlet: x.perimeter_m for x in geometry.perimeters(spark.createDataFrame(disk + square, "outlet string, r int, c int"), info, tile).collect()}
        assert abs(got["d"] / (2 * math.pi * 400) - 1) < 0.02 and abs(got["s"] / 3200 - 1) < 0.015


def test_polygons_hold_their_cells(spark):
    r = np.random.default_rng(6)
    info = GridInfo(12, 12, 100.0, 300.0, 10.0, 5.0)
    mask = [("z", i, j) for i in range(12) for j in range(12) if r.random() < 0.7]
    got = geometry.zone_polygons(spark.createDataFrame(mask, "outlet string, r int, c int"), info)
    row = got.first()
    assert abs(row.area_m2 - 50 * len(mask)) < 1e-6
    kind, parts = geometry.parse_wkb(bytes(row.wkb))
    assert kind == "MultiPolygon" and all(geometry.signed_area(p[0][:-1]) > 0 and all(geometry.signed_area(h[:-1]) < 0 for h in p[1:]) for p in parts)
    back = geometry.paint(geometry.edges_of(got.withColumn("zone", F.lit(3)), "zone"), info)
    assert sorted((x.r, x.c, x.zone) for x in back.collect()) == sorted((i, j, 3) for _, i, j in mask)


def golden():
    r, c = np.mgrid[0:60, 0:50].astype(float)
    main = 200.0 + 0.8 * (59 - r) + 1.5 * np.abs(c - 20)
    side = 200.0 + 0.8 * 34 + 0.6 * (c - 20) + 1.2 * np.abs(r - 25)
    return np.where(c > 20, np.minimum(main, side), main) + 0.001 * c


def test_package_of_three_crossings(spark, tmp_path):
    z, info = golden(), GridInfo(60, 50, 500000.0, 9900600.0, 10.0, 10.0)
    own, flow = route(spark, z, info)
    flow = flow.cache()
    stream = drainage.streams(flow, threshold_cells=100)
    orders = drainage.strahler(flow, stream, info)
    at = lambda r, c, dx, dy, fid: (fid, 500000 + (c + 0.5) * 10 + dx, 9900600 - (r + 0.5) * 10 + dy)
    points = spark.createDataFrame([at(20, 20, 12.0, 3.0, 7), at(55, 20, -14.0, -2.0, 3), at(25, 38, 4.0, 11.0, 11)], "fid long, x double, y double")
    got = package.build_records(flow, own, points, info, stream, radius=3, orders=orders, channel_cells=100)
    x = {r.outlet_uid: r for r in got["crossings"].collect()}
    ca = {r.outlet_uid: r for r in got["catchments"].collect()}
    fp = {r.outlet_uid: r for r in got["flowpaths"].collect()}
    assert set(x) == set(ca) == set(fp) == {"X001", "X002", "X003"} and sorted(r.outlet_id for r in x.values()) == [3, 7, 11]
    assert max(x.values(), key=lambda r: r.acc_at_outlet_km2).outlet_uid == "X001" and all(r.snap_dist_m > 0 and r.stream_order >= 1 for r in x.values())
    assert all(abs(r.polygon_m2 - r.area_km2 * 1e6) < 1e-6 and abs(r.area_km2 - x[u].acc_at_outlet_km2) < 1e-12 for u, r in ca.items())
    # vertices of the three outlines and paths are those published for this terrain
    assert [ca[u].n_vertices for u in sorted(ca)] == [87, 95, 53] and [fp[u].n_vertices for u in sorted(fp)] == [22, 60, 13] or sorted(r.n_vertices for r in ca.values()) == [53, 87, 95] and sorted(r.n_vertices for r in fp.values()) == [13, 22, 60]
    package.check(got)
    assert package.validate(got, "1.2.0") == []
    local = package.build_records(flow, own, points, info, stream, radius=3, local=True, polygons=False)
    assert abs(sum(r.area_km2 for r in local["catchments"].collect()) - ca["X001"].area_km2) < 1e-9
    with pytest.raises(package.PackageError, match="same cell"):
        package.build_records(flow, own, spark.createDataFrame([at(55, 20, 0.0, 0.0, 1), at(55, 20, 1.0, 1.0, 2)], "fid long, x double, y double"), info, stream, radius=3)
    log = {(r.old_uid, r.new_uid): r.change for r in package.renumber(spark.createDataFrame([(3, "X001", 1.0, 1.0), (7, "X009", None, None), (99, "X077", 0.0, 0.0)], "outlet_id long, outlet_uid string, outlet_x double, outlet_y double"), got).collect()}
    assert log[None, "X077"] if (None, "X077") in log else ("X077", None) in log
    assert sorted(log.values()) == ["deleted", "new", "renumbered", "unchanged"]
    assert package.dictionary({k: got[k] for k in package.LAYERS}).filter("layer = 'crossings' and field = 'outlet_uid'").count() == 1


def test_register_ids_grow(spark):
    rows = spark.range(1200).select(F.format_string("X%04d", "id").alias("outlet_uid"), F.col("id").cast("double").alias("chainage_m"))
    got = [r.finding_id for r in review.register(rows, [(F.lit(True), "low", "t")]).collect()]
    assert len(set(got)) == 1200 and {len(g) for g in got} == {5}


def test_package_findings(spark):
    rows = spark.createDataFrame([("X001", 10.0, 1, 5, 100.0), ("X002", 5.0, 0, 0, 10.0)], "outlet_uid string, chainage_m double, truncated int, truncated_cells int, snap_dist_m double")
    got = [(r.outlet_uid, r.severity, r.finding_id) for r in review.package_findings(rows, 30.0).orderBy("finding_id").collect()]
    assert got == [("X001", 3, "F001"), ("X001", 1, "F002")]


def test_sensitivity_of_a_valley(spark):
    z, info = golden(), GridInfo(60, 50, 0.0, 600.0, 10.0, 10.0)
    own, flow = route(spark, z, info)
    flow = flow.cache()
    up = drainage.upstream_lengths(flow, info).cache()
    marks = spark.createDataFrame([("X001", 205.0, 45.0), ("X002", 5.0, 595.0)], "outlet_uid string, x double, y double")
    long, summary = review.crossing_sensitivity({"barnes": (flow, up), "toward": (flow, up)}, marks, info, 100.0, 3)
    rows = {(r.outlet_uid, r.factor, r.setting): r for r in long.collect()}
    assert len(rows) == 12 and rows["X001", "base", "barnes"].d_area_pct == 0 and rows["X002", "base", "barnes"].outlet_lost == 1
    s = {r.outlet_uid: r for r in summary.collect()}
    assert s["X001"].sens_max_area_pct == 0 and s["X002"].base_area_km2 is None
    # no task snaps all variants: the grid is joined before, a variant at a time
    assert summary._jdf.queryExecution().optimizedPlan().toString().count("Join ") <= 6
    flat = review.flat_sensitivity({"barnes": flow, "toward": flow}, spark.createDataFrame([("X001", 55 * 50 + 20)], "outlet string, id long"), own.limit(0), info, threshold_cells=100.0).first()
    assert flat.flat_sensitivity_pct == 0 and flat.flat_moved == 0


# --- uncertainty --------------------------------------------------------------------------------------


@pytest.mark.parametrize("method", ["barnes", "toward"])
def test_window_routing_is_that_of_the_grid(spark, method):
    r = np.random.default_rng(8)
    z = np.round(r.random((24, 22)) * 4) + 0.5 * np.arange(22)
    z[r.random(z.shape) < 0.04] = np.nan
    info = GridInfo(24, 22)
    own = cells(spark, z)
    surface = fill.fill_depressions(own, info, tile=8).select("r", "c", F.col("filled").alias("z"))
    assert {(x.r, x.c): x.z for x in surface.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(window_router.filled(z)) if not np.isnan(v)}
    flow = fill.resolve_flats(stencil.d8(surface, info).join(surface, ["r", "c"]), info, method=method, tile=8)
    d = window_router.directions(window_router.filled(z), 30.0, 30.0, method)
    assert {(x.r, x.c): -1 if x.dir is None else x.dir for x in flow.collect()} == {(i, j): int(v) for (i, j), v in np.ndenumerate(d) if not np.isnan(z[i, j])}


def test_realisations_of_crossings(spark):
    z, info = golden(), GridInfo(60, 50, 0.0, 600.0, 10.0, 10.0)
    marks = spark.createDataFrame([("X001", 205.0, 45.0), ("X002", 5.0, 595.0)], "uid string, x double, y double")
    rows = uncertainty.crossings(cells(spark, z), marks, info, 6, 0.5, 50.0, threshold_cells=100.0, snap_cells=3).cache()
    assert rows.count() == 14 and rows.filter("realisation = 0 and uid = 'X002'").first().area_km2 is None
    got = {r.uid: r for r in uncertainty.summarise(rows).collect()}
    assert got["X001"].n == 6 and got["X001"].area_km2_p10 <= got["X001"].area_km2_p50 <= got["X001"].area_km2_p90 and got["X002"].area_km2_p50 is None and got["X002"].note
    off = uncertainty.summarise(rows, spark.createDataFrame([("X001", 9.0)], "uid string, area_km2 double"))
    assert {r.uid: r.area_km2_p50 for r in off.collect()}["X001"] is None
    with pytest.raises(ValueError, match="must be given"):
        uncertainty.crossings(cells(spark, z), marks, info, 2, None)


def test_error_fields_do_not_depend_on_windows():
    whole = uncertainty.error_field(0, 0, 60, 70, 2.5, 3.0, 11, 4)
    assert (uncertainty.error_field(17, 23, 20, 31, 2.5, 3.0, 11, 4) == whole[17:37, 23:54]).all()
    assert not np.allclose(uncertainty.error_field(0, 0, 60, 70, 2.5, 3.0, 11, 5), whole) and not np.allclose(uncertainty.error_field(0, 0, 60, 70, 2.5, 3.0, 12, 4), whole)
    assert (uncertainty.error_field(0, 0, 5, 5, 0.0, 3.0, 1, 1) == 0).all()


@pytest.mark.parametrize("length", [1e-9, 1.5, 4.0])
def test_error_fields_have_their_deviation_and_correlation(length):
    a = uncertainty.error_field(0, 0, 900, 900, 2.5, length, 7, 1)
    assert abs(a.mean()) < 0.1 and abs(a.std() / 2.5 - 1) < 0.03
    for d in (1, 2, 4, 7):
        for x, y in ((a[:, d:], a[:, :-d]), (a[d:], a[:-d])):
            assert abs((x * y).mean() / a.var() - math.exp(-((d / length) ** 2))) < 0.03


def test_realisations_do_not_depend_on_tiles(spark):
    z = golden()
    got = [{(x.realisation, x.r, x.c): x.z for x in uncertainty.realisations(cells(spark, z), 10, 0.5, 50.0, 10.0, tile=tile).collect()} for tile in (16, 256)]
    assert got[0] == got[1] and len(got[0]) == 11 * z.size and all(got[0][0, i, j] == v for (i, j), v in np.ndenumerate(z))


def test_crossings_are_those_of_each_surface_alone(spark):
    z, info = golden(), GridInfo(60, 50, 0.0, 600.0, 10.0, 10.0)
    marks = spark.createDataFrame([("X001", 205.0, 45.0), ("X003", 1e6, 0.0)], "uid string, x double, y double")
    rows = {(x.realisation, x.uid): x for x in uncertainty.crossings(cells(spark, z), marks, info, 1, 0.8, 40.0, threshold_cells=100.0, snap_cells=3, tile=32).collect()}
    assert len(rows) == 4 and rows[0, "X003"].area_km2 is None
    noisy = z + uncertainty.error_field(0, 0, 60, 50, 0.8, 4.0, 2026, 1)
    d = window_router.directions(window_router.filled(noisy), 10.0, 10.0)
    parent = {(i, j): (i + OFFSETS[k][0], j + OFFSETS[k][1]) for (i, j), k in np.ndenumerate(d) if k >= 0}
    parent = {a: b for a, b in parent.items() if 0 <= b[0] < 60 and 0 <= b[1] < 50}
    above: dict = {}
    for x in np.ndindex(60, 50):
        while x in parent:
            x = parent[x]
            above[x] = above.get(x, 0) + 1
    near = [(max(abs(i - 55), abs(j - 20)), -above.get((i, j), 0), i, j) for i in range(52, 59) for j in range(17, 24) if above.get((i, j), 0) >= 100]
    assert abs(rows[1, "X001"].area_km2 - (1 - min(near)[1]) * 1e-4) < 1e-12 and rows[1, "X001"].lfp_length_m > 0


def test_sags_beside_gaps(spark):
    profiles = {1: [5, 3, 5], 2: [5, 3, None, 5], 3: [5, None, 3, 5], 4: [5, 3, 3, None, 3, 5], 5: [5, 4, 3, None, 2, 5, 5], 6: [5, 3, 4, None, 1, 9], 7: [5, 3, None, 3, 5], 8: [3, 5], 9: [5, 2, 6, None, 4, 6, 3, 7]}
    rows = spark.createDataFrame([(road, 10.0 * k, None if z is None else float(z)) for road, own in profiles.items() for k, z in enumerate(own)], "road int, chainage_m double, smooth double")
    got = sorted((r.road, r.chainage_m, r.prominence_m) for r in linear.sags(rows).collect())
    assert got == [(1, 10.0, 2.0), (4, 10.0, 2.0), (6, 10.0, 1.0), (9, 10.0, 3.0), (9, 60.0, 3.0)]
