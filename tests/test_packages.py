"""Packages, features and erosion folders: what is written is read."""

import pytest
from pyspark.sql import functions as F

from fluvispark.operators import geometry, package
from fluvispark.sources import packages, tables
from fluvispark.sources.grids import GridInfo

UTM = 'PROJCS["WGS 84 / UTM zone 37S",UNIT["metre",1],AUTHORITY["EPSG","32737"]]'


def layers(spark):
    crossings = spark.createDataFrame([("X001", 10.0, 5.0, 95.0, None, None, "existing"), ("X002", 20.0, None, None, 55.0, 45.0, None), ("P001", 30.0, 1.0, 1.0, None, None, "proposed"), ("X003", 40.0, 5000.0, 0.0, None, None, None)], "outlet_uid string, chainage_m double, input_x double, input_y double, outlet_x double, outlet_y double, status string")
    figures = spark.createDataFrame([("X001", 1, 2.5), ("X002", 0, 1.0)], "outlet_uid string, truncated int, area_km2 double")
    road = spark.createDataFrame([(1, 0, 0.0, 0.0, 250.0), (1, 1, 30.0, 40.0, 250.0), (2, 0, 99.0, 99.0, 300.0)], "part int, pos int, x double, y double, chainage_from_m double")
    return {"crossings": crossings, "catchments": figures, "flowpaths": figures.select("outlet_uid"), "road": road}


def test_packages(spark, tmp_path):
    path, own = f"file://{tmp_path}/p", layers(spark)
    packages.write_package(own, path, {"tool": "test", "numbers": {"b": 1}}, UTM)
    got, values = packages.read_package(spark, path)
    assert set(got) == set(own) and (values["crs_epsg"], values["n_crossings"], values["numbers"]) == ("32737", "4", '{"b": 1}')
    for name in own:
        assert sorted(map(repr, got[name].collect())) == sorted(map(repr, own[name].collect()))
    assert not [p for p in packages.problems(spark, path) if p.startswith("error")]
    segments = packages.road(spark, path).collect()
    assert len(segments) == 1 and segments[0].ch0 == 250.0
    points = {r.outlet_uid: (r.x, r.y, r.r, r.c) for r in packages.sensitivity_points(spark, path, GridInfo(10, 10, 0.0, 100.0, 10.0, 10.0)).collect()}
    assert points == {"X001": (5.0, 95.0, 0, 0), "X002": (55.0, 45.0, 5, 5)}
    assert [(r.outlet_uid, r.finding) for r in packages.findings(spark, path, 10.0).orderBy("finding_id").collect()] == [("X001", "area.open"), ("P001", "record.proposed")]
    dictionary = spark.read.parquet(f"{path}/{packages.FIELDS}")
    assert dictionary.filter("layer = 'catchments' and field = 'area_km2'").first().unit == "km2"


def test_packages_that_are_refused(spark, tmp_path):
    own = layers(spark)
    with pytest.raises(package.PackageError, match="X009"):
        packages.write_package({**own, "flowpaths": spark.createDataFrame([("X009",)], "outlet_uid string")}, f"file://{tmp_path}/a")
    with pytest.raises(package.PackageError, match="duplicate"):
        packages.write_package({**own, "crossings": own["crossings"].union(own["crossings"])}, f"file://{tmp_path}/b")
    with pytest.raises(package.PackageError, match="degrees"):
        packages.write_package(own, f"file://{tmp_path}/c", wkt='GEOGCS["WGS 84"]')
    with pytest.raises(package.PackageError, match="no package"):
        packages.read_package(spark, f"file://{tmp_path}/d")
    packages.write_package({k: v for k, v in own.items() if k != "road"}, f"file://{tmp_path}/e")
    assert packages.road(spark, f"file://{tmp_path}/e") is None


def test_features_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(k, float(k), -0.5 * k, f'n"{k}', None if k % 2 else float("nan")) for k in range(20)], "fid long, x double, y double, name string, v double").repartition(3)
    path = packages.write_features(rows, f"file://{tmp_path}/points", x="x", y="y", fid="fid")
    got = {r.fid: (r.x, r.y, r.attributes["name"], r.attributes.get("v")) for r in tables.points_geojson(spark, path).collect()}
    assert got == {k: (float(k), -0.5 * k, f'n"{k}', None) for k in range(20)}
    lines = spark.createDataFrame([("a", bytearray(geometry.wkb_line([(0.0, 1.0), (2.0, 3.5)]))), ("b", bytearray(geometry.wkb_line([(5.0, 5.0), (6.0, 6.0), (7.0, 5.0)])))], "name string, wkb binary").repartition(2, "name")
    path = packages.write_features(lines, f"file://{tmp_path}/lines", wkb="wkb")
    got = [(r.attributes["name"], r.pos, r.x, r.y) for r in tables.lines_geojson(spark, path).orderBy(F.col("attributes")["name"], "pos").collect()]
    assert got == [("a", 0, 0.0, 1.0), ("a", 1, 2.0, 3.5), ("b", 0, 5.0, 5.0), ("b", 1, 6.0, 6.0), ("b", 2, 7.0, 5.0)]
    parts = tables.lines_geojson(spark, path)
    assert parts.select("feature").distinct().count() == 2 and sorted(r.part for r in parts.select("part").distinct().collect()) == [0, 1]


def test_erosion_folders(spark, tmp_path):
    info = GridInfo(40, 50, 500000.0, 9900600.0, 10.0, 10.0)
    cells = spark.range(2000).select(F.expr("cast(id div 50 as int)").alias("r"), F.expr("cast(id % 50 as int)").alias("c"), (F.col("id") / 4).alias("ls"), F.when(F.col("id") % 3 > 0, F.col("id") * 1.5).alias("a_loss"), (F.col("id") % 7 == 0).cast("int").alias("channel"))
    folder = packages.write_erosion(cells, info, f"file://{tmp_path}/e", {"schemes": {"ls": [1, 2]}}, size=32)
    got, run = packages.read_erosion(spark, folder, info)
    assert run["schemes"] == {"ls": [1, 2]} and run["layers"] == ["ls", "a_loss", "channel"]
    want = {(r.r, r.c): (r.ls, r.a_loss, bool(r.channel)) for r in cells.collect()}
    assert {(r.r, r.c): (r.ls, r.a_loss, r.channel) for r in got.collect()} == want
    with pytest.raises(ValueError, match="another grid"):
        packages.read_erosion(spark, folder, GridInfo(40, 50, 500005.0, 9900600.0, 10.0, 10.0))
    with pytest.raises(ValueError, match="no erosion folder"):
        packages.read_erosion(spark, f"file://{tmp_path}/none", info)
