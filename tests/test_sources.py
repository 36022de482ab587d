"""Grids, packages and tables: what is written is read."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvispark.operators import geometry
from fluvispark.sources import geopackage, raster, tables
from fluvispark.sources.grids import GridInfo


def cells(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])], "r int, c int, z double")


def test_grids_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    z = np.round(r.random((300, 270)) * 100, 2).astype(np.float32).astype(float)
    z[r.random(z.shape) < 0.1] = np.nan
    info = GridInfo(300, 270, 500000.0, 9900600.0, 10.0, 10.0)
    path = f"file://{tmp_path}/a.tif"
    raster.write_grid(cells(spark, z), info, "z", path, epsg=32737, tags={"SOURCE": "test"})
    head = raster.headers(spark, path).first()
    assert (head.rows, head.cols, head.epsg, head.projected, head.nodata, head.tags["SOURCE"]) == (300, 270, 32737, True, -9999.0, "test")
    got, back = raster.read_grid(spark, path)
    assert back == info and {(x.r, x.c): x.z for x in got.collect()} == {(i, j): v for (i, j), v in np.ndenumerate(z) if not np.isnan(v)}
    fewer, _ = raster.read_grid(spark, path, nodata=float(z[0, 0]) if z[0, 0] == z[0, 0] else float(np.nanmax(z)))
    assert fewer.count() < got.count()


def test_pieces_are_one_grid(spark, tmp_path):
    z = np.arange(50.0 * 70).reshape(50, 70)
    info = GridInfo(50, 70, 100.0, 900.0, 2.0, 3.0)
    (tmp_path / "p").mkdir()
    for p in raster.pieces(cells(spark, z), info, "z", size=32).collect():
        (tmp_path / "p" / f"{p.tr}_{p.tc}.tif").write_bytes(bytes(p.content))
    got, back = raster.read_grid(spark, f"file://{tmp_path}/p")
    assert back == info and got.count() == 3500 and got.agg(F.sum("z")).first()[0] == z.sum()


def test_layouts_of_files():
    z = np.arange(35.0).reshape(5, 7).astype("<f4")
    data = raster.encode(z, GridInfo(5, 7, 0.0, 0.0, 1.0, 1.0))
    t = raster.Tiff(data)
    assert (next(t.blocks())[2] == z).all()
    for predictor in (2, 3):
        t.predictor = predictor
        if predictor == 2:
            raw = np.diff(z.view("<u4").astype(np.uint32), axis=1, prepend=np.uint32(0)).astype("<u4").tobytes()
        else:
            split = z.astype(">f4").view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
            raw = np.diff(split, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
        assert (t._values(raw, 5, 7) == z).all()
    with pytest.raises(raster.RasterError):
        raster.Tiff(b"no file at all")


def test_resampling(spark):
    z = np.add.outer(np.arange(20.0), 2 * np.arange(20.0))
    source, target = GridInfo(20, 20, 0.0, 200.0, 10.0, 10.0), GridInfo(8, 8, 25.0, 175.0, 5.0, 5.0)
    for x in raster.resample(cells(spark, z), source, target).collect():
        px, py = 25 + (x.c + 0.5) * 5, 175 - (x.r + 0.5) * 5
        assert abs(x.z - ((200 - py) / 10 - 0.5 + 2 * (px / 10 - 0.5))) < 1e-9
    near = {(x.r, x.c): x.z for x in raster.resample(cells(spark, z), source, target, "near").collect()}
    assert near[0, 0] == z[2, 2] and len(near) == 64
    shifted = raster.resample(cells(spark, z), source, target, "near", back=lambda x, y: (x + 10, y))
    assert {(x.r, x.c): x.z for x in shifted.collect()}[0, 0] == z[2, 3]
    assert raster.transform_bounds((0, 0, 1, 2), lambda x, y: (y, -x)) == (0, -1, 2, 0)


def test_packages_round_trip(spark, tmp_path):
    path = f"{tmp_path}/p.gpkg"
    poly = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]]]
    rows = spark.createDataFrame([("X001", 1, 2.5, True, bytearray(geometry.wkb_multipolygon(poly))), ("X002", None, float("nan"), None, None)], "outlet_uid string, n long, v double, flag boolean, wkb binary")
    w = geopackage.Writer(path, 32737)
    w.add("catchments", rows, "wkb", "zones")
    w.add("crossings", rows.select("outlet_uid", F.lit(bytearray(geometry.wkb_point(1.0, 2.0))).alias("wkb")), "wkb")
    w.add("notes", rows.select("outlet_uid", "n"))
    with pytest.raises(ValueError):
        w.add("bad name", rows.select("n"))
    w.close()
    assert geopackage.tables(path) == [("catchments", "features"), ("crossings", "features"), ("notes", "attributes")]
    got = geopackage.read(spark, path, "catchments").orderBy("fid").collect()
    assert (got[0].outlet_uid, got[0].n, got[0].v, got[0].flag) == ("X001", 1, 2.5, 1) and got[1].v is None and got[1].geom is None
    assert geometry.parse_wkb(bytes(got[0].geom)) == ("MultiPolygon", poly)
    con = sqlite3.connect(path)
    assert con.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
    assert con.execute("SELECT min_x, min_y, max_x, max_y, srs_id FROM gpkg_contents WHERE table_name = 'catchments'").fetchone() == (0, 0, 4, 3, 32737)
    con.close()


def test_lookup_tables(spark, tmp_path):
    f = tmp_path / "cn.csv"
    f.write_text("﻿Class;A;B;C;D\n10;30;55;70;77\nx;1;1;1;1\n20;;48;65;73\n", encoding="utf-8")
    assert tables.lookup(spark, f"file://{f}") == {10: (30.0, 55.0, 70.0, 77.0), 20: (None, 48.0, 65.0, 73.0)}
    f.write_text("class\tC\n10\t0.2\n", encoding="utf-8")
    assert tables.values(spark, f"file://{f}") == {10: 0.2}
    f.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="class"):
        tables.lookup(spark, f"file://{f}")
    f.write_text("UNIT,sand,silt,clay,oc,drain\n12,40,40,20,-1,W\n13,10,80,10,2,\n")
    got = {x.soil_unit: x for x in tables.soil_units(spark, f"file://{f}", "unit").collect()}
    assert got["12"].oc_pct is None and got["12"].drain == "W" and got["13"].drain is None
    f.write_text("unit,sand,silt,clay,oc\n1,1,1,1,1\n1,2,2,2,2\n")
    with pytest.raises(ValueError, match="more than once"):
        tables.soil_units(spark, f"file://{f}", "unit")


def test_soil_database_and_layers(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "soil.db")
    con.execute("CREATE TABLE SOTERparameterEstimates (PRID TEXT, Layer TEXT, TopDep REAL, BotDep REAL, SDTO REAL, STPC REAL, CLPC REAL, TOTC REAL, BULK REAL, CFRAG REAL, Drain TEXT)")
    con.execute("INSERT INTO SOTERparameterEstimates VALUES ('p', 'D1', 0, 20, 40, 40, 20, 15, -1, 5, 'W')")
    con.execute("CREATE TABLE SOTERunitComposition (NEWSUID TEXT, PRID1 TEXT, PROP1 REAL, PRID2 TEXT, PROP2 REAL)")
    con.execute("INSERT INTO SOTERunitComposition VALUES ('KE1', 'p', 70, 'q', 30)")
    con.commit()
    con.close()
    parts, layers = tables.soil_database(spark, str(tmp_path / "soil.db"))
    assert sorted((x.unit, x.profile, x.share) for x in parts.collect()) == [("KE1", "p", 70.0), ("KE1", "q", 30.0)]
    one = layers.first()
    assert one.oc_pct == 1.5 and one.bulk is None and one.cfrag == 5
    for name in ("sand_0-5cm_mean.tif", "sand_0-5cm_Q0.5.tif", "clay_5-15cm_Q0.5.tif", "sand_0-5cm_Q0.95.tif", "other.tif"):
        (tmp_path / name).write_bytes(b"")
    assert [(p, t, b, x.rsplit("/", 1)[1]) for p, t, b, x in tables.depth_layers(spark, f"file://{tmp_path}")] == [("clay", 5.0, 15.0, "clay_5-15cm_Q0.5.tif"), ("sand", 0.0, 5.0, "sand_0-5cm_mean.tif")]
    layer = lambda v: spark.createDataFrame([(0, 0, v)], "r int, c int, z double")
    assert tables.depth_mean([(0, 5, layer(300.0)), (5, 15, layer(400.0)), (15, 30, layer(600.0))], 0, 20).first().z == 425


def test_features(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","id":"4","properties":{"name":"a"},"geometry":{"type":"Point","coordinates":[12.5,-3]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiPoint","coordinates":[[1,2],[3,4]]}}]}')
    got = sorted((x.fid or 0, x.x, x.y) for x in tables.points_geojson(spark, f"file://{tmp_path}/p.json").collect())
    assert got == [(0, 1.0, 2.0), (4, 12.5, -3.0)]
    (tmp_path / "l.json").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[0,0],[1,0]],[[2,0],[3,1]]]}}]}')
    assert [(x.part, x.pos, x.x, x.y) for x in tables.lines_geojson(spark, f"file://{tmp_path}/l.json").orderBy("part", "pos").collect()] == [(0, 0, 0.0, 0.0), (0, 1, 1.0, 0.0), (1, 0, 2.0, 0.0), (1, 1, 3.0, 1.0)]
    inside, outside = tables.points(spark.createDataFrame([(1.0, 1.0), (50.0, 1.0)], "x double, y double"), GridInfo(10, 10, 0.0, 10.0, 1.0, 1.0))
    assert inside.count() == 1 and outside.count() == 1
