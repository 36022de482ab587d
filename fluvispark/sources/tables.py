"""Small tables from files: lookups, soil units, pour points, roads, soil databases, names of depth layers.

Lookups and unit tables are read by the driver (a row a class or unit); points, roads and layers are Spark tables. Texts are UTF-8, with or without a byte order mark;
the separator is a comma, a semicolon or a tab, whichever the first line has most.
"""

from __future__ import annotations

import csv
import io
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .grids import GridInfo
from .raster import take


def rows_of(text: str) -> list[dict[str, str]]:
    """The rows of a separated text by lower-cased header."""
    text = text.lstrip("﻿")
    first = text.split("\n", 1)[0]
    separator = max(",;\t", key=lambda s: first.count(s))
    return [{(k or "").strip().lower(): v for k, v in r.items()} for r in csv.DictReader(io.StringIO(text), delimiter=separator)]


def number(v: str | None) -> float | None:
    try:
        x = float(v)
    except (TypeError, ValueError):
        return None
    return x if math.isfinite(x) else None


def lookup(spark: SparkSession, path: str) -> dict[int, tuple[float | None, ...]]:
    """class -> values of the soil groups A to D; a table with one value column has it four times. Rows without a class are left out."""
    rows = rows_of(take(spark, path).decode("utf-8"))
    if not rows:
        raise ValueError(f"{path}: no rows")
    if "class" not in rows[0]:
        raise ValueError(f"{path}: a column 'class' is needed")
    groups = [g for g in "abcd" if g in rows[0]]
    other = [c for c in rows[0] if c not in ("class", "name", "description", "")]
    if len(groups) < 4 and not other:
        raise ValueError(f"{path}: columns A, B, C, D or one value column are needed")
    own = groups if len(groups) == 4 else other[:1] * 4
    return {int(number(r["class"])): tuple(number(r[c]) for c in own) for r in rows if number(r["class"]) is not None}


def values(spark: SparkSession, path: str) -> dict[int, float]:
    """class -> value."""
    return {k: v[0] for k, v in lookup(spark, path).items() if v[0] is not None}


def soil_units(spark: SparkSession, path: str, unit: str) -> DataFrame:
    """(soil_unit, sand, silt, clay, oc_pct, bulk, cfrag, drain) of a unit table; codes are text, negative values missing, a code that comes twice is an error."""
    rows = rows_of(take(spark, path).decode("utf-8"))
    need = [unit.lower(), "sand", "silt", "clay", "oc"]
    lacking = [c for c in need if not rows or c not in rows[0]]
    if lacking:
        raise ValueError(f"{path}: missing {', '.join(lacking)}")
    positive = lambda v: None if number(v) is None or number(v) < 0 else number(v)
    out = [((r[unit.lower()] or "").strip(), *[positive(r.get(c)) for c in ("sand", "silt", "clay", "oc", "bulk", "cfrag")], (r.get("drain") or "").strip() or None) for r in rows]
    out = [r for r in out if r[0]]
    twice = sorted({r[0] for r in out if sum(q[0] == r[0] for q in out) > 1})
    if twice:
        raise ValueError(f"{path}: units that come more than once: {', '.join(twice)}")
    return spark.createDataFrame(out, "soil_unit string, sand double, silt double, clay double, oc_pct double, bulk double, cfrag double, drain string")


def soil_attributes(features: DataFrame, unit: str, sand: str = "sand", silt: str = "silt", clay: str = "clay", oc: str = "oc", bulk: str | None = None, cfrag: str | None = None, drain: str | None = None, oc_per_kg: bool = False) -> DataFrame:
    """Polygon attributes as soil units; organic carbon in g/kg is divided by ten."""
    v = lambda c: F.lit(None).cast("double") if c is None else F.when(F.col(c).try_cast("double") >= 0, F.col(c).try_cast("double"))
    return features.select(F.col(unit).cast("string").alias("soil_unit"), v(sand).alias("sand"), v(silt).alias("silt"), v(clay).alias("clay"), (v(oc) / (10.0 if oc_per_kg else 1.0)).alias("oc_pct"), v(bulk).alias("bulk"), v(cfrag).alias("cfrag"), (F.trim(drain) if drain else F.lit(None).cast("string")).alias("drain"))


def soil_database(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(components (unit, profile, share), layers (profile, top, bottom, sand, silt, clay, oc_pct, bulk, cfrag, drain)) of a soil and terrain database in one SQLite file on the driver's disk."""
    import sqlite3

    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        layers = con.execute("SELECT PRID, TopDep, BotDep, SDTO, STPC, CLPC, TOTC, BULK, CFRAG, Drain FROM SOTERparameterEstimates").fetchall()
        names = [r[1] for r in con.execute("PRAGMA table_info(SOTERunitComposition)")]
        units = [dict(zip(names, r, strict=True)) for r in con.execute("SELECT * FROM SOTERunitComposition")]
    finally:
        con.close()
    positive = lambda v: None if number(v) is None or number(v) < 0 else number(v)
    rows = [(p, *[positive(x) for x in (top, bottom, sand, silt, clay)], None if positive(carbon) is None else positive(carbon) / 10, positive(bulk), positive(stones), drain or None) for p, top, bottom, sand, silt, clay, carbon, bulk, stones, drain in layers]
    parts = [(str(u["NEWSUID"]), u.get(f"PRID{k}"), number(u.get(f"PROP{k}"))) for u in units for k in range(1, 11) if u.get(f"PRID{k}")]
    return (
        spark.createDataFrame(parts, "unit string, profile string, share double"),
        spark.createDataFrame(rows, "profile string, top double, bottom double, sand double, silt double, clay double, oc_pct double, bulk double, cfrag double, drain string"),
    )


# fixed values: properties in names of depth layers, what their numbers are divided by, and the columns they become
LAYERS = {"sand": (10.0, "sand"), "silt": (10.0, "silt"), "clay": (10.0, "clay"), "soc": (100.0, "oc_pct"), "bdod": (100.0, "bulk"), "cfvo": (10.0, "cfrag")}


def depth_layers(spark: SparkSession, folder: str) -> list[tuple[str, float, float, str]]:
    """(property, top, bottom, path) of files named ``sand_0-5cm_mean.tif`` and the like; of one layer the mean is preferred to the median."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found: dict[tuple, tuple] = {}
    for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p):
        m = re.fullmatch(r"(sand|silt|clay|soc|bdod|cfvo)_(\d+)-(\d+)cm_(mean|q0\.5)\.(?:tif|tiff)", f.getPath().getName(), re.I)
        if m:
            key = (m[1].lower(), float(m[2]), float(m[3]))
            found[key] = max(found.get(key, ("", "")), ("b" if m[4].lower() == "mean" else "a", f.getPath().toString()))
    return sorted((*k, v[1]) for k, v in found.items())


def depth_mean(layers: list[tuple[float, float, DataFrame]], top: float, bottom: float) -> DataFrame:
    """(r, c, z): per cell the mean of depth layers (top, bottom, cells) weighted by their overlap with the interval, over the layers the cell has."""
    parts = None
    for t, b, cells in layers:
        w = min(bottom, b) - max(top, t)
        if w > 0:
            own = cells.select("r", "c", "z", F.lit(float(w)).alias("w"))
            parts = own if parts is None else parts.union(own)
    if parts is None:
        raise ValueError("no layer overlaps the interval")
    return parts.groupBy("r", "c").agg((F.sum(F.col("w") * F.col("z")) / F.sum("w")).alias("z"))


def points(rows: DataFrame, info: GridInfo, x: str = "x", y: str = "y", source: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pour points (fid, x, y, source_id and the other columns), those outside the grid) of rows with coordinates; rows without an ``fid`` are numbered by x, then y, then source."""
    from ..operators.ranks import numbered

    own = rows.withColumn("x", F.col(x).cast("double")).withColumn("y", F.col(y).cast("double")).withColumn("source_id", F.col(source).cast("string") if source else F.lit(None).cast("string"))
    if "fid" not in rows.columns:
        own, _ = numbered(own, [F.col("x"), F.col("y"), F.col("source_id")], "fid")
    inside = F.coalesce(F.col("x").between(info.x0, info.x0 + info.cols * info.cw) & F.col("y").between(info.y0 - info.rows * info.ch, info.y0), F.lit(False))
    return own.filter(inside), own.filter(~inside)


def points_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(fid, x, y, attributes): point features of GeoJSON files, of a multipoint its first vertex."""
    doc = spark.read.option("multiLine", True).schema("features array<struct<id:string,geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").json(path)
    f = doc.select(F.explode("features").alias("f")).filter(F.col("f.geometry.type").isin("Point", "MultiPoint"))
    flat = F.split(F.regexp_replace("f.geometry.coordinates", r"[\[\]\s]", ""), ",")
    return f.select(F.col("f.id").try_cast("long").alias("fid"), flat[0].try_cast("double").alias("x"), flat[1].try_cast("double").alias("y"), F.col("f.properties").alias("attributes"))


def lines_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, feature, part, pos, x, y, attributes): vertices of line features of GeoJSON files; features and their parts are numbered in the order of the files' names, over all files."""
    from ..operators.ranks import numbered

    doc = spark.read.option("multiLine", True).schema("features array<struct<geometry:struct<type:string,coordinates:string>,properties:map<string,string>>>").json(path)
    f = doc.select(F.input_file_name().alias("file"), F.posexplode("features").alias("feature", "f")).filter(F.col("f.geometry.type").isin("LineString", "MultiLineString"))
    many = F.when(F.col("f.geometry.type") == "LineString", F.concat(F.lit("["), F.col("f.geometry.coordinates"), F.lit("]"))).otherwise(F.col("f.geometry.coordinates"))
    parts = f.select("file", "feature", F.col("f.properties").alias("attributes"), F.posexplode(F.from_json(many, "array<array<array<double>>>")).alias("p", "line"))
    numbers, _ = numbered(parts, [F.col("file"), F.col("feature"), F.col("p")], "part", 0)
    features, _ = numbered(parts.select("file", "feature").distinct(), [F.col("file"), F.col("feature")], "number", 0)
    v = numbers.join(features, ["file", "feature"]).select("file", F.col("number").alias("feature"), "part", "attributes", F.posexplode("line").alias("pos", "v"))
    return v.select("file", "feature", "part", "pos", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"), "attributes")
