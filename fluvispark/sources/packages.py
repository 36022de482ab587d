"""Packages and folders on disk: layers as Parquet data sets, features as GeoJSON, erosion layers as rasters; all written and read by tasks.

A package is a folder with a data set for each layer, one for the dictionary of fields and one for the run's metadata. The metadata are written last, so a folder without
them is not a package yet, whatever broke off before.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hydrology as H
from ..operators import geometry, linear, package, review
from . import raster
from .grids import GridInfo

VERSION = "1.0"
META, FIELDS = "run_metadata", "field_dictionary"


def write_package(layers: dict[str, DataFrame], path: str, values: dict | None = None, wkt: str | None = None, version: str = VERSION) -> str:
    """Check the layers' keys and links (an error stops it) and write them, further layers and tables among them as they are; ``wkt``, if given, must be a projected system in metres."""
    if wkt is not None and H.crs_problem(wkt)[1]:
        raise package.PackageError(H.crs_problem(wkt)[1])
    package.check(layers)
    spark = layers["crossings"].sparkSession
    for name, layer in layers.items():
        if name in (META, FIELDS) or not name.isidentifier():
            raise package.PackageError(f"a layer can't be called {name!r}")
        layer.write.mode("overwrite").parquet(f"{path}/{name}")
    package.dictionary(layers).write.mode("overwrite").parquet(f"{path}/{FIELDS}")
    code = H.crs_problem(wkt)[0] if wkt else None
    known = {"schema_version": version, "layers": sorted(layers), "n_crossings": str(layers["crossings"].count()), "crs_epsg": "" if code is None else str(code), "crs_wkt": wkt or ""}
    package.metadata(spark, {**(values or {}), **known}).write.mode("overwrite").parquet(f"{path}/{META}")
    return path


def read_package(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(layers, metadata) of a package; an error if it is not one."""
    try:
        values = {r.key: r.value for r in spark.read.parquet(f"{path}/{META}").collect()}  # some ten rows
    except Exception as e:
        raise package.PackageError(f"no package at {path}: {e.__class__.__name__}") from e
    return {name: spark.read.parquet(f"{path}/{name}") for name in json.loads(values["layers"])}, values


def problems(spark: SparkSession, path: str) -> list[str]:
    """``package.validate`` of a package on disk."""
    layers, values = read_package(spark, path)
    return package.validate(layers, values.get("schema_version", ""))


def road(spark: SparkSession, path: str) -> DataFrame | None:
    """The road's segments, rebuilt from a package's layer ``road`` (part, pos, x, y and perhaps chainage_from_m); None if it has none. Parts with a single vertex are left out."""
    layers, _ = read_package(spark, path)
    if "road" not in layers:
        return None
    vertices = layers["road"]
    start = vertices.agg(F.min("chainage_from_m").alias("s")).first().s if "chainage_from_m" in vertices.columns else None
    whole = vertices.join(vertices.groupBy("part").count().filter("count > 1"), "part", "left_semi")
    return linear.alignment(whole.select("part", "pos", "x", "y"), start=start or 0.0)


def sensitivity_points(spark: SparkSession, path: str, info: GridInfo) -> DataFrame:
    """(outlet_uid, x, y, r, c) of a package's crossings that exist (not ``proposed``) and lie on the grid: at the input point, or the outlet where that is unknown."""
    layers, _ = read_package(spark, path)
    own = layers["crossings"].filter("coalesce(status, '') <> 'proposed'") if "status" in layers["crossings"].columns else layers["crossings"]
    own = own.select("outlet_uid", F.coalesce("input_x", "outlet_x").alias("x"), F.coalesce("input_y", "outlet_y").alias("y"))
    return own.withColumn("r", info.row(F.col("y"))).withColumn("c", info.col(F.col("x"))).filter(F.col("r").between(0, info.rows - 1) & F.col("c").between(0, info.cols - 1))


# --- features -----------------------------------------------------------------------------------------


def _geometry(blob: bytes | None) -> str:
    if blob is None:
        return "null"
    kind, parts = geometry.parse_wkb(bytes(blob))
    return json.dumps({"type": kind, "coordinates": parts})


def write_features(rows: DataFrame, path: str, wkb: str | None = None, x: str | None = None, y: str | None = None, fid: str | None = None) -> str:
    """Features of ``rows`` as GeoJSON, a feature collection for each partition: geometry from well-known binary or from coordinates, the other columns as properties (NaN is null)."""
    shape = F.col(wkb) if wkb else F.lit(None).cast("binary")
    point = F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates")))) if x else F.lit(None).cast("string")
    clean = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes if c not in (wkb, x, y, fid) and t != "binary"]
    properties = F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}) if clean else F.lit("{}")
    parts = rows.select(shape.alias("shape"), point.alias("point"), properties.alias("properties"), (F.to_json(F.array(fid)) if fid else F.lit(None).cast("string")).alias("fid"))

    def run(batches):
        begun = False
        for pdf in batches:
            out = []
            for blob, at, values, number in zip(pdf["shape"].tolist(), pdf["point"].tolist(), pdf["properties"].tolist(), pdf["fid"].tolist(), strict=True):
                key = "" if number is None else f'"id": {number[1:-1]}, '
                shown = at if at is not None else _geometry(blob)
                out.append(f'{"," if begun or out else ""}{{"type": "Feature", {key}"properties": {values}, "geometry": {shown}}}')
            if not begun:
                out.insert(0, '{"type": "FeatureCollection", "features": [')
            begun = True
            yield pd.DataFrame({"value": out})
        if begun:
            yield pd.DataFrame({"value": ["]}"]})

    parts.mapInPandas(run, "value string").write.mode("overwrite").text(path)
    return path


# --- erosion folders --------------------------------------------------------------------------------------

EROSION_LAYERS = ("ln_spi", "ls", "twi", "slope", "a_loss", "k_factor", "c_factor", "p_factor", "channel", "sti")


def write_erosion(cells: DataFrame, info: GridInfo, folder: str, run: dict, epsg: int | None = None, size: int = 2048) -> str:
    """The layers of ``EROSION_LAYERS`` that ``cells`` (r, c, ...) has, as folders of rasters, and the run's settings (class schemes, weights) beside them, last."""
    spark = cells.sparkSession
    have = [n for n in EROSION_LAYERS if n in cells.columns]
    for name in have:
        own = cells.select("r", "c", F.col(name).cast("double").alias(name)).filter(F.col(name).isNotNull())
        raster.write_folder(own, info, name, f"{folder}/{name}", size=size, epsg=epsg)
    raster.put(spark, f"{folder}/run.json", json.dumps({**run, "layers": have}, sort_keys=True).encode())
    return folder


def read_erosion(spark: SparkSession, folder: str, info: GridInfo) -> tuple[DataFrame, dict]:
    """(cells (r, c, and a column for each layer), the run's settings) of a folder of ``write_erosion``; an error if it is none, or a layer lies on another grid than ``info``."""
    try:
        run = json.loads(raster.take(spark, f"{folder}/run.json"))
    except Exception as e:
        raise ValueError(f"no erosion folder at {folder}: {e.__class__.__name__}") from e
    cells = None
    for name in run["layers"]:
        found = raster.headers(spark, f"{folder}/{name}").collect()  # a row a file
        for h in found:
            near = abs(h.cw - info.cw) <= 1e-6 * info.cw and abs(h.ch - info.ch) <= 1e-6 * info.ch
            r, c = (info.y0 - h.y0) / info.ch, (h.x0 - info.x0) / info.cw
            if not near or abs(r - round(r)) > 1e-3 or abs(c - round(c)) > 1e-3 or not (0 <= round(r) and round(r) + h.rows <= info.rows and 0 <= round(c) and round(c) + h.cols <= info.cols):
                raise ValueError(f"{name} is on another grid")
        own = raster.cells_of(spark, [h.path for h in found], origin=(info.x0, info.y0)).select("r", "c", F.col("z").alias(name))
        cells = own if cells is None else cells.join(own, ["r", "c"], "full")
    if cells is None:
        raise ValueError("the folder has no layer")
    return cells.withColumn("channel", F.coalesce(F.col("channel") > 0, F.lit(False))) if "channel" in cells.columns else cells, run


def findings(spark: SparkSession, path: str, cell_m: float) -> DataFrame:
    """The register of a package on disk: its crossings with the figures of their catchments and flow paths, by ``review.package_findings``."""
    layers, _ = read_package(spark, path)
    rows = layers["crossings"]
    for name in package.LAYERS[1:]:
        if name in layers:
            more = [c for c in layers[name].columns if c not in rows.columns]
            rows = rows.join(layers[name].select("outlet_uid", *more), "outlet_uid", "left")
    return review.package_findings(rows, cell_m)
