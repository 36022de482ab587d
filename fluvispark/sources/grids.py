"""Cell tables: loading, georeferencing, tiling and conversion to dense tiles.

A grid is a table (r INT, c INT, cell_id BIGINT, z DOUBLE, more variables); a NoData cell is a missing
row or a null z. ``GridInfo`` is its georeference: rows grow southwards, ``ch`` is positive.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GridInfo:
    rows: int
    cols: int
    x0: float = 0.0
    y0: float = 0.0
    cw: float = 30.0
    ch: float = 30.0

    @property
    def cell_area_km2(self) -> float:
        return self.cw * self.ch / 1e6

    def x(self, c: Column) -> Column:
        return F.lit(self.x0) + (c + 0.5) * F.lit(self.cw)

    def y(self, r: Column) -> Column:
        return F.lit(self.y0) - (r + 0.5) * F.lit(self.ch)

    def col(self, x: Column) -> Column:
        return F.floor((x - F.lit(self.x0)) / F.lit(self.cw)).cast("int")

    def row(self, y: Column) -> Column:
        return F.floor((F.lit(self.y0) - y) / F.lit(self.ch)).cast("int")


def info_of(cells: DataFrame, cw: float = 30.0, ch: float = 30.0) -> GridInfo:
    got = cells.agg(F.max("r").alias("r"), F.max("c").alias("c")).first()
    return GridInfo((got.r if got.r is not None else -1) + 1, (got.c if got.c is not None else -1) + 1, cw=cw, ch=ch)


def scratch(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset: the warehouse (an error if that is a local folder), or on a single machine (master ``local``) a folder of our own, deleted at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house.startswith("file:") or house.startswith("/"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on each machine's own disk")
        return f"{house}/_fluvispark"
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="fluvispark-grid-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return _OWN["dir"]


_OWN: dict[str, str] = {}


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class State:
    """The state of a loop, written to the shared folder at each step: cuts its lineage durably. What the step before wrote is deleted."""

    def __init__(self, label: str) -> None:
        self.label, self.path = label, ""

    def put(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        path = f"{scratch(spark)}/{self.label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.drop(spark)
        self.path = path
        return spark.read.schema(df.schema).parquet(path)

    def drop(self, spark: SparkSession) -> None:
        if self.path:
            delete(spark, self.path)
        self.path = ""


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back; it stays there as long as the folder."""
    return State(label).put(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Grids derived from the test tables; each text also runs in the SQL oracle.
GRID_SQL = {
    "dem_part": """SELECT p_partkey AS cell_id, CAST(floor(p_partkey / 50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
  CAST(200.0 + 1.5 * abs(CAST(p_partkey % 50 AS INT) - 20) - 2.0 * floor(p_partkey / 50) + 1.5 * ((p_partkey * 7919 + p_size * 31) % 7) AS DOUBLE) AS z FROM part""",
    "dem_orders": """SELECT o_orderkey AS cell_id, CAST(floor(o_orderkey / 100) AS INT) AS r, CAST(o_orderkey % 100 AS INT) AS c,
  CAST(500.0 + 0.75 * abs(CAST(o_orderkey % 100 AS INT) - 40) - 0.5 * floor(o_orderkey / 100) + (o_custkey % 5) * 0.25 AS DOUBLE) AS z FROM orders""",
    "dem_flat": """SELECT p_partkey AS cell_id, CAST(floor(p_partkey / 50) AS INT) AS r, CAST(p_partkey % 50 AS INT) AS c,
  CAST(floor((floor(p_partkey / 50) * -1.0 + 400.0 + 0.25 * (p_partkey % 50) + (p_size % 4)) / 4) AS DOUBLE) AS z FROM part WHERE p_size <> 13""",
    "attrs": """SELECT p_partkey AS cell_id,
  CASE p_type WHEN 'ECONOMY' THEN 10 WHEN 'SMALL' THEN 20 WHEN 'STANDARD' THEN 30 WHEN 'MEDIUM' THEN 40 WHEN 'LARGE' THEN 50 ELSE 60 END AS lc_class,
  CAST(p_size % 4 + 1 AS INT) AS hsg, p_brand AS soil_unit, CAST(400.0 + 8.0 * (p_retailprice - 900.0) AS DOUBLE) AS map_mm FROM part""",
    "soil_units": """SELECT p_brand AS soil_unit, CAST(20 + min(p_partkey) % 50 AS DOUBLE) AS sand, CAST(5 + min(p_partkey) % 25 AS DOUBLE) AS clay,
  CAST(75 - min(p_partkey) % 50 - min(p_partkey) % 25 AS DOUBLE) AS silt, CAST(0.5 + (min(p_partkey) % 6) * 0.25 AS DOUBLE) AS oc_pct FROM part GROUP BY p_brand""",
    "outlets": """SELECT s_suppkey AS fid, CAST(5 + 10 * (s_suppkey % 10) AS DOUBLE) * 30.0 + 7.0 * floor(s_suppkey / 100) AS x, 0.0 - CAST(8 + 14 * floor((s_suppkey % 100) / 10) AS DOUBLE) * 30.0 AS y FROM supplier""",
    "stations": """SELECT CAST(floor(event_id / 500) AS INT) AS road, CAST(event_id % 500 AS DOUBLE) * 10.0 AS chainage_m, value AS z_dem_m, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS stream FROM events""",
}
BASE_TABLE = {"dem_part": "part", "dem_orders": "orders", "dem_flat": "part", "attrs": "part", "soil_units": "part", "outlets": "supplier", "stations": "events"}


def grid(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the derived tables of ``GRID_SQL``."""
    base = BASE_TABLE[name]
    return spark.sql(GRID_SQL[name].replace(f"FROM {base}", "FROM {src}"), src=table(spark, sf_dir, base))
