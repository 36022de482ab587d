"""Queries over raster files, warps, interval layers, and routing with cycles; with their SQL equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import projection
from ..operators import graph, intervals, stencil
from ..sources import packages, prepare, raster
from ..sources.grids import GRID_SQL, GridInfo, grid, info_of, scratch, table
from .terrain import D8, NB, PAIRS, ctes, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- files --------------------------------------------------------------------------------------------


@query(f"SELECT r, c, z FROM ({GRID_SQL['dem_orders']})")
def raster_cells(spark, sf_dir):
    """The grid written as TIFF files, a task each, and read back by their blocks."""
    cells = grid(spark, sf_dir, "dem_orders")
    folder = f"{scratch(spark)}/tiles-{uuid.uuid4().hex}"
    raster.write_folder(cells, info_of(cells), "z", folder, size=512, tile=64, epsg=32737).count()
    return raster.read_grid(spark, folder, run_bytes=1 << 16)[0].select("r", "c", "z")


# --- warps --------------------------------------------------------------------------------------------

WEST, NORTH = 240_000.0, 9_900_000.0
#: near the same place in the zone to the west
TO_WEST, TO_NORTH = 907_860.0, 9_899_400.0


def _poly(table, argument: str, kind: str) -> str:
    """A series of the transverse Mercator projection as SQL, over columns xi and eta (or chi)."""
    terms = []
    for k, a in enumerate(projection._at_n(table), 1):
        terms.append(f"{a!r} * " + {"x": f"cos({2 * k} * {argument}) * sinh({2 * k} * eta)", "y": f"sin({2 * k} * {argument}) * cosh({2 * k} * eta)", "lat": f"sin({2 * k} * {argument})"}[kind])
    return "(" + " + ".join(terms) + ")"


_A, _E = projection.SCALE * projection.RECTIFYING, projection.ECCENTRICITY
WARP_SQL = f"""WITH g AS ({GRID_SQL['dem_orders']}), d AS (SELECT CAST(max(r) + 1 AS INT) AS nr, CAST(max(c) + 1 AS INT) AS nc FROM g),
t AS (SELECT CAST(i AS INT) AS r, CAST(j AS INT) AS c, {TO_WEST} + (j + 0.5) * 30.0 AS x, {TO_NORTH} - (i + 0.5) * 30.0 AS y FROM d, range(nr + 40) AS a(i), range(nc + 40) AS b(j)),
e AS (SELECT r, c, (x - 500000.0) / {_A!r} AS eta, (y - 10000000.0) / {_A!r} AS xi FROM t),
f AS (SELECT r, c, eta - {_poly(projection.INVERSE, 'xi', 'x')} AS across, xi - {_poly(projection.INVERSE, 'xi', 'y')} AS along FROM e),
h AS (SELECT r, c, asin(sin(along) / cosh(across)) AS chi, 33.0 + degrees(atan2(sinh(across), cos(along))) AS lon FROM f),
l AS (SELECT r, c, radians(lon - 39.0) AS away, sin(chi + {_poly(projection.LATITUDE, 'chi', 'lat')}) AS s FROM h),
m AS (SELECT r, c, away, sinh(atanh(s) - {_E!r} * atanh({_E!r} * s)) AS q FROM l),
n AS (SELECT r, c, atan2(q, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + q * q)) AS eta FROM m),
o AS (SELECT r, c, 500000.0 + {_A!r} * (eta + {_poly(projection.FORWARD, 'xi', 'x')}) AS x, 10000000.0 + {_A!r} * (xi + {_poly(projection.FORWARD, 'xi', 'y')}) AS y FROM n),
p AS (SELECT r, c, (x - {WEST}) / 30.0 - 0.5 AS fc, ({NORTH} - y) / 30.0 - 0.5 AS fr FROM o),
u AS (SELECT p.r, p.c, g.z, (1 - abs(g.r - fr)) * (1 - abs(g.c - fc)) AS w, g.r = floor(fr + 0.5) AND g.c = floor(fc + 0.5) AS here FROM p JOIN g ON g.r IN (CAST(floor(fr) AS INT), CAST(floor(fr) AS INT) + 1) AND g.c IN (CAST(floor(fc) AS INT), CAST(floor(fc) AS INT) + 1))
SELECT r, c, round(sum(w * z) / sum(w), 3) AS z FROM u GROUP BY r, c HAVING bool_or(here)"""


@query(WARP_SQL)
def warp_zones(spark, sf_dir):
    """The grid, put at the western edge of zone 37 south, on a grid of zone 36 south."""
    cells = grid(spark, sf_dir, "dem_orders")
    own = info_of(cells)
    source = GridInfo(own.rows, own.cols, WEST, NORTH, 30.0, 30.0)
    target = GridInfo(own.rows + 40, own.cols + 40, TO_WEST, TO_NORTH, 30.0, 30.0)
    return prepare.warp_between(cells, source, target, 32737, 32736).select("r", "c", F.round("z", 3).alias("z"))


# --- packages -----------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT 'X' || CAST(s_suppkey AS VARCHAR) AS outlet_uid, CAST(s_suppkey * 12.5 AS DOUBLE) AS chainage_m, CAST(s_suppkey % 900 AS DOUBLE) AS snap_dist_m FROM supplier),
k AS (SELECT 'X' || CAST(s_suppkey AS VARCHAR) AS outlet_uid, CAST(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END AS INT) AS truncated, CAST(s_acctbal AS DOUBLE) AS area_km2 FROM supplier WHERE s_suppkey % 7 <> 0),
f AS (SELECT c.outlet_uid, chainage_m, 3 AS severity, 'area.open' AS finding FROM c JOIN k USING (outlet_uid) WHERE truncated = 1 UNION ALL SELECT outlet_uid, chainage_m, 1, 'outlet.far' FROM c WHERE snap_dist_m > 75)
SELECT outlet_uid, chainage_m, CAST(severity AS INT) AS severity, finding, 'F' || lpad(CAST(row_number() OVER (ORDER BY severity DESC, chainage_m, outlet_uid, finding) AS VARCHAR), CAST(greatest(3, length(CAST(count(*) OVER () AS VARCHAR))) AS INT), '0') AS finding_id FROM f""")
def pkg_written_findings(spark, sf_dir):
    """A package written from a table and read back: its register."""
    s = table(spark, sf_dir, "supplier").withColumn("outlet_uid", F.concat(F.lit("X"), F.col("s_suppkey").cast("string")))
    crossings = s.select("outlet_uid", (F.col("s_suppkey") * 12.5).cast("double").alias("chainage_m"), (F.col("s_suppkey") % 900).cast("double").alias("snap_dist_m"))
    catchments = s.filter("s_suppkey % 7 <> 0").select("outlet_uid", F.when(F.col("s_acctbal") < 0, 1).otherwise(0).alias("truncated"), F.col("s_acctbal").cast("double").alias("area_km2"))
    path = packages.write_package({"crossings": crossings, "catchments": catchments, "flowpaths": catchments.select("outlet_uid")}, f"{scratch(spark)}/package-{uuid.uuid4().hex}")
    return packages.findings(spark, path, 30.0).select("outlet_uid", "chainage_m", "severity", "finding", "finding_id")


# --- intervals ------------------------------------------------------------------------------------------

REACHES = """SELECT o_orderkey AS reach, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 7 END AS INT) AS road, CAST(o_orderkey * 2.5 AS DOUBLE) AS a0,
  CAST(o_orderkey * 2.5 + CASE WHEN o_orderkey % 11 = 0 THEN 0.0 WHEN o_orderkey % 97 = 0 THEN 400.0 WHEN o_orderkey % 13 = 0 THEN -5.0 ELSE 2.5 * (o_custkey % 4) END AS DOUBLE) AS a1 FROM orders"""
STRIPS = """SELECT c_custkey AS strip, CAST(c_custkey % 7 AS INT) AS road, CAST(c_custkey * 25.0 AS DOUBLE) AS b0, CAST(c_custkey * 25.0 + CASE WHEN c_custkey % 10 = 0 THEN 0.0 WHEN c_custkey % 301 = 0 THEN 3000.0 ELSE 2.5 * (c_nationkey % 9) END AS DOUBLE) AS b1 FROM customer"""


def layers(spark, sf_dir):
    own = lambda sql, name: spark.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=table(spark, sf_dir, name))
    return own(REACHES, "orders"), own(STRIPS, "customer")


@query(f"WITH a AS ({REACHES}), b AS ({STRIPS}) SELECT road, reach, strip, greatest(a0, b0) AS overlap_start, least(a1, b1) AS overlap_end FROM a JOIN b USING (road) WHERE a1 > a0 AND b1 > b0 AND a0 < b1 AND b0 < a1")
def interval_overlaps(spark, sf_dir):
    """Reaches of roads that share ground with strips along them; a third of the reaches are on one road."""
    reaches, strips = layers(spark, sf_dir)
    return intervals.overlaps(reaches, strips, ("a0", "a1"), ("b0", "b1"), ("road",)).select("road", "reach", "strip", "overlap_start", "overlap_end")


@query(f"WITH a AS ({REACHES}), b AS ({STRIPS}) SELECT reach, CAST(count(strip) AS BIGINT) AS n_strips, round(coalesce(sum(CASE WHEN strip IS NOT NULL THEN least(a1, b1) - greatest(a0, b0) END), 0), 6) AS shared_m FROM a LEFT JOIN b ON a.road = b.road AND a1 >= a0 AND b1 >= b0 AND a0 <= b1 AND b0 <= a1 GROUP BY reach")
def interval_shares(spark, sf_dir):
    """How many strips each reach meets or touches, and the length it shares with them."""
    reaches, strips = layers(spark, sf_dir)
    met = intervals.overlaps(reaches, strips, ("a0", "a1"), ("b0", "b1"), ("road",), closed=True)
    sums = met.groupBy("reach").agg(F.count("*").alias("n_strips"), F.sum(F.col("overlap_end") - F.col("overlap_start")).alias("shared_m"))
    return rounded(reaches.select("reach").join(sums, "reach", "left").select("reach", F.coalesce("n_strips", F.lit(0).cast("long")).alias("n_strips"), F.coalesce("shared_m", F.lit(0.0)).alias("shared_m")))


# --- cycles ---------------------------------------------------------------------------------------------

#: where four cells turn round, in directions E, S, N, W of their block
LOOP = "(r % 9 IN (4, 5) AND c % 11 IN (4, 5))"
TURN = "CASE WHEN r % 9 = 4 AND c % 11 = 4 THEN 0 WHEN r % 9 = 4 THEN 2 WHEN c % 11 = 4 THEN 6 ELSE 4 END"


@query(f"""WITH RECURSIVE {ctes('dem_part')}, {PAIRS}, {D8}, w AS (SELECT cell_id AS id, r, c, CAST(CASE WHEN {LOOP} THEN {TURN} ELSE dir END AS INT) AS dir FROM flow),
n AS (SELECT w.id, h.id AS parent FROM w JOIN {NB} ON nb.k = w.dir JOIN w h ON h.r = w.r + nb.dr AND h.c = w.c + nb.dc), up AS (SELECT id AS src, parent AS dst FROM n UNION SELECT up.src, n.parent FROM up JOIN n ON n.id = up.dst),
acc AS (SELECT dst AS id, count(*) AS n, max(CASE WHEN src = dst THEN 1 ELSE 0 END) AS round FROM up GROUP BY dst)
SELECT w.id AS cell_id, CASE WHEN round = 1 THEN NULL ELSE CAST(coalesce(n, 0) AS DOUBLE) END AS acc, CASE WHEN round = 1 THEN 1 ELSE 0 END AS in_cycle FROM w LEFT JOIN acc ON acc.id = w.id""")
def flow_cycles(spark, sf_dir):
    """Accumulation where planted receivers run in circles, over tiles of five cells; their own cells have none."""
    cells = grid(spark, sf_dir, "dem_part")
    info = info_of(cells)
    flow = stencil.d8(cells, info).select("r", "c", F.expr(f"CASE WHEN {LOOP} THEN {TURN} ELSE dir END").cast("int").alias("dir"))
    got = graph.flow_accumulation(flow, info, tile=5)
    return got.select(F.col("id").alias("cell_id"), "acc", F.col("acc").isNull().cast("int").alias("in_cycle"))
