"""Queries over the derived grids: terrain, routing, drainage; with their SQL equivalents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drainage, fill, graph, stencil
from ..sources.grids import GRID_SQL, GridInfo, cut, grid, info_of

ROUND = 6
# the rows (k, dr, dc, rank) of the eight directions
NB = "(VALUES (0, 0, 1, 3), (1, 1, 1, 4), (2, 1, 0, 0), (3, 1, -1, 5), (4, 0, -1, 1), (5, -1, -1, 6), (6, -1, 0, 2), (7, -1, 1, 7)) AS nb(k, dr, dc, rank)"


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six decimals, negative zero to zero."""
    return df.select(*[(F.round(F.col(n), ROUND) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def dem(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, GridInfo]:
    cells = grid(spark, sf_dir, name)
    return cells, info_of(cells)


QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def ctes(name: str) -> str:
    return f"g AS ({GRID_SQL[name]}), dims AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM g)"


PAIRS = f"pair AS (SELECT a.cell_id, a.r, a.c, a.z, nb.k, nb.rank, b.cell_id AS nid, b.z AS zn, CASE WHEN dr <> 0 AND dc <> 0 THEN sqrt(1800.0) ELSE 30.0 END AS d FROM g a, {NB}, g b WHERE b.r = a.r + dr AND b.c = a.c + dc)"
D8 = """best AS (SELECT cell_id, max((z - zn) / d) AS m FROM pair GROUP BY cell_id),
d8 AS (SELECT p.cell_id, arg_min(p.k, p.rank) AS dir, arg_min(p.nid, p.rank) AS parent, max(m) AS m FROM pair p JOIN best USING (cell_id) WHERE m > 0 AND (p.z - p.zn) / p.d >= m * (1 - 1e-6) GROUP BY p.cell_id),
flow AS (SELECT g.cell_id, g.r, g.c, g.z, d8.dir, d8.parent, d8.m FROM g LEFT JOIN d8 USING (cell_id))"""
HORN = """edge AS (SELECT g.cell_id, g.z AS z0, dr.d AS dr, dc.d AS dc, n.z AS zn FROM g, dims, (VALUES (-1), (0), (1)) dr(d), (VALUES (-1), (0), (1)) dc(d)
 LEFT JOIN g n ON n.r = least(greatest(g.r + dr.d, 0), nr - 1) AND n.c = least(greatest(g.c + dc.d, 0), nc - 1)),
horn AS (SELECT cell_id, CASE WHEN count(zn) = 9 THEN sum(CASE WHEN dc = 0 THEN 0.0 ELSE dc * (2 - abs(dr)) * zn END) / 240.0 END AS dzdx,
 CASE WHEN count(zn) = 9 THEN sum(CASE WHEN dr = 0 THEN 0.0 ELSE dr * (2 - abs(dc)) * zn END) / 240.0 END AS dzdy FROM edge GROUP BY cell_id)"""
CLOSURE = "up AS (SELECT cell_id AS src, parent AS dst, 1 AS depth FROM flow WHERE parent IS NOT NULL UNION ALL SELECT up.src, flow.parent, depth + 1 FROM up JOIN flow ON flow.cell_id = up.dst WHERE flow.parent IS NOT NULL)"
ACC = "acc AS (SELECT flow.cell_id, count(up.src) AS acc FROM flow LEFT JOIN up ON up.dst = flow.cell_id GROUP BY flow.cell_id)"


@query(f"WITH {ctes('dem_flat')} SELECT a.r, a.c, CAST(CASE WHEN count(b.z) < 8 THEN 1 ELSE 0 END AS INT) AS boundary FROM g a CROSS JOIN {NB} LEFT JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c")
def grid_boundary_cells(spark, sf_dir):
    return stencil.boundary(dem(spark, sf_dir, "dem_flat")[0]).select("r", "c", "boundary")


@query(f"WITH {ctes('dem_part')} SELECT CAST(floor(r / 4) AS INT) AS br, CAST(floor(c / 4) AS INT) AS bc, min(z) AS z_min, count(*) AS n_cells FROM g GROUP BY 1, 2")
def grid_block_min(spark, sf_dir):
    return stencil.block_min(dem(spark, sf_dir, "dem_part")[0], 4)


@query(f"WITH {ctes('dem_part')} SELECT CAST(floor(r / 5) AS INT) AS br, CAST(floor(c / 5) AS INT) AS bc, round(avg(z), 6) AS z FROM g GROUP BY 1, 2")
def grid_downsample(spark, sf_dir):
    return rounded(stencil.downsample(dem(spark, sf_dir, "dem_part")[0], "z", 5))


@query(f"WITH {ctes('dem_part')}, m AS (SELECT r, c FROM g WHERE z > 230) SELECT DISTINCT m.r + dr.d AS r, m.c + dc.d AS c FROM m, dims, (VALUES (-1), (0), (1)) dr(d), (VALUES (-1), (0), (1)) dc(d) WHERE m.r + dr.d BETWEEN 0 AND nr - 1 AND m.c + dc.d BETWEEN 0 AND nc - 1")
def grid_dilate_square(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_part")
    return stencil.dilate(cells.filter("z > 230"), stencil.square(1), info)


@query(f"WITH {ctes('dem_part')}, o AS (SELECT dr.d AS dr, dc.d AS dc FROM (VALUES (-2), (-1), (0), (1), (2)) dr(d), (VALUES (-2), (-1), (0), (1), (2)) dc(d) WHERE dr.d * dr.d + dc.d * dc.d <= 4), m AS (SELECT r, c FROM g WHERE z > 235) SELECT DISTINCT m.r + dr AS r, m.c + dc AS c FROM m, o, dims WHERE m.r + dr BETWEEN 0 AND nr - 1 AND m.c + dc BETWEEN 0 AND nc - 1")
def grid_dilate_disk(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_part")
    return stencil.dilate(cells.filter("z > 235"), stencil.disk(60.0, 30.0, 30.0), info)


@query(f"WITH {ctes('dem_part')} SELECT a.r, a.c, max(b.z) AS window_max FROM g a JOIN g b ON b.r BETWEEN a.r - 2 AND a.r + 2 AND b.c BETWEEN a.c - 2 AND a.c + 2 GROUP BY a.r, a.c")
def grid_window_max(spark, sf_dir):
    return stencil.window_max(dem(spark, sf_dir, "dem_part")[0], "z", 2)


@query(f"WITH {ctes('dem_orders')}, {HORN} SELECT r, c, round(sqrt(dzdx * dzdx + dzdy * dzdy), 6) AS slope FROM horn JOIN g USING (cell_id)")
def terrain_horn_slope(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    return rounded(stencil.horn(cells, info).select("r", "c", "slope"))


@query(f"WITH {ctes('dem_flat')}, {HORN} SELECT r, c, round(dzdx, 6) + 0.0 AS dzdx, round(dzdy, 6) + 0.0 AS dzdy FROM horn JOIN g USING (cell_id)")
def terrain_gradients_nodata(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_flat")
    return rounded(stencil.horn(cells, info).select("r", "c", "dzdx", "dzdy"))


@query(f"WITH {ctes('dem_orders')}, {HORN} SELECT r, c, round(greatest(0.0, (sin(radians(45.0)) - dzdx * cos(radians(45.0)) * sin(radians(315.0)) + dzdy * cos(radians(45.0)) * cos(radians(315.0))) / sqrt(1 + dzdx * dzdx + dzdy * dzdy)), 6) AS shade FROM horn JOIN g USING (cell_id)")
def terrain_hillshade(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    return rounded(stencil.hillshade(cells, info))


@query(f"WITH {ctes('dem_orders')}, {PAIRS}, s AS (SELECT cell_id, max(greatest(0.0, z - zn)) AS d FROM pair GROUP BY cell_id) SELECT round(avg(d), 6) AS mean_drop, count(*) AS n_cells FROM s")
def terrain_mean_drop(spark, sf_dir):
    return rounded(stencil.mean_drop(*dem(spark, sf_dir, "dem_orders")))


@query(f"""WITH {ctes('dem_flat')}, {PAIRS}, rel AS (SELECT g.cell_id, greatest(g.z, coalesce(max(zn), g.z)) - least(g.z, coalesce(min(zn), g.z)) AS rel FROM g LEFT JOIN pair USING (cell_id) GROUP BY g.cell_id, g.z)
SELECT count(*) AS n_pairs, CAST(coalesce(sum(CASE WHEN z = zn THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_tied FROM pair JOIN rel a ON a.cell_id = pair.cell_id JOIN rel b ON b.cell_id = nid WHERE k IN (0, 2) AND a.rel > 0.1 AND b.rel > 0.1""")
def audit_sloped_ties(spark, sf_dir):
    return stencil.sloped_ties(dem(spark, sf_dir, "dem_flat")[0])


@query(f"""WITH {ctes('dem_part')}, l AS (SELECT 'row' AS axis, r AS line, c AS pos, z FROM g UNION ALL SELECT 'col', c, r, z FROM g),
j AS (SELECT a.axis, a.line, count(*) AS n, CAST(sum(CASE WHEN a.z = b.z THEN 1 ELSE 0 END) AS BIGINT) AS n_equal, min(a.z) AS lo, max(a.z) AS hi FROM l a JOIN l b ON a.axis = b.axis AND a.pos = b.pos AND b.line = a.line - 1 GROUP BY 1, 2)
SELECT axis, line, n, n_equal, n >= 10 AND n_equal >= 0.99 * n AND lo < hi AS repeated FROM j""")
def audit_resampling_rows(spark, sf_dir):
    return stencil.repeated_lines(dem(spark, sf_dir, "dem_part")[0], least_overlap=10)


@query(f"""WITH {ctes('dem_part')}, q(q) AS (VALUES (CAST(1.0 AS DOUBLE)), (0.5), (0.25), (0.2), (0.1), (0.05), (0.02), (0.01)), e AS (SELECT 4 * pow(2.0, floor(log2(max(abs(z)))) - 23) AS e FROM g),
s AS (SELECT q, avg(CASE WHEN abs(z - round(z / q) * q) <= greatest(0.02 * q, e) THEN 1.0 ELSE 0.0 END) AS share FROM g, q, e GROUP BY q) SELECT max(CASE WHEN share >= 0.999 THEN q END) AS quantum FROM s""")
def audit_quantum(spark, sf_dir):
    return stencil.vertical_quantum(dem(spark, sf_dir, "dem_part")[0])


@query(f"""WITH {ctes('dem_part')}, h AS (SELECT CASE WHEN r = 3 AND c % 4 = 0 THEN CAST(-9999.0 AS DOUBLE) ELSE z END AS z FROM g), v(value) AS (VALUES (CAST(0.0 AS DOUBLE)), (-9999.0), (-32768.0), (CAST(-3.4028235e38 AS DOUBLE))),
s AS (SELECT value, CAST(sum(CASE WHEN z = value THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS total, min(CASE WHEN z <> value THEN z END) AS lo, max(CASE WHEN z <> value THEN z END) AS hi FROM h, v GROUP BY value)
SELECT value, n, round(n / total, 6) AS share, coalesce(n > 0.005 * total AND hi > lo AND lo - value > 0.25 * (hi - lo), false) AS suspect FROM s""")
def audit_nodata_suspects(spark, sf_dir):
    cells = dem(spark, sf_dir, "dem_part")[0].withColumn("z", F.expr("CASE WHEN r = 3 AND c % 4 = 0 THEN double(-9999.0) ELSE z END"))
    return stencil.nodata_suspects(cells).select("value", "n", F.round("share", ROUND).alias("share"), "suspect")


def routed(spark, sf_dir, name="dem_orders", conditioned=False):
    """(flow with acc and z, info): plain steepest descent, or filled and with resolved flats."""
    cells, info = dem(spark, sf_dir, name)
    if conditioned:
        surface = fill.fill_depressions(cells, info).select("r", "c", F.col("filled").alias("z"))
        plain = fill.resolve_flats(stencil.d8_surface(surface, info), info)
    else:
        plain = stencil.d8(cells, info)
    acc = graph.flow_accumulation(plain, info)
    return cut(acc.join(cells.select("r", "c", "z"), ["r", "c"]), "routed"), info


@query(f"WITH {ctes('dem_orders')}, {PAIRS}, {D8} SELECT r, c, CAST(dir AS INT) AS dir, CAST(CASE WHEN dir IS NULL THEN 0 ELSE 1 << dir END AS INT) AS code, round(m, 6) AS \"drop\" FROM flow")
def flow_d8_noflat(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_orders")
    got = stencil.d8(cells, info)
    return rounded(got.select("r", "c", "dir", F.coalesce(F.expr("shiftleft(1, dir)"), F.lit(0)).alias("code"), "drop"))


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC} SELECT cell_id, CAST(acc AS DOUBLE) AS acc FROM acc")
def flow_accumulation_count(spark, sf_dir):
    flow, _ = routed(spark, sf_dir)
    return flow.select(F.col("id").alias("cell_id"), "acc")


@query(f"WITH RECURSIVE {ctes('dem_part')}, w AS ({GRID_SQL['attrs']}), {PAIRS}, {D8}, {CLOSURE} SELECT flow.cell_id, CAST(coalesce(sum(w.hsg), 0) AS DOUBLE) AS acc FROM flow LEFT JOIN up ON up.dst = flow.cell_id LEFT JOIN w ON w.cell_id = up.src GROUP BY flow.cell_id")
def flow_accumulation_weighted(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_part")
    own = stencil.d8(cells, info).join(cells.select("r", "c", "cell_id"), ["r", "c"]).join(grid(spark, sf_dir, "attrs").select("cell_id", "hsg"), "cell_id")
    return graph.flow_accumulation(own, info, weight="hsg", tile=16).select(F.col("id").alias("cell_id"), "acc")


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC} SELECT cell_id, CAST(acc AS DOUBLE) AS acc FROM acc WHERE acc >= 50")
def drain_streams(spark, sf_dir):
    flow, _ = routed(spark, sf_dir)
    return drainage.streams(flow, threshold_cells=50).select(F.col("id").alias("cell_id"), "acc")


OUT = "outs AS (SELECT cell_id AS oid, 'X' || lpad(CAST(row_number() OVER (ORDER BY acc DESC, cell_id) AS VARCHAR), 3, '0') AS outlet FROM acc WHERE acc >= 20 QUALIFY row_number() OVER (ORDER BY acc DESC, cell_id) <= 12)"


def top_outlets(flow, n=12, least=20):
    """The n cells of greatest accumulation as nested outlets X001..."""
    best = flow.filter(F.col("acc") >= least).orderBy(F.desc("acc"), "id").limit(n)
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.orderBy(F.desc("acc"), "id"))  # at most n rows
    return best.select("id", F.concat(F.lit("X"), F.lpad(k.cast("string"), 3, "0")).alias("outlet"))


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, m AS (SELECT outlet, src FROM up JOIN outs ON up.dst = oid UNION ALL SELECT outlet, oid FROM outs) SELECT outlet, count(*) AS n_cells, CAST(sum(src) AS BIGINT) AS id_sum FROM m GROUP BY outlet")
def drain_catchment_full(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return drainage.catchments(flow, top_outlets(flow), full=True, info=info).groupBy("outlet").agg(F.count("*").alias("n_cells"), F.sum("id").alias("id_sum"))


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, m AS (SELECT outlet, src, depth FROM up JOIN outs ON up.dst = oid UNION ALL SELECT outlet, oid, 0 FROM outs), l AS (SELECT src, arg_min(outlet, depth) AS outlet FROM m GROUP BY src) SELECT outlet, count(*) AS n_cells, CAST(sum(src) AS BIGINT) AS id_sum FROM l GROUP BY outlet")
def drain_catchment_local(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return drainage.catchments(flow, top_outlets(flow), info=info).groupBy("outlet").agg(F.count("*").alias("n_cells"), F.sum("id").alias("id_sum"))


CHAR = """SELECT outlet, count(*) AS n_cells, round(count(*) * 900 / 1e6, 6) AS area_km2, max(z) AS elev_max_m, min(z) AS elev_min_m, round(avg(z), 6) AS elev_mean_m, max(z) - min(z) AS relief_m, round(avg(slope), 6) AS catch_slope_horn, round(quantile_cont(slope, 0.5), 6) AS slope_median"""


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, {HORN}, m AS (SELECT outlet, src FROM up JOIN outs ON up.dst = oid UNION ALL SELECT outlet, oid FROM outs) {CHAR} FROM m JOIN (SELECT cell_id, g.z, sqrt(dzdx * dzdx + dzdy * dzdy) AS slope FROM horn JOIN g USING (cell_id)) s ON s.cell_id = m.src GROUP BY outlet")
def zonal_characteristics(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    slope = stencil.horn(flow.select("r", "c", "z"), info)
    cells = flow.select("id", "r", "c", "z").join(slope, ["r", "c"])
    return rounded(drainage.characteristics(cells, drainage.catchments(flow, top_outlets(flow), full=True, info=info), info))


ROOT = "root AS (SELECT src AS id, arg_max(dst, depth) AS root FROM up GROUP BY src), member AS (SELECT flow.cell_id AS id, coalesce(root.root, flow.cell_id) AS root FROM flow LEFT JOIN root ON root.id = flow.cell_id), top AS (SELECT root, count(*) AS n FROM member GROUP BY root ORDER BY n DESC, root LIMIT 20), outs AS (SELECT root AS oid, 'X' || lpad(CAST(row_number() OVER (ORDER BY n DESC, root) AS VARCHAR), 3, '0') AS outlet FROM top)"


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ROOT}, {HORN} {CHAR} FROM member JOIN outs ON oid = member.root JOIN (SELECT cell_id, g.z, sqrt(dzdx * dzdx + dzdy * dzdy) AS slope FROM horn JOIN g USING (cell_id)) s ON s.cell_id = member.id GROUP BY outlet")
def flow_chain(spark, sf_dir):
    """Routing without flat resolution, then the catchments of the 20 largest terminal cells (interior pits included)."""
    flow, info = routed(spark, sf_dir)
    root = drainage.roots(flow, info)
    ends = top_outlets(flow.filter("parent is null"), n=20, least=0)
    member = root.join(ends.select(F.col("id").alias("root"), "outlet"), "root").select("outlet", "id")
    slope = stencil.horn(flow.select("r", "c", "z"), info)
    return rounded(drainage.characteristics(flow.select("id", "r", "c", "z").join(slope, ["r", "c"]), member, info))


LINK = "lk AS (SELECT cell_id, parent, CASE WHEN parent IS NULL THEN 0.0 WHEN dir % 2 = 1 THEN sqrt(1800.0) ELSE 30.0 END AS len FROM flow)"
UPLEN = f"{LINK}, ul AS (SELECT cell_id AS src, parent AS dst, len AS d FROM lk WHERE parent IS NOT NULL UNION ALL SELECT ul.src, lk.parent, d + len FROM ul JOIN lk ON lk.cell_id = ul.dst WHERE lk.parent IS NOT NULL)"


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {UPLEN} SELECT flow.cell_id, round(coalesce(max(d), 0), 6) AS up_len FROM flow LEFT JOIN ul ON ul.dst = flow.cell_id GROUP BY flow.cell_id")
def drain_upstream_length(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.upstream_lengths(flow, info).select(F.col("id").alias("cell_id"), "up_len"))


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, {UPLEN} SELECT outlet, round(max(d), 6) AS length_m FROM outs JOIN ul ON ul.dst = oid GROUP BY outlet")
def drain_longest_path(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.longest_paths(flow, top_outlets(flow), info).groupBy("outlet").agg(F.max("cum_m").alias("length_m")))


# the cells of each outlet's longest path, from the outlet up: at each the donor of the longest way, then of the greater accumulation, then the lesser id
PATHS = f"""{UPLEN}, ln AS (SELECT lk.cell_id AS id, lk.parent, len, coalesce(u.m, 0) AS up_len, acc.acc FROM lk LEFT JOIN (SELECT dst, max(d) AS m FROM ul GROUP BY dst) u ON u.dst = lk.cell_id JOIN acc ON acc.cell_id = lk.cell_id),
bd AS (SELECT parent AS id, id AS donor, len FROM ln WHERE parent IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parent ORDER BY round(up_len + len, 6) DESC, acc DESC, id) = 1),
pth AS (SELECT outlet, 0 AS pos, oid AS id, CAST(0 AS DOUBLE) AS cum FROM outs UNION ALL SELECT outlet, pos + 1, donor, cum + len FROM pth JOIN bd USING (id)),
pz AS (SELECT outlet, pos, pth.id, cum, z, acc, max(cum) OVER (PARTITION BY outlet) AS total FROM pth JOIN g ON g.cell_id = pth.id JOIN acc ON acc.cell_id = pth.id)"""


def along(rows: str, name: str) -> str:
    """Elevations at 10 and 85 % of the paths in ``rows`` (outlet, pos, cum, z, total), as tables ``name``."""
    at = lambda t: f"max(CASE WHEN cum <= {t} * total AND c2 > {t} * total THEN z + (z2 - z) * ({t} * total - cum) / (c2 - cum) END)"
    return f"{name} AS (SELECT outlet, max(total) AS length_m, {at(0.1)} AS z10, {at(0.85)} AS z85 FROM (SELECT *, lead(cum) OVER w AS c2, lead(z) OVER w AS z2 FROM {rows} WINDOW w AS (PARTITION BY outlet ORDER BY pos)) GROUP BY outlet)"


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, {PATHS}, {along('pz', 's')} SELECT outlet, round(length_m, 6) AS length_m, round(z10, 6) AS z10, round(z85, 6) AS z85, round(CASE WHEN length_m > 0 THEN (z85 - z10) / (0.75 * length_m) END, 6) AS slope_1085 FROM s")
def lfp_1085(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.slope_1085(drainage.longest_paths(flow, top_outlets(flow), info), flow))


@query(f"""WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {OUT}, {PATHS}, h AS (SELECT outlet, max(cum) AS hc, arg_max(z, cum) AS hz FROM pz WHERE acc >= 50 GROUP BY outlet),
e AS (SELECT outlet, max(cum) AS length_m, arg_max(z, cum) AS top, arg_min(z, cum) AS low FROM pz GROUP BY outlet), i AS (SELECT pz.outlet, pos, cum, z, max(cum) OVER (PARTITION BY pz.outlet) AS total FROM pz LEFT JOIN h USING (outlet) WHERE cum <= coalesce(hc, 0)), {along('i', 's')},
f AS (SELECT e.outlet, e.length_m, coalesce(hc, 0) AS channel_m, e.length_m - coalesce(hc, 0) AS over, top, low, hz, hc, s.length_m AS sl, z10, z85 FROM e LEFT JOIN h USING (outlet) LEFT JOIN s USING (outlet))
SELECT outlet, round(length_m, 6) AS length_m, round(channel_m, 6) AS channel_m, round(over, 6) AS overland_m, round(least(over, 100.0), 6) AS sheet_m, round(greatest(over - 100.0, 0.0), 6) AS shallow_m, round(CASE WHEN over > 0 THEN (top - coalesce(hz, low)) / over END, 6) AS overland_slope,
round(CASE WHEN channel_m > 0 THEN (hz - low) / channel_m END, 6) AS channel_slope, CAST(CASE WHEN hc IS NULL THEN 1 ELSE 0 END AS INT) AS no_channel, round(CASE WHEN channel_m > 0 THEN (z85 - z10) / (0.75 * sl) END, 6) AS channel_slope_1085 FROM f""")
def lfp_split(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.path_split(drainage.longest_paths(flow, top_outlets(flow), info), flow, flow, 50))


@query(f"""WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, s AS (SELECT cell_id FROM acc WHERE acc >= 50), c AS (SELECT src, dst, depth FROM up UNION ALL SELECT cell_id, cell_id, 0 FROM flow),
t AS (SELECT src, arg_min(dst, depth) AS dst FROM c JOIN s ON s.cell_id = c.dst GROUP BY src) SELECT flow.cell_id, round(flow.z - b.z, 6) + 0.0 AS hand FROM flow LEFT JOIN t ON t.src = flow.cell_id LEFT JOIN g b ON b.cell_id = t.dst""")
def drain_hand(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.hand(flow, flow, drainage.streams(flow, threshold_cells=50), info).select(F.col("id").alias("cell_id"), "hand"))


# stream cells with their stream receivers; orders that rise from 1 until they agree with those of the donors
NET = "s AS (SELECT cell_id FROM acc WHERE acc >= 20), net AS (SELECT flow.cell_id AS id, p.cell_id AS parent, flow.z, CASE WHEN p.cell_id IS NULL THEN 0.0 WHEN dir % 2 = 1 THEN sqrt(1800.0) ELSE 30.0 END AS len FROM flow JOIN s ON s.cell_id = flow.cell_id LEFT JOIN s p ON p.cell_id = flow.parent)"
ORDERS = """so(id, ord) USING KEY (id) AS (SELECT id, 1 FROM net UNION ALL (SELECT q.id, q.new FROM (SELECT n.parent AS id, CAST(max(o.ord) + CASE WHEN count(*) > 1 AND list_sort(list(o.ord), 'DESC')[2] = max(o.ord) THEN 1 ELSE 0 END AS INT) AS new
FROM (SELECT DISTINCT net.parent FROM so JOIN net ON net.id = so.id WHERE net.parent IS NOT NULL) c JOIN net n ON n.parent = c.parent JOIN recurring.so o ON o.id = n.id GROUP BY n.parent) q JOIN recurring.so old ON old.id = q.id WHERE q.new > old.ord))"""
REACHES = """nd AS (SELECT net.*, net.parent IS NULL OR coalesce(k.n, 0) <> 1 AS tail FROM net LEFT JOIN (SELECT parent, count(*) AS n FROM net WHERE parent IS NOT NULL GROUP BY parent) k ON k.parent = net.parent),
rw AS (SELECT id, id AS foot, tail, parent FROM nd UNION ALL SELECT rw.id, nd.id, nd.tail, nd.parent FROM rw JOIN nd ON nd.id = rw.parent WHERE NOT rw.tail), rr AS (SELECT id, foot AS reach FROM rw WHERE tail),
rl AS (SELECT reach, max(ord) AS "order", count(*) + max(CASE WHEN nd.id = reach AND nd.parent IS NOT NULL THEN 1 ELSE 0 END) AS n_cells, sum(len) AS length_m, max(nd.z) - max(CASE WHEN nd.id = reach THEN coalesce(p.z, nd.z) END) AS drop_m FROM rr JOIN nd USING (id) JOIN so USING (id) LEFT JOIN g p ON p.cell_id = nd.parent GROUP BY reach HAVING n_cells >= 2)"""


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {NET}, {ORDERS} SELECT id AS cell_id, CAST(ord AS INT) AS \"order\" FROM so")
def drain_strahler(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return drainage.strahler(flow, drainage.streams(flow, threshold_cells=20), info).select(F.col("id").alias("cell_id"), "order")


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {NET}, {ORDERS}, {REACHES} SELECT reach, CAST(\"order\" AS INT) AS \"order\", n_cells, round(length_m, 6) AS length_m, round(drop_m, 6) + 0.0 AS drop_m, round(drop_m / length_m, 6) + 0.0 AS slope FROM rl")
def drain_reaches(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.reaches(flow, flow, drainage.strahler(flow, drainage.streams(flow, threshold_cells=20), info), info))


@query(f"WITH RECURSIVE {ctes('dem_orders')}, {PAIRS}, {D8}, {CLOSURE}, {ACC}, {NET}, {ORDERS}, {REACHES} SELECT CAST(\"order\" AS INT) AS \"order\", count(*) AS n_reaches, round(sum(length_m), 6) AS length_m, round(avg(length_m), 6) AS mean_length_m, round(avg(drop_m / length_m), 6) AS mean_slope, round(sum(length_m) / 1000 / (any_value(nr) * any_value(nc) * 0.0009), 6) AS density_km_km2 FROM rl, dims GROUP BY \"order\"")
def network_summary(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    lines = drainage.reaches(flow, flow, drainage.strahler(flow, drainage.streams(flow, threshold_cells=20), info), info)
    return rounded(drainage.network_summary(lines, info.rows * info.cols * info.cell_area_km2))


SNAP = """p AS (SELECT fid, CAST(floor((0.0 - y) / 30.0) AS INT) AS r, CAST(floor(x / 30.0) AS INT) AS c FROM outlets_),
h AS (SELECT fid, p.r, p.c, g.r AS sr, g.c AS sc, row_number() OVER (PARTITION BY fid ORDER BY greatest(abs(g.r - p.r), abs(g.c - p.c)), acc.acc DESC, g.r, g.c) AS k FROM p JOIN g ON g.r BETWEEN p.r - 5 AND p.r + 5 AND g.c BETWEEN p.c - 5 AND p.c + 5 JOIN acc ON acc.cell_id = g.cell_id AND acc.acc >= 50)"""


@query(f"WITH RECURSIVE {ctes('dem_orders')}, outlets_ AS ({GRID_SQL['outlets']}), {PAIRS}, {D8}, {CLOSURE}, {ACC}, {SNAP} SELECT p.fid, p.r, p.c, coalesce(sr, p.r) AS snap_r, coalesce(sc, p.c) AS snap_c, round(30.0 * sqrt((coalesce(sr, p.r) - p.r) * (coalesce(sr, p.r) - p.r) + (coalesce(sc, p.c) - p.c) * (coalesce(sc, p.c) - p.c)), 6) AS moved_m FROM p LEFT JOIN (SELECT * FROM h WHERE k = 1) h USING (fid)")
def drain_snap(spark, sf_dir):
    flow, info = routed(spark, sf_dir)
    return rounded(drainage.snap(grid(spark, sf_dir, "outlets"), drainage.streams(flow, threshold_cells=50), info, 5))


FILL = """seed AS (SELECT g.cell_id, g.z FROM g LEFT JOIN pair USING (cell_id) GROUP BY g.cell_id, g.z HAVING count(nid) < 8),
f AS (SELECT cell_id, z AS f FROM seed UNION ALL (SELECT pair.nid, min(greatest(pair.zn, f.f + {eps})) FROM f JOIN pair ON pair.cell_id = f.cell_id LEFT JOIN recurring.f o ON o.cell_id = pair.nid WHERE o.f IS NULL OR greatest(pair.zn, f.f + {eps}) < o.f GROUP BY pair.nid))"""


def fill_sql(select: str, eps: str = "0.0") -> str:
    return f"WITH RECURSIVE {ctes('dem_part')}, {PAIRS}, {FILL.format(eps=eps)} {select}".replace("f AS (SELECT cell_id, z AS f FROM seed", "f USING KEY (cell_id) AS (SELECT cell_id, z AS f FROM seed").replace("f USING KEY (cell_id) AS", "f(cell_id, f) USING KEY (cell_id) AS")


@query(fill_sql("SELECT g.r, g.c, f.f AS filled, f.f > g.z AS raised FROM f JOIN g USING (cell_id)"))
def fill_depressions(spark, sf_dir):
    return fill.fill_depressions(*dem(spark, sf_dir, "dem_part")).select("r", "c", "filled", "raised")


@query(fill_sql("SELECT g.r, g.c, round(f.f - g.z, 6) AS depth FROM f JOIN g USING (cell_id)"))
def fill_depth(spark, sf_dir):
    return rounded(fill.fill_depth(fill.fill_depressions(*dem(spark, sf_dir, "dem_part"))))


@query(fill_sql("SELECT g.r, g.c, round(f.f, 6) AS filled FROM f JOIN g USING (cell_id)", eps="0.03"))
def fill_min_slope(spark, sf_dir):
    return rounded(fill.fill_depressions(*dem(spark, sf_dir, "dem_part"), min_slope=0.001, tile=16).select("r", "c", "filled"))


# cells under more than a centimetre of water, and the least cell of all that hang together
WET = "w AS (SELECT f.cell_id AS id, g.r, g.c, f.f - g.z AS depth FROM f JOIN g USING (cell_id) WHERE f.f - g.z > 0.01), wr AS (SELECT id, id AS root FROM w UNION SELECT y.id, wr.root FROM wr JOIN w x ON x.id = wr.id JOIN w y ON abs(y.r - x.r) <= 1 AND abs(y.c - x.c) <= 1), wc AS (SELECT id, min(root) AS component FROM wr GROUP BY id)"


@query(fill_sql("SELECT component, count(*) AS n_cells, round(max(depth), 6) AS max_depth, round(sum(depth), 6) AS sum_depth FROM wc JOIN w USING (id) GROUP BY component").replace(" SELECT component, count", f", {WET} SELECT component, count"))
def fill_components(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_part")
    got = fill.depression_labels(fill.fill_depth(fill.fill_depressions(cells, info)), info)
    return rounded(got.groupBy("component").agg(F.count("*").alias("n_cells"), F.max("depth").alias("max_depth"), F.sum("depth").alias("sum_depth")))


# cells without descent inside the grid, their neighbours, those beside a routed cell that is no higher (by preference ``first``), and layers of like cells from those on
FLATS = """edge AS (SELECT g.cell_id, count(nid) < 8 AS b FROM g LEFT JOIN pair USING (cell_id) GROUP BY g.cell_id), st AS (SELECT flow.*, b AND dir IS NULL AS drain FROM flow JOIN edge USING (cell_id)), fl AS (SELECT cell_id, z FROM st WHERE dir IS NULL AND NOT drain),
np AS (SELECT pair.cell_id AS a, k, nid AS b, pair.z AS za, zn AS zb, o.dir IS NOT NULL OR o.drain AS routed FROM pair JOIN fl USING (cell_id) JOIN st o ON o.cell_id = nid), outlet AS (SELECT a, arg_min(k, {first}) AS k FROM np WHERE routed AND zb <= za GROUP BY a),
d(id, l) USING KEY (id) AS (SELECT a, 1 FROM outlet UNION ALL (SELECT np.b, min(d.l) + 1 FROM d JOIN np ON np.a = d.id AND NOT np.routed AND np.za = np.zb LEFT JOIN recurring.d o ON o.id = np.b WHERE o.id IS NULL GROUP BY np.b))"""


@query(f"WITH RECURSIVE {ctes('dem_flat')}, {PAIRS}, {D8}, {FLATS.format(first='k')}, step AS (SELECT x.id, arg_min(np.k, y.l * 10 + np.k) AS k FROM d x JOIN np ON np.a = x.id AND NOT routed AND za = zb JOIN d y ON y.id = np.b WHERE y.l < x.l GROUP BY x.id) SELECT st.r, st.c, CAST(coalesce(st.dir, outlet.k, step.k) AS INT) AS dir FROM st LEFT JOIN outlet ON outlet.a = st.cell_id LEFT JOIN step ON step.id = st.cell_id")
def flats_toward(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_flat")
    return fill.resolve_flats(stencil.d8_surface(cells, info), info, method="toward").select("r", "c", "dir")


# layers away from higher ground within each flat, and its greatest; of the steps to a lesser mask the least, then straight ones, then W, NW, N, NE, E, SE, S, SW
BARNES = """high AS (SELECT DISTINCT np.a FROM np JOIN d ON d.id = np.a WHERE zb > za AND np.a NOT IN (SELECT a FROM outlet)),
aw(id, l) USING KEY (id) AS (SELECT a, 1 FROM high UNION ALL (SELECT np.b, min(aw.l) + 1 FROM aw JOIN np ON np.a = aw.id AND NOT np.routed AND np.za = np.zb JOIN d ON d.id = np.b LEFT JOIN recurring.aw o ON o.id = np.b WHERE o.id IS NULL GROUP BY np.b)),
lb AS (SELECT id, id AS root FROM d UNION SELECT np.b, lb.root FROM lb JOIN np ON np.a = lb.id AND NOT routed AND za = zb JOIN d ON d.id = np.b), co AS (SELECT id, min(root) AS root FROM lb GROUP BY id),
he AS (SELECT root, max(aw.l) AS h FROM co JOIN aw USING (id) GROUP BY root), mk AS (SELECT d.id, 2 * d.l + CASE WHEN aw.l IS NOT NULL THEN h - aw.l ELSE 0 END AS m FROM d JOIN co USING (id) LEFT JOIN aw USING (id) LEFT JOIN he USING (root)),
step AS (SELECT x.id, arg_min(np.k, y.m * 100 + np.k % 2 * 10 + (np.k + 4) % 8) AS k FROM mk x JOIN np ON np.a = x.id AND NOT routed AND za = zb JOIN mk y ON y.id = np.b WHERE y.m < x.m GROUP BY x.id)"""


@query(f"WITH RECURSIVE {ctes('dem_flat')}, {PAIRS}, {D8}, {FLATS.format(first='k % 2 * 10 + (k + 4) % 8')}, {BARNES} SELECT st.r, st.c, CAST(coalesce(st.dir, outlet.k, step.k) AS INT) AS dir FROM st LEFT JOIN outlet ON outlet.a = st.cell_id LEFT JOIN step ON step.id = st.cell_id")
def flats_barnes(spark, sf_dir):
    cells, info = dem(spark, sf_dir, "dem_flat")
    return fill.resolve_flats(stencil.d8_surface(cells, info), info).select("r", "c", "dir")


def on_filled(text: str) -> str:
    """Tables over ``g`` and ``pair`` as tables over the filled surface."""
    return re.sub(r"\bpair\b", "pairf", re.sub(r"\bg\b", "gf", text))


ROUTED = f"""gf AS (SELECT g.cell_id, g.r, g.c, f.f AS z FROM g JOIN f USING (cell_id)), {on_filled(PAIRS)}, {on_filled(D8)}, {on_filled(FLATS.format(first='k % 2 * 10 + (k + 4) % 8'))}, {on_filled(BARNES)},
fd AS (SELECT st.cell_id, st.r, st.c, CAST(coalesce(st.dir, outlet.k, step.k) AS INT) AS dir FROM st LEFT JOIN outlet ON outlet.a = st.cell_id LEFT JOIN step ON step.id = st.cell_id),
fp AS (SELECT fd.cell_id, dir, q.cell_id AS parent FROM fd LEFT JOIN {NB} ON nb.k = fd.dir LEFT JOIN gf q ON q.r = fd.r + nb.dr AND q.c = fd.c + nb.dc), fu AS (SELECT cell_id AS src, parent AS dst FROM fp WHERE parent IS NOT NULL UNION ALL SELECT fu.src, fp.parent FROM fu JOIN fp ON fp.cell_id = fu.dst WHERE fp.parent IS NOT NULL)"""


@query(fill_sql("SELECT 1").replace(" SELECT 1", f", {ROUTED} SELECT fp.cell_id, fp.dir, CAST(count(fu.src) AS DOUBLE) AS acc FROM fp JOIN fu ON fu.dst = fp.cell_id GROUP BY fp.cell_id, fp.dir HAVING count(fu.src) >= 100"))
def flow_chain_conditioned(spark, sf_dir):
    """Fill, descent, flats, accumulation: the cells of greatest accumulation."""
    flow, _ = routed(spark, sf_dir, "dem_part", conditioned=True)
    return flow.filter("acc >= 100").select(F.col("id").alias("cell_id"), "dir", "acc")
