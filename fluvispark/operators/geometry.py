"""Vector geometry of zones: outlines of cell masks, rasterised polygons and lines.

Outlines are traced in tiles (``rings``); only what is one cell of a result, a geometry's bytes, comes together.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import GridInfo
from . import rings


def outline(mask: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Of a small mask, the plain way: closed rings of grid corners (row, col) around 4-connected cells, the cells on the right-hand side; corners where two cells touch split rings."""
    step: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, c in mask:
        for inside, a, b in (((r - 1, c), (r, c), (r, c + 1)), ((r, c + 1), (r, c + 1), (r + 1, c + 1)), ((r + 1, c), (r + 1, c + 1), (r + 1, c)), ((r, c - 1), (r + 1, c), (r, c))):
            if inside not in mask:
                step.setdefault(a, []).append(b)
    rings = []
    for start in sorted(step):
        while step.get(start):
            ring, at, before = [start], step[start].pop(0), start
            while at != start:
                ring.append(at)
                ways = step[at]
                if len(ways) > 1:  # keep to the cell the edge belongs to: turn right
                    d = (at[0] - before[0], at[1] - before[1])
                    right = (at[0] + d[1], at[1] - d[0])
                    ways.sort(key=lambda w: w != right)
                before, at = at, ways.pop(0)
            rings.append([p for i, p in enumerate(ring) if not _straight(ring[i - 1], p, ring[(i + 1) % len(ring)])])
    return rings


def _straight(a: tuple[int, int], b: tuple[int, int], c: tuple[int, int]) -> bool:
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])


def signed_area(ring: list[tuple[float, float]]) -> float:
    """Shoelace area of (x, y) vertices, positive when anticlockwise."""
    x, y = np.array(ring, float).T
    return float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y) / 2)


def zone_outlines(member: DataFrame, info: GridInfo, tile: int = 256) -> DataFrame:
    """(outlet, ring, part, hole, area_m2, xs, ys): a row a ring of the zones of ``member`` (outlet, r, c); see ``rings.trace``. A ring's vertices are one row; with ``trace`` itself they are a table."""
    found, vertices = rings.trace(member, info, tile)
    corner = lambda name, column, v: F.transform("corners", lambda p: column(p[v])).alias(name)
    whole = vertices.groupBy("outlet", "ring").agg(F.array_sort(F.collect_list(F.struct("pos", "r", "c"))).alias("corners"))
    xy = whole.select(F.col("outlet").alias("z"), F.col("ring").alias("k"), corner("xs", lambda c: F.lit(info.x0) + c * info.cw, "c"), corner("ys", lambda r: F.lit(info.y0) - r * info.ch, "r"))
    both = found.join(xy, found["outlet"].eqNullSafe(F.col("z")) & (found["ring"] == F.col("k")))
    return both.select("outlet", "ring", "part", "hole", (F.abs("cells") * (info.cw * info.ch)).alias("area_m2"), "xs", "ys")


def zone_polygons(member: DataFrame, info: GridInfo, tile: int = 256) -> DataFrame:
    """(outlet, area_m2, n_parts, n_holes, n_vertices, wkb): the cells of each zone of ``member`` (outlet, r, c) as one multipolygon; the area is exact.

    Parts are 4-connected, largest first, each with its holes. Only the rings' vertices, whose bytes are the result, come together by zone.
    """
    outlines = zone_outlines(member, info, tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hole", "area_m2", "ring"], ascending=[True, False, True])
        parts: dict[int, list] = {}
        for part, xs, ys in zip(pdf["part"].tolist(), pdf["xs"].tolist(), pdf["ys"].tolist(), strict=True):
            parts.setdefault(part, []).append(list(zip(xs, ys, strict=True)))
        return pd.DataFrame({"outlet": [key[1]], "n_parts": [len(parts)], "n_holes": [int(pdf.hole.sum())], "n_vertices": [sum(len(x) + 1 for x in pdf["xs"])], "wkb": [wkb_multipolygon(list(parts.values()))]})

    kind = member.schema["outlet"].dataType.simpleString()
    shapes = outlines.withColumn("none", F.col("outlet").isNull()).groupBy("none", "outlet").applyInPandas(run, f"outlet {kind}, n_parts int, n_holes int, n_vertices int, wkb binary")
    areas = member.select("outlet", "r", "c").distinct().groupBy(F.col("outlet").alias("z")).agg((F.count("*") * (info.cw * info.ch)).alias("area_m2"))
    return shapes.join(areas, F.col("outlet").eqNullSafe(F.col("z"))).select("outlet", "area_m2", "n_parts", "n_holes", "n_vertices", "wkb")


def path_lines(paths: DataFrame, info: GridInfo, key: str = "outlet", down: bool = True) -> DataFrame:
    """(key, n_vertices, length_m, wkb): lines through the cell centres of paths (key, pos, id); ``down``, from the greatest pos to the least."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", ascending=not down)
        r, c = np.divmod(pdf.id.to_numpy(), info.cols)
        x, y = info.x0 + (c + 0.5) * info.cw, info.y0 - (r + 0.5) * info.ch
        return pd.DataFrame({key: [k[0]], "n_vertices": [len(x)], "length_m": [float(np.hypot(np.diff(x), np.diff(y)).sum())], "wkb": [wkb_line(list(zip(x.tolist(), y.tolist(), strict=True)))]})

    kind = paths.schema[key].dataType.simpleString()
    return paths.select(key, "pos", "id").groupBy(key).applyInPandas(run, f"{key} {kind}, n_vertices int, length_m double, wkb binary")


def rasterize(edges: DataFrame, info: GridInfo) -> DataFrame:
    """(zone, r, c): cells whose centre is inside, by the even-odd rule, of polygons given by edges (zone, x0, y0, x1, y1).

    Each edge crosses the centre lines of its rows once, half-open in y; crossings left of a centre decide its parity.
    """
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    # row r has its centre at y0 - (r + 0.5) ch; those with low <= y < high
    first = F.floor((F.lit(info.y0) - high) / info.ch - 0.5) + 1
    last = F.floor((F.lit(info.y0) - low) / info.ch - 0.5)
    rows = edges.withColumn("a", F.greatest(F.lit(0), first).cast("int")).withColumn("b", F.least(F.lit(info.rows - 1), last).cast("int")).filter("a <= b")
    rows = rows.withColumn("r", F.explode(F.sequence("a", "b"))).withColumn("yc", info.y(F.col("r")))
    x = F.col("x0") + (F.col("yc") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    cuts = rows.select("zone", "r", x.alias("x")).groupBy("zone", "r").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    # between the 1st and 2nd crossing, the 3rd and 4th, ...
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1), lambda k: F.struct(F.get("xs", 2 * k).alias("lo"), F.get("xs", 2 * k + 1).alias("hi")))
    spans = cuts.filter("size(xs) >= 2").select("zone", "r", F.explode(pairs).alias("s"))
    c0 = F.greatest(F.lit(0), F.ceil((F.col("s.lo") - info.x0) / info.cw - 0.5 - 1e-12)).cast("int")
    c1 = F.least(F.lit(info.cols - 1), F.ceil((F.col("s.hi") - info.x0) / info.cw - 0.5 - 1e-12) - 1).cast("int")
    spans = spans.select("zone", "r", c0.alias("c0"), c1.alias("c1")).filter("c0 <= c1")
    return spans.select("zone", "r", F.explode(F.sequence("c0", "c1")).alias("c")).distinct()


def paint(edges: DataFrame, info: GridInfo) -> DataFrame:
    """(r, c, zone): one zone a cell, the greatest of those that hold its centre; polygons are given by edges, zones by their order."""
    return rasterize(edges, info).groupBy("r", "c").agg(F.max("zone").alias("zone"))


def edges_of(polygons: DataFrame, zone: str = "zone", wkb: str = "wkb") -> DataFrame:
    """(zone, x0, y0, x1, y1) of polygons or multipolygons in well-known binary."""

    def run(batches):
        for pdf in batches:
            rows = []
            for z, blob in zip(pdf.zone.tolist(), pdf.wkb.tolist(), strict=True):
                if blob is None:
                    continue
                kind, body = parse_wkb(bytes(blob))
                for part in [body] if kind == "Polygon" else body if kind == "MultiPolygon" else []:
                    for ring in part:
                        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
                        rows += [(z, *p, *q) for p, q in zip(closed, closed[1:], strict=False)]
            yield pd.DataFrame(rows, columns=["zone", "x0", "y0", "x1", "y1"])

    kind = polygons.schema[zone].dataType.simpleString()
    return polygons.select(F.col(zone).alias("zone"), F.col(wkb).alias("wkb")).mapInPandas(run, f"zone {kind}, x0 double, y0 double, x1 double, y1 double")


def window_of(cells: DataFrame, info: GridInfo, pad: int = 1) -> DataFrame:
    """(zone, r0, r1, c0, c1): the padded window of each zone's cells (zone, r, c), ends exclusive, clamped to the grid."""
    got = cells.groupBy("zone").agg(F.min("r").alias("a"), F.max("r").alias("b"), F.min("c").alias("x"), F.max("c").alias("y"))
    clamp = lambda v, hi: F.greatest(F.lit(0), F.least(F.lit(hi), v)).cast("int")
    return got.select("zone", clamp(F.col("a") - pad, info.rows).alias("r0"), clamp(F.col("b") + 1 + pad, info.rows).alias("r1"), clamp(F.col("x") - pad, info.cols).alias("c0"), clamp(F.col("y") + 1 + pad, info.cols).alias("c1"))


def _contour_length(f: np.ndarray, cw: float, ch: float) -> np.ndarray:
    """The length of the line at 0.5 through each square of four values, the line being straight between its crossings of the sides.

    Of the two ways through a square whose opposite corners are high, the low ones are kept apart.
    """
    a, b, c, d = f[:-1, :-1], f[:-1, 1:], f[1:, 1:], f[1:, :-1]
    up = [x >= 0.5 for x in (a, b, c, d)]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = lambda p, q: np.clip(np.nan_to_num((0.5 - p) / (q - p), nan=0.5), 0, 1)
        # where the line meets the upper, right, lower and left side
        x = np.stack([t(a, b), np.ones_like(a), t(d, c), np.zeros_like(a)])
        y = np.stack([np.zeros_like(a), t(b, c), np.ones_like(a), t(a, d)])
    meets = np.stack([up[0] != up[1], up[1] != up[2], up[2] != up[3], up[3] != up[0]])
    span = lambda i, j: np.hypot((x[i] - x[j]) * cw, (y[i] - y[j]) * ch)
    total = np.zeros_like(a)
    two = meets.sum(axis=0) == 2
    for i in range(4):
        for j in range(i):
            total += np.where(two & meets[i] & meets[j], span(i, j), 0)
    four = meets.all(axis=0)
    # high corners a and c, or b and d: the line cuts off the two low (or high) corners of one diagonal
    total += np.where(four & ~up[0], span(0, 3) + span(1, 2), 0) + np.where(four & up[0], span(0, 1) + span(2, 3), 0)
    return total


def perimeters(member: DataFrame, info: GridInfo, tile: int = 256) -> DataFrame:
    """(outlet, perimeter_m): the outline of each zone's cells (outlet, r, c), smoothed by a 3 x 3 mean and followed at one half; holes add theirs. A tile at a time."""
    halo = 3
    near = lambda v: F.explode(F.sequence(F.expr(f"cast(floor(({v} - {halo}) / {tile}) as int)"), F.expr(f"cast(floor(({v} + {halo}) / {tile}) as int)")))
    kind = member.schema["outlet"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((tile + 2 * halo, tile + 2 * halo))
        m[pdf.r.to_numpy() - key[1] * tile + halo, pdf.c.to_numpy() - key[2] * tile + halo] = 1
        mean = sum(m[1 + i : m.shape[0] - 1 + i, 1 + j : m.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
        # squares whose upper left cell is the tile's
        own = mean[halo - 1 : halo + tile, halo - 1 : halo + tile]
        return pd.DataFrame({"outlet": [key[0]], "length": [float(_contour_length(own, info.cw, info.ch).sum())]})

    dealt = member.select("outlet", "r", "c").distinct().withColumn("tr", near("r")).withColumn("tc", near("c"))
    return dealt.groupBy("outlet", "tr", "tc").applyInPandas(run, f"outlet {kind}, length double").groupBy("outlet").agg(F.sum("length").alias("perimeter_m"))


def densify(lines: DataFrame, step: float) -> DataFrame:
    """(line, pos, x, y): points of lines (line, pos, x, y) at most ``step`` apart, vertices kept."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("line").orderBy("pos")
    seg = lines.withColumn("x1", F.lead("x").over(w)).withColumn("y1", F.lead("y").over(w))
    n = F.when(F.col("x1").isNull(), 1).otherwise(F.greatest(F.ceil(F.sqrt((F.col("x1") - F.col("x")) ** 2 + (F.col("y1") - F.col("y")) ** 2) / step), F.lit(1)))
    at = seg.withColumn("n", n.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    out = at.select("line", F.col("pos").alias("_p"), "k", F.when(F.col("k") == 0, F.col("x")).otherwise(F.col("x") + t * (F.col("x1") - F.col("x"))).alias("x"), F.when(F.col("k") == 0, F.col("y")).otherwise(F.col("y") + t * (F.col("y1") - F.col("y"))).alias("y"))
    return out.select("line", (F.row_number().over(Window.partitionBy("line").orderBy("_p", "k")) - 1).alias("pos"), "x", "y")


def ring_centroid(ring: list[tuple[float, float]]) -> tuple[float, float]:
    """The centre of gravity of a ring's area; of its vertices where it has none."""
    x, y = np.array(ring, float).T
    x2, y2 = np.roll(x, -1), np.roll(y, -1)
    cross = x * y2 - x2 * y
    if abs(cross.sum()) < 1e-12:
        return float(x.mean()), float(y.mean())
    return float(((x + x2) * cross).sum() / (3 * cross.sum())), float(((y + y2) * cross).sum() / (3 * cross.sum()))


def along(line: list[tuple[float, float]], share: float) -> tuple[float, float]:
    """The point at a share of a line's length."""
    x, y = np.array(line, float).T
    at = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))))
    return float(np.interp(share * at[-1], at, x)), float(np.interp(share * at[-1], at, y))


def label_point(polygon: list[list[tuple[float, float]]]) -> tuple[float, float]:
    """A point inside a polygon: its outer ring's centroid if that is inside and in no hole, else the middle of the widest stretch of the line through the ring's mid-height."""
    outer, holes = polygon[0], polygon[1:]
    at = ring_centroid(outer)
    if _within(at, outer) and not any(_within(at, h) for h in holes):
        return at
    ys = sorted({p[1] for ring in polygon for p in ring})
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2
    cuts = sorted(x0 + (y - y0) * (x1 - x0) / (y1 - y0) for ring in polygon for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True) if (y0 <= y) != (y1 <= y))
    a, b = max(zip(cuts[::2], cuts[1::2], strict=False), key=lambda s: s[1] - s[0])
    return (a + b) / 2, y


def line_cells(a: tuple[int, int], b: tuple[int, int]) -> list[tuple[int, int]]:
    """The 8-connected cells of a straight line (Bresenham), both ends included; halves stay with the start."""
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    if not n:
        return [a]
    place = lambda p, q, k: p + (1 if q >= p else -1) * -((n - 2 * k * abs(q - p)) // (2 * n))
    return [(place(a[0], b[0], k), place(a[1], b[1], k)) for k in range(n + 1)]


# --- well-known binary ------------------------------------------------------------------------------


def wkb_point(x: float, y: float) -> bytes:
    return struct.pack("<BIdd", 1, 1, x, y)


def wkb_line(points: list[tuple[float, float]]) -> bytes:
    return struct.pack("<BII", 1, 2, len(points)) + b"".join(struct.pack("<dd", *p) for p in points)


def wkb_polygon(rings: list[list[tuple[float, float]]]) -> bytes:
    """Rings are closed here if they are not."""
    out = struct.pack("<BII", 1, 3, len(rings))
    for ring in rings:
        closed = ring if ring[0] == ring[-1] else [*ring, ring[0]]
        out += struct.pack("<I", len(closed)) + b"".join(struct.pack("<dd", *p) for p in closed)
    return out


def wkb_multipolygon(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(wkb_polygon(p) for p in parts)


def parse_wkb(blob: bytes):
    """('Point', (x, y)), ('LineString', points), ('Polygon', rings) or ('MultiPolygon', polygons), of either byte order."""
    return _parse(blob, 0)[0]


def _parse(blob: bytes, at: int):
    e = "<" if blob[at] else ">"
    (kind,), at = struct.unpack_from(e + "I", blob, at + 1), at + 5

    def points(at: int, n: int):
        v = struct.unpack_from(f"{e}{2 * n}d", blob, at)
        return list(zip(v[::2], v[1::2], strict=True)), at + 16 * n

    if kind == 1:
        p, at = points(at, 1)
        return ("Point", p[0]), at
    (n,), at = struct.unpack_from(e + "I", blob, at), at + 4
    if kind == 2:
        p, at = points(at, n)
        return ("LineString", p), at
    if kind not in (3, 6):
        raise ValueError(f"geometry type {kind}")
    parts = []
    for _ in range(n):
        if kind == 6:
            part, at = _parse(blob, at)
            parts.append(part[1])
        else:
            (m,), at = struct.unpack_from(e + "I", blob, at), at + 4
            part, at = points(at, m)
            parts.append(part)
    return ("Polygon" if kind == 3 else "MultiPolygon", parts), at
