"""Outlines of zones as rings, traced in tiles and joined across them; no step gathers a zone.

Every side of a cell beyond which the zone ends is a directed edge with the cell on its left; what follows it is known from the four cells around its end. Within a tile the edges are strung to chains,
from where the outline enters the tile to where it leaves. Chains point at the chain that follows, so a ring is a cycle of chains; doubling these pointers finds each cycle's least edge, which names the
ring, and each chain's distance to it, which orders its vertices. Where two cells meet at a corner the outline keeps to its cell, so that such cells are separate parts;
where one ring comes by such a corner twice it is split there (the strings between do not cross, so all corners are split at once), and rings never touch themselves.

A ring's area is the sum of its edges' shares: positive for outer rings (anticlockwise), negative for holes. Each horizontal run of cells links the ring at its left end with that at its right end; the rings so
linked bound one 4-connected part, which has one outer ring: its holes are the others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import GridInfo, State, cut
from .graph import components
from .stencil import TILE

# sides of a cell in the order of left turns: top heading west, left heading south, bottom heading east, right heading north
HEADING = ((0, -1), (1, 0), (0, 1), (-1, 0))
OUTSIDE = ((-1, 0), (0, -1), (1, 0), (0, 1))
#: from a cell's row and column to its side's end, a grid corner
END = ((0, 0), (1, 0), (1, 1), (0, 1))
CHAIN, CORNER, VERTEX, RUN = range(4)


def strung(follow: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of its chain, steps from it) of each item of a partial permutation ``follow`` (-1: none); cycles begin at the item of least ``key``."""
    n = len(follow)
    before = np.full(n, -1)
    has = np.flatnonzero(follow >= 0)
    before[follow[has]] = has
    first, steps = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
    for _ in range(max(1, n).bit_length() + 1):
        steps = steps + np.where(first != np.arange(n), steps[first], 0)
        first = first[first]
    cycle = before[first] >= 0
    if cycle.any():
        at = np.flatnonzero(cycle)
        least, off, ahead, span = key[at], np.zeros(len(at), np.int64), np.searchsorted(at, follow[at]), 1
        while span < 2 * len(at):  # the least key of ever longer stretches ahead, and how far it is
            other = least[ahead]
            off = np.where(other < least, span + off[ahead], off)
            least, ahead, span = np.minimum(least, other), ahead[ahead], 2 * span
        order = np.argsort(key[at])
        root = order[np.searchsorted(key[at], least, sorter=order)]
        total = np.bincount(root, minlength=len(at))[root]
        first[at], steps[at] = at[root], (total - off) % total
    return first, steps


def _tile_edges(r: np.ndarray, c: np.ndarray, top: int, left: int, cols: int, tile: int, split: np.ndarray):
    """Edges of a tile's own cells: (numbers, rows, columns, sides, numbers of what follows, corner kinds); cells given with a halo of one, ``split``: edges that turn right at their end's corner."""
    mask = np.zeros((tile + 2, tile + 2), bool)
    mask[r - top + 1, c - left + 1] = True
    own = mask[1:-1, 1:-1]
    parts = []
    for side, (dr, dc) in enumerate(OUTSIDE):
        i, j = np.nonzero(own & ~mask[1 + dr : tile + 1 + dr, 1 + dc : tile + 1 + dc])
        hr, hc = HEADING[side]
        ahead, beyond = mask[i + 1 + hr, j + 1 + hc], mask[i + 1 + hr + dr, j + 1 + hc + dc]
        edge = ((i + top).astype(np.int64) * cols + (j + left)) * 4 + side
        pinch = ~ahead & beyond
        turn = pinch & np.isin(edge, split)
        right, straight = (ahead & beyond) | turn, ahead & ~beyond
        go_r, go_c = np.where(right, hr + dr, np.where(straight, hr, 0)), np.where(right, hc + dc, np.where(straight, hc, 0))
        then = np.where(right, (side + 3) % 4, np.where(straight, side, (side + 1) % 4))
        follow = ((i + top + go_r).astype(np.int64) * cols + (j + left + go_c)) * 4 + then
        parts.append((edge, i + top, j + left, np.full(len(i), side), follow, pinch, straight))
    return mask, [np.concatenate([p[k] for p in parts]) for k in range(7)]


OUT = "kind int, a long, b long, n long, m long, o long, area long, corners int, r int, c int"


def _traced(member: DataFrame, split: DataFrame, info: GridInfo, tile: int) -> DataFrame:
    """Chains, pinched corners, vertices and runs of every tile, rows of one written table told apart by ``kind``."""
    zone = member.schema["outlet"].dataType.simpleString()
    near = lambda v: F.explode(F.sequence(F.expr(f"cast(greatest({v} - 1, 0) div {tile} as int)"), F.expr(f"cast(({v} + 1) div {tile} as int)")))
    dealt = member.select("outlet", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).distinct().withColumn("tr", near("r")).withColumn("tc", near("c"))
    # a null zone is a zone as well
    dealt, split = (d.withColumn("none", F.col("outlet").isNull()) for d in (dealt, split))
    across = -(-info.cols // tile) + 2

    def run(key: tuple, pdf: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["outlet", *[x.split()[0] for x in OUT.split(", ")]])
        tr, tc = int(key[-2]), int(key[-1])
        mask, (edge, r, c, side, follow, pinch, straight) = _tile_edges(pdf.r.to_numpy(), pdf.c.to_numpy(), tr * tile, tc * tile, info.cols, tile, chosen.edge.to_numpy(np.int64))
        if not len(edge):
            return _runs(mask, tr, tc, tile, across, lambda i, j, s: None, key)
        order = np.argsort(edge)
        edge, r, c, side, follow, pinch, straight = (x[order] for x in (edge, r, c, side, follow, pinch, straight))
        at = np.searchsorted(edge, follow)
        inside = (at < len(edge)) & (edge[np.minimum(at, len(edge) - 1)] == follow)
        at = np.where(inside, at, -1)
        first, steps = strung(at, edge)
        share = np.where(side == 3, c + 1, np.where(side == 1, -c, 0))
        rows = []
        # chains: a first edge, b what follows the last, n edges, m least edge, o steps to it
        by = np.lexsort((steps, first))
        heads, start = np.unique(first[by], return_index=True)
        ends = np.append(start[1:], len(by)) - 1
        least = np.minimum.reduceat(edge[by], start)
        rows.append(pd.DataFrame({"kind": CHAIN, "a": edge[heads], "b": follow[by[ends]], "n": ends - start + 1, "m": least, "o": steps[np.searchsorted(edge, least)], "area": np.add.reduceat(share[by], start), "corners": np.add.reduceat(~straight[by], start), "r": 0, "c": 0}))
        # what ends at a corner where cells meet crosswise: a its chain, b the edge, n the corner
        end = np.array(END)[side]
        vr, vc = r + end[:, 0], c + end[:, 1]
        p = np.flatnonzero(pinch)
        rows.append(pd.DataFrame({"kind": CORNER, "a": edge[first[p]], "b": edge[p], "n": vr[p].astype(np.int64) * (info.cols + 1) + vc[p], "m": 0, "o": 0, "area": 0, "corners": 0, "r": r[p], "c": c[p]}))
        # vertices where the outline turns: a the chain, o the steps of the edge that ends there
        v = np.flatnonzero(~straight)
        rows.append(pd.DataFrame({"kind": VERTEX, "a": edge[first[v]], "b": 0, "n": 0, "m": 0, "o": steps[v], "area": 0, "corners": 0, "r": vr[v], "c": vc[v]}))
        chain = lambda i, j, s: edge[first[np.searchsorted(edge, ((i + tr * tile).astype(np.int64) * info.cols + (j + tc * tile)) * 4 + s)]]
        rows.append(_runs(mask, tr, tc, tile, across, chain, key))
        out = pd.concat(rows, ignore_index=True)
        out["outlet"] = key[1]
        return out

    schema = f"outlet {zone}, {OUT}"
    return cut(dealt.groupBy("none", "outlet", "tr", "tc").cogroup(split.groupBy("none", "outlet", "tr", "tc")).applyInPandas(run, schema), "traced")


def _runs(mask: np.ndarray, tr: int, tc: int, tile: int, across: int, chain, key: tuple) -> pd.DataFrame:
    """What stands at both ends (a, b) of each horizontal run of a tile's cells: a chain, or, below zero, the row's passage to the tile beside."""
    own = mask[1:-1, 1:-1]
    si, sj = np.nonzero(own & ~np.pad(own, ((0, 0), (1, 0)))[:, :-1])
    ei, ej = np.nonzero(own & ~np.pad(own, ((0, 0), (0, 1)))[:, 1:])
    passage = lambda i, t: -1 - ((i + tr * tile).astype(np.int64) * across + t)
    ends = []
    for i, j, beside, t, side in ((si, sj, mask[si + 1, sj], tc, 1), (ei, ej, mask[ei + 1, ej + 2], tc + 1, 3)):
        end = passage(i, t)
        closed = np.flatnonzero(~beside)
        if len(closed):
            end[closed] = chain(i[closed], j[closed], side)
        ends.append(end)
    links = pd.DataFrame({"a": ends[0], "b": ends[1]}).drop_duplicates()
    return pd.DataFrame({"outlet": key[1], "kind": RUN, "a": links.a, "b": links.b, "n": 0, "m": 0, "o": 0, "area": 0, "corners": 0, "r": 0, "c": 0})


def _named(chains: DataFrame) -> DataFrame:
    """(outlet, a, ring, after, edges): each chain's ring (its least edge), the edges from the chain's first to it, and the ring's edges. Pointers double until no stretch ahead has a lesser edge."""
    whole = chains.filter("a = b").select("outlet", "a", F.col("m").alias("ring"), F.col("o").alias("after"))
    store = State("rings")
    state = store.put(chains.filter("a <> b").select("outlet", "a", F.col("b").alias("next"), "m", "o", F.col("n").alias("w"), F.lit(True).alias("changed")))
    while not state.filter("changed").isEmpty():
        ahead = state.select(F.col("outlet").alias("z"), F.col("a").alias("x"), F.col("next").alias("then"), F.col("m").alias("m2"), F.col("o").alias("o2"), F.col("w").alias("w2"))
        both = state.join(ahead, F.col("outlet").eqNullSafe(F.col("z")) & (F.col("next") == F.col("x")))
        less = F.col("m2") < F.col("m")
        state = store.put(both.select("outlet", "a", F.col("then").alias("next"), F.when(less, F.col("m2")).otherwise(F.col("m")).alias("m"), F.when(less, F.col("w") + F.col("o2")).otherwise(F.col("o")).alias("o"), (F.col("w") + F.col("w2")).alias("w"), less.alias("changed")))
    named = whole.unionByName(state.select("outlet", "a", F.col("m").alias("ring"), F.col("o").alias("after")))
    total = _joined(chains.select("outlet", "a", "n"), named).groupBy("outlet", "ring").agg(F.sum("n").alias("edges"))
    out = cut(_joined(named, total, "ring"), "named")
    store.drop(chains.sparkSession)
    return out


def _joined(left: DataFrame, right: DataFrame, column: str = "a") -> DataFrame:
    """``left`` with the columns of ``right`` for the same zone (null is one) and ``column``."""
    right = right.withColumnRenamed("outlet", "_zone").withColumnRenamed(column, "_key")
    return left.join(right, F.col("outlet").eqNullSafe(F.col("_zone")) & (F.col(column) == F.col("_key"))).drop("_zone", "_key")


def trace(member: DataFrame, info: GridInfo, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Rings of the zones of ``member`` (outlet, r, c; repeated rows count once).

    (outlet, ring, part, hole, cells, edges, vertices): ``ring`` is named by its least edge, ``part`` by the outer ring it belongs to, ``cells`` is the area within, negative for holes;
    and (outlet, ring, pos, r, c): grid corners where a ring turns, in order, outer rings anticlockwise and holes clockwise with the map's north up.
    """
    spark = member.sparkSession
    zone = member.schema["outlet"].dataType.simpleString()
    none = spark.createDataFrame([], f"outlet {zone}, tr int, tc int, edge long")
    traced = _traced(member, none, info, tile)
    chains = lambda t: t.filter(f"kind = {CHAIN}")
    named = _named(chains(traced))
    corners = traced.filter(f"kind = {CORNER}")
    if not corners.isEmpty():
        # corners that one ring comes by twice
        own = _joined(corners.select("outlet", "a", F.col("b").alias("edge"), F.col("n").alias("corner"), "r", "c"), named)
        twice = own.groupBy("outlet", "corner", "ring").agg(F.collect_list(F.struct("edge", "r", "c")).alias("two")).filter("size(two) = 2").select("outlet", F.explode("two").alias("e"))
        split = cut(twice.select("outlet", F.expr(f"cast(e.r div {tile} as int)").alias("tr"), F.expr(f"cast(e.c div {tile} as int)").alias("tc"), "e.edge"), "split")
        if not split.isEmpty():
            traced = _traced(member, split, info, tile)
            named = _named(chains(traced))
    found = chains(traced)
    rings = _joined(found.select("outlet", "a", "area", "corners"), named).groupBy("outlet", "ring").agg(F.sum("area").alias("cells"), F.first("edges").alias("edges"), F.sum("corners").alias("vertices"))
    turns = traced.filter(f"kind = {VERTEX}")
    placed = _joined(turns.select("outlet", "a", "o", "r", "c"), named).select("outlet", "ring", ((F.col("o") - F.col("after") + F.col("edges")) % F.col("edges")).alias("pos"), "r", "c")
    return _with_parts(rings, traced.filter(f"kind = {RUN}"), named), cut(placed, "ring-vertices")


def _with_parts(rings: DataFrame, runs: DataFrame, named: DataFrame) -> DataFrame:
    """``rings`` with the part they bound, by the runs of cells between them."""
    ends = runs.select("outlet", "a", "b")
    for column in ("a", "b"):
        names = named.select(F.col("outlet").alias("z"), F.col("a").alias("x"), F.col("ring").alias("name"))
        ends = ends.join(names, F.col("outlet").eqNullSafe(F.col("z")) & (F.col(column) == F.col("x")), "left").withColumn(column, F.coalesce("name", column)).drop("z", "x", "name")
    node = lambda c: F.struct(F.col("outlet").isNull().alias("none"), F.col("outlet").alias("zone"), F.col(c).alias("n"))
    joined = components(ends.filter("a <> b").select(node("a").alias("a"), node("b").alias("b")).distinct()).filter("id.n >= 0")
    joined = joined.select(F.col("id.zone").alias("z"), F.col("id.n").alias("x"), F.col("component.n").alias("group"))
    grouped = cut(rings.join(joined, F.col("outlet").eqNullSafe(F.col("z")) & (F.col("ring") == F.col("x")), "left").withColumn("group", F.coalesce("group", "ring")).drop("z", "x"), "ring-groups")
    outer = grouped.filter("cells > 0").select(F.col("outlet").alias("z"), F.col("group").alias("g"), F.col("ring").alias("part"))
    return grouped.join(outer, F.col("outlet").eqNullSafe(F.col("z")) & (F.col("group") == F.col("g"))).select("outlet", "ring", "part", (F.col("cells") < 0).alias("hole"), "cells", "edges", "vertices")
