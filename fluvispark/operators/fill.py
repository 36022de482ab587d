"""Depression filling and flat resolution.

Filling finds the unique surface F with F = z on the seeds and F = max(z, min of the 8 neighbours' F + eps)
elsewhere. Without a slope (eps = 0) F is the lowest of the greatest elevations over all ways to a seed, and a spanning tree
of least weight keeps all such ways (Barnes, 2016, after Kruskal): every tile reduces itself to a small tree between its border cells, 8 x 8 tiles
reduce theirs together, and so on until one graph holds the whole grid's border; the levels found there are
handed down again. The number of passes is that of the levels (4 for a million by a million cells), whatever the shape of the terrain.
With a slope tiles are relaxed by a priority flood whose border starts from the neighbours' current
border values; rounds repeat for tiles whose surroundings fell until nothing changes, and exchange only borders.

Flats are resolved by distances. They are found within tiles, whose border cells then go to the adjoining tiles, in as many
rounds as a flat is tiles across.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import GridInfo, State, cut
from .graph import components
from .stencil import OFFSETS, TILE, boundary

#: Tiles (or blocks of them) side by side that are reduced together.
GROUP = 8
#: The node that stands for every seed's outside.
OUT = -1
HALF = OFFSETS[:4]


def _seeded(cells: DataFrame) -> DataFrame:
    """(r, c, z, seed) of the valid cells: those of the boundary, or the lowest cell if there are none."""
    valid = cells.filter("z is not null").select("r", "c", F.col("z").cast("double").alias("z"))
    marked = cut(boundary(valid, keep=True).select("r", "c", "z", (F.col("boundary") == 1).alias("seed")), "seeds")
    if marked.filter("seed").limit(1).count():
        return marked.select("r", "c", "z", "seed")
    low = marked.agg(F.min(F.struct("z", "r", "c")).alias("m")).select("m.r", "m.c").withColumn("_s", F.lit(True))
    return marked.drop("seed").join(low, ["r", "c"], "left").withColumn("seed", F.coalesce("_s", F.lit(False))).select("r", "c", "z", "seed")


def fill_depressions(cells: DataFrame, info: GridInfo, min_slope: float = 0.0, tile: int = TILE) -> DataFrame:
    """(r, c, z, filled, raised, seed). Seeds are the valid boundary cells, or the lowest cell if there are none."""
    eps = min_slope * (info.cw + info.ch) / 2
    seeded = _seeded(cells).withColumn("tr", F.expr(f"cast(r div {tile} as int)")).withColumn("tc", F.expr(f"cast(c div {tile} as int)"))
    state = cut(seeded, "fill")
    filled = _relaxed(state, eps, tile) if eps else _levelled(state, info, tile)
    return filled.select("r", "c", "z", F.col("f").alias("filled"), (F.col("f") > F.col("z")).alias("raised"), "seed")


# --- without a slope: trees of least weight --------------------------------------------------------


def spanning_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The places of the edges of a spanning forest of least weight (Boruvka): every component takes its lightest edge, all at once."""
    rank = np.empty(len(w), np.int64)
    rank[np.argsort(w, kind="stable")] = np.arange(len(w))
    by_rank = np.empty(len(w), np.int64)
    by_rank[rank] = np.arange(len(w))
    label, chosen = np.arange(n), np.zeros(len(w), bool)
    open_ = np.arange(len(w))
    while True:
        open_ = open_[label[a[open_]] != label[b[open_]]]
        if not len(open_):
            return np.flatnonzero(chosen)
        best = np.full(n, len(w))
        la, lb = label[a[open_]], label[b[open_]]
        np.minimum.at(best, la, rank[open_])
        np.minimum.at(best, lb, rank[open_])
        roots = np.flatnonzero(best < len(w))
        edge = by_rank[best[roots]]
        chosen[edge] = True
        up = np.arange(n)
        other = np.where(label[a[edge]] == roots, label[b[edge]], label[a[edge]])
        up[roots] = other
        # two that chose one another: the lesser stays a root
        both = (up[up] == np.arange(n)) & (np.arange(n) < up)
        up[both] = np.flatnonzero(both)
        while (up != up[up]).any():
            up = up[up]
        label = up[label]


def _adjacent(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The neighbours of each node as ranges: (first, other node, edge)."""
    ends, others = np.concatenate((a, b)), np.concatenate((b, a))
    order = np.argsort(ends, kind="stable")
    return np.searchsorted(ends[order], np.arange(n + 1)), others[order], np.concatenate((np.arange(len(a)),) * 2)[order]


def lowest_ways(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Of every node the least, over all ways from any node, of the greater of that node's ``level`` and the heaviest edge on the way."""
    # a virtual node joins all that have a level
    own = np.flatnonzero(np.isfinite(level))
    a, b, w = np.concatenate((a, np.full(len(own), n))), np.concatenate((b, own)), np.concatenate((w, level[own]))
    tree = spanning_tree(n + 1, a, b, w)
    first, other, edge = _adjacent(n + 1, a[tree], b[tree])
    found = np.full(n + 1, np.inf)
    found[n] = -np.inf
    seen = np.zeros(n + 1, bool)
    seen[n] = True
    front = np.array([n])
    while len(front):
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        came = np.repeat(front, size)
        new = ~seen[other[at]]
        at, came = at[new], came[new]
        found[other[at]] = np.maximum(found[came], w[tree][edge[at]])
        seen[other[at]] = True
        front = other[at]
    return found[:n]


def reduced(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A tree of at most twice the kept nodes between which the heaviest edges of the lightest ways are the same."""
    tree = spanning_tree(n, a, b, w)
    a, b, w = a[tree], b[tree], w[tree]
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    # twigs without a kept node are cut off
    while True:
        dead = ((degree[a] == 1) & ~keep[a]) | ((degree[b] == 1) & ~keep[b])
        if not dead.any():
            break
        degree -= np.bincount(a[dead], minlength=n) + np.bincount(b[dead], minlength=n)
        a, b, w = a[~dead], b[~dead], w[~dead]
    # chains of nodes with two neighbours become one edge
    stay = keep | (degree > 2)
    first, other, edge = (x.tolist() for x in _adjacent(n, a, b))
    weights, out = w.tolist(), ([], [], [])
    for start in np.flatnonzero(stay & (degree > 0)).tolist():
        for k in range(first[start], first[start + 1]):
            before, at, most = edge[k], other[k], weights[edge[k]]
            while not stay[at]:
                k2 = first[at] if edge[first[at]] != before else first[at] + 1
                before, at = edge[k2], other[k2]
                most = max(most, weights[before])
            if start < at:
                for x, v in zip(out, (start, at, most), strict=True):
                    x.append(v)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), np.array(out[2], float)


class _Tile:
    """The cells of a tile as a graph of pits (cells without a lower neighbour) and border cells, which stand for all that run down to them."""

    def __init__(self, own: pd.DataFrame, key: tuple, tile: int, cols: int) -> None:
        r, c = own.r.to_numpy(), own.c.to_numpy()
        self.z, self.seed = own.z.to_numpy(float), own.seed.to_numpy(bool)
        self.ids = r.astype(np.int64) * cols + c
        place = np.full((tile + 2, tile + 2), -1)
        i, j = r - key[0] * tile + 1, c - key[1] * tile + 1
        place[i, j] = np.arange(len(own))
        self.border = (i == 1) | (j == 1) | (i == tile) | (j == tile)
        near = np.stack([place[i + dr, j + dc] for dr, dc in OFFSETS])
        heights = np.where(near >= 0, self.z[near], np.inf)
        low = heights.argmin(axis=0)
        lowest = heights[low, np.arange(len(own))]
        end = np.where((lowest < self.z) & ~self.border & ~self.seed, near[low, np.arange(len(own))], np.arange(len(own)))
        while (end != end[end]).any():
            end = end[end]
        self.nodes, self.node = np.unique(end, return_inverse=True)
        a, b, w = [], [], []
        for k in range(4):
            there = np.flatnonzero(near[k] >= 0)
            x, y = self.node[there], self.node[near[k][there]]
            other = x != y
            a.append(np.minimum(x, y)[other])
            b.append(np.maximum(x, y)[other])
            w.append(np.maximum(self.z[there], self.z[near[k][there]])[other])
        a, b, w = (np.concatenate(x) for x in (a, b, w))
        order = np.lexsort((w, b, a))
        a, b, w = a[order], b[order], w[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.a, self.b, self.w = a[first], b[first], w[first]
        self.level = np.where(self.seed[self.nodes], self.z[self.nodes], np.inf)


def _solve(edges: pd.DataFrame, keep, levels: dict[int, float] | None):
    """Nodes and edges of a group of reduced graphs; either its own reduced edges, or, with levels, those of all its nodes."""
    nodes, code = np.unique(np.concatenate((edges.a.to_numpy(), edges.b.to_numpy(), np.array([OUT]))), return_inverse=True)
    a, b = code[: len(edges)], code[len(edges) : 2 * len(edges)]
    w = edges.w.to_numpy(float)
    if levels is None:
        x, y, v = reduced(len(nodes), a, b, w, keep(nodes))
        return nodes[x], nodes[y], v
    level = np.array([levels.get(i, np.inf) for i in nodes.tolist()])
    return nodes, lowest_ways(len(nodes), a, b, w, level)


def _join_up(size: int, cols: int):
    """Reduces the graph of a block of ``size`` x ``size`` cells to its border cells."""

    def rim(nodes: np.ndarray) -> np.ndarray:
        r, c = nodes // cols, nodes % cols
        return (nodes == OUT) | (r % size == 0) | (r % size == size - 1) | (c % size == 0) | (c % size == size - 1)

    def run(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        a, b, w = _solve(edges, rim, None)
        return pd.DataFrame({"a": a, "b": b, "w": w})

    return run


def _levelled(state: DataFrame, info: GridInfo, tile: int) -> DataFrame:
    """``state`` (r, c, z, seed, tr, tc) with f."""
    spark = state.sparkSession
    schema = "a long, b long, w double"

    def shrink(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(own, key, tile, info.cols)
        n = len(t.nodes)
        held = np.flatnonzero(np.isfinite(t.level))
        keep = np.append(t.border[t.nodes], True)
        a, b, w = reduced(n + 1, np.concatenate((t.a, held)), np.concatenate((t.b, np.full(len(held), n))), np.concatenate((t.w, t.level[held])), keep)
        names = np.append(t.ids[t.nodes], OUT)
        return pd.DataFrame({"a": names[a], "b": names[b], "w": w})

    inner = state.groupBy("tr", "tc").applyInPandas(shrink, schema)
    # edges across the borders of tiles
    rim = state.filter(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})").select((F.col("r").cast("long") * info.cols + F.col("c")).alias("id"), "r", "c", "z", "tr", "tc")
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in HALF])
    goes = rim.select(F.col("id").alias("a"), F.col("z").alias("za"), F.col("tr").alias("ta"), F.col("tc").alias("tb"), "r", "c", F.explode(moves).alias("m")).select("a", "za", "ta", "tb", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    across = goes.join(rim, ["r", "c"]).filter("ta <> tr or tb <> tc").select("a", F.col("id").alias("b"), F.greatest("za", "z").alias("w"))
    graph = State("graph").put(inner.union(across))

    def block(node, size: int):
        """The block of ``size`` x ``size`` cells of a node's cell, as a column."""
        r, c = F.floor(node / info.cols), node % info.cols
        return F.struct(F.floor(r / size).cast("int").alias("r"), F.floor(c / size).cast("int").alias("c"))

    levels: list[tuple[DataFrame, int]] = []
    size = tile
    while True:
        size *= GROUP
        whole = size >= info.rows and size >= info.cols
        ba, bb = block(F.col("a"), size), F.when(F.col("b") == OUT, block(F.col("a"), size)).otherwise(block(F.col("b"), size))
        # an edge to the outside is named by its other end, whichever comes first
        ends = graph.select(F.when(F.col("a") == OUT, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == OUT, F.col("a")).otherwise(F.col("b")).alias("b"), "w")
        placed = ends.withColumn("ba", ba).withColumn("bb", bb).withColumn("inside", F.col("ba") == F.col("bb"))
        own = placed.filter("inside").select(F.col("ba.r").alias("br"), F.col("ba.c").alias("bc"), "a", "b", "w")
        own = State("block").put(own)
        levels.append((own, size))
        if whole:
            break

        graph = State("graph").put(own.groupBy("br", "bc").applyInPandas(_join_up(size, info.cols), schema).union(placed.filter("not inside").select("a", "b", "w")))

    # the levels of border cells, from the largest blocks down
    known = None
    for own, size in reversed(levels):

        def solve(key: tuple, edges: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            start = dict(zip(given.id.tolist(), given.f.tolist(), strict=True)) | {OUT: -np.inf}
            if not len(edges):
                return pd.DataFrame({"id": np.zeros(0, np.int64), "f": np.zeros(0)})
            # -inf is no level of a node of its own: the outside's edges carry the seeds' levels
            nodes, f = _solve(edges, None, {k: (-1e308 if v == -np.inf else v) for k, v in start.items()})
            real = (nodes != OUT) & np.isfinite(f)
            return pd.DataFrame({"id": nodes[real], "f": f[real]})

        if known is None:
            given = spark.createDataFrame([], "id long, f double, br int, bc int")
        else:
            at = block(F.col("id"), size)
            given = known.withColumn("br", at["r"]).withColumn("bc", at["c"])
        found = own.groupBy("br", "bc").cogroup(given.groupBy("br", "bc")).applyInPandas(solve, "id long, f double")
        known = State("levels").put(found if known is None else found.union(known).groupBy("id").agg(F.min("f").alias("f")))

    at = block(F.col("id"), tile)
    given = known.withColumn("tr", at["r"]).withColumn("tc", at["c"])

    def raise_tile(key: tuple, own: pd.DataFrame, levels: pd.DataFrame) -> pd.DataFrame:
        t = _Tile(own, key, tile, info.cols)
        level = t.level.copy()
        order = np.argsort(t.ids[t.nodes])
        names = t.ids[t.nodes][order]
        got = levels.id.to_numpy()
        k = np.minimum(np.searchsorted(names, got), len(names) - 1)
        hit = names[k] == got
        np.minimum.at(level, order[k[hit]], levels.f.to_numpy(float)[hit])
        f = np.maximum(t.z, lowest_ways(len(t.nodes), t.a, t.b, t.w, level)[t.node])
        return own.assign(f=f)

    return state.groupBy("tr", "tc").cogroup(given.groupBy("tr", "tc")).applyInPandas(lambda key, own, levels: raise_tile(key, own, levels) if len(own) else own.assign(f=pd.Series(dtype=float)), "r int, c int, z double, seed boolean, tr int, tc int, f double")


# --- with a slope: relaxation ----------------------------------------------------------------------


def _flood(z: np.ndarray, f: np.ndarray, halo: np.ndarray, seeds: np.ndarray, eps: float) -> np.ndarray:
    """Relax a padded tile: ``f`` are the current values, ``halo`` the known ones around it, NaN where none."""
    h, w = z.shape
    out = np.where(np.isnan(z), np.nan, np.inf)
    out[seeds] = z[seeds]
    heap = [(float(out[i, j]), i, j) for i, j in np.argwhere(seeds).tolist()]
    for i, j in np.argwhere(~np.isnan(halo) & np.isfinite(halo)).tolist():
        heap.append((float(halo[i, j]), i, j))
    heapq.heapify(heap)
    while heap:
        v, i, j = heapq.heappop(heap)
        if not np.isnan(z[i, j]) and v > out[i, j]:
            continue
        for di, dj in OFFSETS:
            a, b = i + di, j + dj
            if 0 <= a < h and 0 <= b < w and not np.isnan(z[a, b]):
                new = max(z[a, b], v + eps)
                if new < out[a, b]:
                    out[a, b] = new
                    heapq.heappush(heap, (new, a, b))
    return np.fmin(out, f)


def _relaxed(state: DataFrame, eps: float, tile: int) -> DataFrame:
    """``state`` (r, c, z, seed, tr, tc) with f."""
    store, todo_store = State("fill"), State("todo")
    state = store.put(state.withColumn("f", F.lit(float("inf"))))
    todo = state.select("tr", "tc").distinct()
    rim = f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})"

    def relax(key: tuple, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"r": [], "c": [], "z": [], "seed": [], "f": [], "tr": [], "tc": [], "old": []})
        r0, c0 = key[0] * tile - 1, key[1] * tile - 1
        shape = (tile + 2, tile + 2)
        z, f, halo, seeds = np.full(shape, np.nan), np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, bool)
        r, c = own.r.to_numpy() - r0, own.c.to_numpy() - c0
        z[r, c], f[r, c], seeds[r, c] = own.z, own.f, own.seed
        if len(around):
            halo[around.hr.to_numpy() - r0, around.hc.to_numpy() - c0] = around.hf
        got = _flood(z, f, halo, seeds, eps)[r, c]
        return own.assign(old=own.f, f=got)

    while True:
        edge = state.filter(rim).filter("f < double('inf')")
        spread = edge.select(F.col("r").alias("hr"), F.col("c").alias("hc"), F.col("f").alias("hf"), "tr", "tc")
        spread = spread.withColumn("nr", F.explode(F.array(F.expr(f"cast((hr - 1) div {tile} as int)"), F.expr(f"cast((hr + 1) div {tile} as int)"))))
        spread = spread.withColumn("nc", F.explode(F.array(F.expr(f"cast((hc - 1) div {tile} as int)"), F.expr(f"cast((hc + 1) div {tile} as int)"))))
        spread = spread.filter("(nr <> tr or nc <> tc)").select("hr", "hc", "hf", F.col("nr").alias("tr"), F.col("nc").alias("tc")).distinct()
        active = state.join(todo, ["tr", "tc"], "left_semi")
        done = state.join(todo, ["tr", "tc"], "left_anti").withColumn("old", F.col("f"))
        columns = "r int, c int, z double, seed boolean, f double, tr int, tc int, old double"
        relaxed = active.select("r", "c", "z", "seed", "f", "tr", "tc").groupBy("tr", "tc").cogroup(spread.groupBy("tr", "tc")).applyInPandas(relax, columns)
        state = store.put(relaxed.unionByName(done.select("r", "c", "z", "seed", "f", "tr", "tc", "old")))
        fell = state.filter("f < old").filter(rim).select("tr", "tc").distinct()
        near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
        todo = todo_store.put(fell.select("tr", "tc", near.alias("n")).select((F.col("tr") + F.col("n.a")).alias("tr"), (F.col("tc") + F.col("n.b")).alias("tc")).distinct().join(state.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi"))
        state = state.drop("old")
        if not todo.limit(1).count():
            return state


def fill_depth(filled: DataFrame) -> DataFrame:
    return filled.select("r", "c", F.greatest(F.col("filled") - F.col("z"), F.lit(0.0)).alias("depth"))


# --- flats -------------------------------------------------------------------------------------------


def _pairs(cells: DataFrame, info: GridInfo) -> DataFrame:
    """Ordered pairs of neighbouring cells (a, k, b) of ``cells`` (id, r, c)."""
    moves = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(OFFSETS)])
    out = cells.select(F.col("id").alias("a"), "r", "c", F.explode(moves).alias("m"))
    r, c = F.col("r") + F.col("m.dr"), F.col("c") + F.col("m.dc")
    return out.filter(r.between(0, info.rows - 1) & c.between(0, info.cols - 1)).select("a", F.col("m.k").alias("k"), (r.cast("long") * info.cols + c).alias("b"))


def _around(cells: DataFrame, tile: int, columns: list[str]) -> DataFrame:
    """Border cells of tiles as seen from the adjoining tiles: (hr, hc, columns, tr, tc)."""
    rim = cells.filter(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})").withColumn("ot", F.expr(f"cast(r div {tile} as int)")).withColumn("oc", F.expr(f"cast(c div {tile} as int)"))
    beside = lambda x: F.explode(F.array_distinct(F.array(*[F.expr(f"cast(floor(({x} + {d}) / {tile}) as int)") for d in (-1, 0, 1)])))
    spread = rim.withColumn("tr", beside("r")).withColumn("tc", beside("c")).filter("tr <> ot or tc <> oc")
    return spread.select(F.col("r").alias("hr"), F.col("c").alias("hc"), *[F.col(x).alias(x) for x in columns], "tr", "tc")


def _padded(key: tuple, tile: int, own: pd.DataFrame, around: pd.DataFrame, column: str) -> np.ndarray:
    """A tile's values, up to its last row and column that hold a cell, with one cell around, NaN where there is none."""
    r, c = own.r.to_numpy() - key[0] * tile + 1, own.c.to_numpy() - key[1] * tile + 1
    out = np.full((r.max() + 2, c.max() + 2), np.nan)
    out[r, c] = own[column].to_numpy(float)
    if len(around):
        r, c = around.hr.to_numpy() - key[0] * tile + 1, around.hc.to_numpy() - key[1] * tile + 1
        seen = (r < out.shape[0]) & (c < out.shape[1])
        out[r[seen], c[seen]] = around[column].to_numpy(float)[seen]
    return out


def distances(cells: DataFrame, tolerance: float, tile: int = TILE) -> DataFrame:
    """(r, c, level): breadth-first layers over neighbouring ``cells`` (r, c, z, level) whose z differ by at most ``tolerance``.

    Cells with a level are the start; null, they are found, and left out where there is no way. A round spreads the layers through all tiles; rounds go on while borders change.
    """
    store = State("layers")
    far = 1e300
    state = cells.select("r", "c", F.col("z").cast("double").alias("z"), F.coalesce(F.col("level").cast("double"), F.lit(far)).alias("level"))
    state = store.put(state.withColumn("tr", F.expr(f"cast(r div {tile} as int)")).withColumn("tc", F.expr(f"cast(c div {tile} as int)")).withColumn("moved", F.lit(True)))

    def spread(key: tuple, own: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return own
        z, level = _padded(key, tile, own, around, "z"), _padded(key, tile, own, around, "level")
        inner = (slice(1, -1), slice(1, -1))
        rows, cols = z[inner].shape
        fits = [np.abs(z[inner] - z[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols]) <= tolerance for dr, dc in OFFSETS]
        while True:
            best = level[inner].copy()
            for (dr, dc), fit in zip(OFFSETS, fits, strict=True):
                there = level[1 + dr : 1 + dr + rows, 1 + dc : 1 + dc + cols] + 1
                best = np.where(fit & (there < best), there, best)
            if not (best < level[inner]).any():
                break
            level[inner] = best
        got = level[own.r.to_numpy() - key[0] * tile + 1, own.c.to_numpy() - key[1] * tile + 1]
        return own.assign(moved=got < own.level.to_numpy(float), level=got)

    schema = "r int, c int, z double, level double, tr int, tc int, moved boolean"
    rim = f"(r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1}))"
    first = True
    while True:
        # tiles beside a changed border, all of them at first
        seen = _around(state, tile, ["z", "level", "moved"])
        todo = state.select("tr", "tc").distinct() if first else seen.filter("moved").select("tr", "tc").distinct()
        active = state.join(todo, ["tr", "tc"], "left_semi")
        rest = state.join(todo, ["tr", "tc"], "left_anti").withColumn("moved", F.lit(False))
        found = active.groupBy("tr", "tc").cogroup(seen.drop("moved").groupBy("tr", "tc")).applyInPandas(spread, schema)
        state = store.put(found.unionByName(rest))
        first = False
        if not state.filter(f"moved and {rim}").limit(1).count():
            return state.filter(F.col("level") < far).select("r", "c", F.col("level").cast("int").alias("level"))


def connected(cells: DataFrame, info: GridInfo, tolerance: float | None, tile: int = TILE) -> DataFrame:
    """(r, c, component): the 8-connected components of ``cells`` (r, c, z), by their least cell id; neighbours are joined if their z differ by at most ``tolerance``, all if it is null.

    Tiles label their own cells; the labels that touch across borders are joined as a graph.
    """
    own = cells.select("r", "c", F.col("z").cast("double").alias("z")).withColumn("tr", F.expr(f"cast(r div {tile} as int)")).withColumn("tc", F.expr(f"cast(c div {tile} as int)"))

    def label(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place = np.full((tile + 2, tile + 2), -1)
        i, j = pdf.r.to_numpy() - key[0] * tile + 1, pdf.c.to_numpy() - key[1] * tile + 1
        place[i, j] = np.arange(len(pdf))
        z, a, b = pdf.z.to_numpy(float), [], []
        for dr, dc in HALF:
            other = place[i + dr, j + dc]
            fit = np.flatnonzero(other >= 0)
            if tolerance is not None:
                fit = fit[np.abs(z[fit] - z[other[fit]]) <= tolerance]
            a.append(fit)
            b.append(other[fit])
        a, b = np.concatenate(a), np.concatenate(b)
        ids = pdf.r.to_numpy().astype(np.int64) * info.cols + pdf.c.to_numpy()
        least = ids.copy()
        while True:
            new = least.copy()
            np.minimum.at(new, a, least[b])
            np.minimum.at(new, b, least[a])
            order = np.argsort(ids)
            new = new[order[np.searchsorted(ids[order], new)]]  # and what that one has
            if (new == least).all():
                break
            least = new
        return pd.DataFrame({"r": pdf.r, "c": pdf.c, "z": z, "local": least})

    labelled = cut(own.groupBy("tr", "tc").applyInPandas(label, "r int, c int, z double, local long"), "labels")
    rim = labelled.filter(f"r % {tile} in (0, {tile - 1}) or c % {tile} in (0, {tile - 1})")
    moves = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in HALF])
    goes = rim.select(F.col("z").alias("za"), F.col("local").alias("a"), "r", "c", F.explode(moves).alias("m")).select("za", "a", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    meet = goes.join(rim, ["r", "c"]).filter("a <> local")
    if tolerance is not None:
        meet = meet.filter(F.abs(F.col("za") - F.col("z")) <= tolerance)
    joined = components(meet.select("a", F.col("local").alias("b")).distinct())
    return labelled.join(joined.select(F.col("id").alias("local"), F.col("component").alias("joined")), "local", "left").select("r", "c", F.coalesce("joined", "local").alias("component"))


# fixed values: Barnes flats are scanned W, NW, N, NE, E, SE, S, SW
SCAN = (4, 5, 6, 7, 0, 1, 2, 3)


def resolve_flats(flow: DataFrame, info: GridInfo, method: str = "barnes", tolerance: float = 1e-9, tile: int = TILE, weight: int = 2, small_flat_cells: int = 0) -> DataFrame:
    """(r, c, z, dir): directions for cells of ``flow`` (r, c, z, dir, and perhaps boundary) without descent.

    ``barnes``: flats (components of equal elevation that hold a cell beside a lower or routed equal one) drain by the
    mask ``weight`` * toward + (height - away): away from higher ground and toward the outlets; flats of at most ``small_flat_cells`` cells by the distance to the outlets alone (the hybrid of the two). ``toward``: distance to the outlets alone. Boundary cells without descent are
    outlets and stay without direction. Passes repeat, as newly routed cells become outlets of others, until one routes no further cell.
    """
    store, near_store = State("flats"), State("near")
    id_ = F.col("r").cast("long") * info.cols + F.col("c")
    own = [id_.alias("id"), "r", "c", F.col("z").cast("double").alias("z"), F.col("dir").cast("int").alias("dir")]
    if "boundary" in flow.columns:
        cells = store.put(flow.filter("z is not null").select(*own, ((F.col("boundary") == 1) & F.col("dir").isNull()).alias("drain")))
    else:
        cells = store.put(flow.select(*own).filter("z is not null"))
        edge = boundary(cells.select("r", "c", "z")).select("r", "c", (F.col("boundary") == 1).alias("drain"))
        cells = store.put(cells.join(edge, ["r", "c"]).withColumn("drain", F.col("drain") & F.col("dir").isNull()))
    barnes = method == "barnes"
    tol = tolerance if barnes else 0.0
    scan = F.array_position(F.array(*[F.lit(k) for k in (SCAN if barnes else range(8))]), F.col("k"))
    first = [(F.col("k") % 2).alias("x"), scan.alias("s")] if barnes else [scan.alias("s")]
    left = cells.filter("dir is null and not drain").count()
    while left:
        flat = cells.filter("dir is null and not drain")
        near = _pairs(flat.select("id", "r", "c"), info).join(cells.select(F.col("id").alias("b"), F.col("z").alias("zb"), F.col("dir").alias("db"), F.col("drain").alias("drainb")), "b").join(flat.select(F.col("id").alias("a"), F.col("z").alias("za")), "a")
        near = near_store.put(near.withColumn("routed", F.col("db").isNotNull() | F.col("drainb")))
        outs = cut(near.filter(F.col("routed") & (F.col("zb") <= F.col("za") + tol)).groupBy(F.col("a").alias("id")).agg(F.min_by("k", F.struct(*first)).alias("out")), "outs")
        toward = cut(distances(flat.join(outs.select("id", F.lit(1).alias("level")), "id", "left"), tol, tile), "toward")
        mask = toward.withColumn("mask", F.col("level"))
        if barnes:
            reached = cut(flat.join(toward, ["r", "c"]).select("id", "r", "c", "z", "level"), "reached")
            high = near.filter(F.col("zb") > F.col("za") + tol).select(F.col("a").alias("id")).distinct().join(outs, "id", "left_anti").join(reached, "id", "left_semi").withColumn("start", F.lit(1))
            away = distances(reached.drop("level").join(high, "id", "left").withColumnRenamed("start", "level"), tol, tile).withColumnRenamed("level", "away")
            labelled = reached.join(away, ["r", "c"], "left").join(connected(reached, info, tol, tile), ["r", "c"])
            height = labelled.groupBy("component").agg(F.max("away").alias("height"), F.count("*").alias("n"))
            both = F.when((F.col("n") > small_flat_cells) & F.col("away").isNotNull(), F.col("height") - F.col("away")).otherwise(0)
            mask = labelled.join(height, "component").withColumn("mask", F.when(F.col("n") > small_flat_cells, weight * F.col("level")).otherwise(F.col("level")) + both)
        mask = cut(mask.select(id_.alias("id"), "mask"), "mask")
        inner = near.filter((F.abs(F.col("zb") - F.col("za")) <= tol) & ~F.col("routed")).select("a", "k", "b")
        steps = inner.join(mask.select(F.col("id").alias("a"), F.col("mask").alias("ma")), "a").join(mask.select(F.col("id").alias("b"), F.col("mask").alias("mb")), "b").filter("mb < ma")
        chosen = steps.groupBy(F.col("a").alias("id")).agg(F.min_by("k", F.struct("mb", *first)).alias("step"))
        new = outs.join(chosen, "id", "full").select("id", F.coalesce("out", "step").alias("new"))
        cells = store.put(cells.join(new, "id", "left").withColumn("dir", F.coalesce("dir", "new").cast("int")).drop("new"))
        before, left = left, cells.filter("dir is null and not drain").count()
        if left == before:  # what is left has no way out
            break
    return cells.select("r", "c", "z", "dir")


def depression_labels(depth: DataFrame, info: GridInfo, tolerance: float = 0.01, tile: int = TILE) -> DataFrame:
    """(r, c, depth, component): 8-connected components of cells deeper than ``tolerance``, by their least cell id."""
    wet = cut(depth.filter(F.col("depth") > tolerance).select("r", "c", "depth"), "wet")
    return wet.join(connected(wet.withColumn("z", F.lit(0.0)), info, None, tile), ["r", "c"]).select("r", "c", "depth", "component")
