"""Iterative kernels on parent forests and undirected graphs.

Path doubling takes rounds logarithmic in the longest path; each round is one join and one group-by
on the id. Over a grid every tile is first contracted to its border cells (the tiled scheme of
Barnes, 2017), so the rounds run on about 4 / TILE of the cells, and two passes over the tiles do the rest.
Within a tile, cells are worked through in waves from the sources downwards, by whole-array arithmetic.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.grids import GridInfo, State, cut
from .stencil import OFFSETS, TILE

MAX_ROUNDS = 48


def with_receiver(flow: DataFrame, info: GridInfo) -> DataFrame:
    """Adds ``id`` and ``parent`` (null off the grid or without direction) from r, c, dir; invalid receivers count as off-grid."""
    dr = F.element_at(F.array(*[F.lit(a) for a, _ in OFFSETS]), F.col("dir") + 1)
    dc = F.element_at(F.array(*[F.lit(b) for _, b in OFFSETS]), F.col("dir") + 1)
    r, c = F.col("r") + dr, F.col("c") + dc
    inside = F.col("dir").isNotNull() & r.between(0, info.rows - 1) & c.between(0, info.cols - 1)
    return flow.withColumn("id", F.col("r").cast("long") * info.cols + F.col("c")).withColumn("parent", F.when(inside, r.cast("long") * info.cols + c))


class CycleError(ValueError):
    pass


def accumulate(nodes: DataFrame, how: str = "sum") -> DataFrame:
    """(id, total): for (id, parent, w), w of the node and all above it summed, or with ``how='max'`` the longest sum of ``w`` from above.

    For the maximum, ``w`` is the length of a node's own link to its parent, and ``s``, if given, what it starts with. An error if the parents hold a cycle: after as many rounds
    as the number of nodes has binary digits every other way has ended.
    """
    start = F.col("w") if how == "sum" else F.col("s") if "s" in nodes.columns else F.lit(0.0)
    store = State("doubling")
    state = store.put(nodes.select("id", "parent", start.cast("double").alias("s"), F.col("w").cast("double").alias("d")))
    rounds, most = 0, None
    while True:
        moving = state.filter("parent is not null")
        if not moving.limit(1).count():
            break
        if rounds >= 8:  # deep enough to ask how deep it can be
            most = most or state.count().bit_length() + 1
            if rounds > most:
                store.drop(nodes.sparkSession)
                raise CycleError("the receivers hold a cycle")
        rounds += 1
        value = F.sum("s") if how == "sum" else F.max(F.col("s") + F.col("d"))
        gain = moving.groupBy(F.col("parent").alias("id")).agg(value.alias("gain"))
        up = state.select(F.col("id").alias("parent"), F.col("parent").alias("next"), F.col("d").alias("dn"))
        s = F.col("s") + F.coalesce("gain", F.lit(0.0)) if how == "sum" else F.greatest("s", F.coalesce("gain", "s"))
        state = store.put(state.join(gain, "id", "left").join(up, "parent", "left").select("id", F.col("next").alias("parent"), s.alias("s"), (F.col("d") + F.coalesce("dn", F.lit(0.0))).alias("d")))
    return state.select("id", F.col("s").alias("total"))


def cycles(nodes: DataFrame) -> DataFrame:
    """(id, cycle): the nodes of (id, parent) that lie on cycles, and the least id of each one's cycle.

    Pointers double until they reach as far as there are nodes; then every way without a cycle has ended, and what the others point at are the nodes of cycles, whose way has been all round.
    """
    store = State("cycles")
    state = store.put(nodes.filter("parent is not null").select("id", F.col("parent").alias("at"), "id", F.col("id").alias("least")).toDF("id", "at", "_", "least").drop("_"))
    for _ in range(state.count().bit_length() + 1):
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("least").alias("other"))
        state = store.put(state.join(ahead, "at").select("id", F.col("next").alias("at"), F.least("least", "other").alias("least")))
    on = state.select(F.col("at").alias("id")).distinct()
    return on.join(state.select("id", F.col("least").alias("cycle")), "id")


def settle(links: DataFrame) -> DataFrame:
    """(id, at, done, steps, length): for (id, at, done, steps, length) the pointers followed to the end, by doubling; only rows not yet done are joined."""
    store = State("descent")
    state = store.put(links)
    for _ in range(MAX_ROUNDS):
        going = state.filter("not done and at is not null")
        if not going.limit(1).count():
            return state
        ahead = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("there"), F.col("steps").alias("more"), F.col("length").alias("further"))
        moved = going.select("id", "at", "steps", "length").join(ahead, "at", "left").select(
            "id", F.col("next").alias("at"), F.coalesce("there", F.lit(False)).alias("done"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (F.col("length") + F.coalesce("further", F.lit(0.0))).alias("length")
        )
        state = store.put(state.filter("done or at is null").unionByName(moved))
    raise ValueError("the receivers hold a cycle")


def descend(nodes: DataFrame, marked: str = "marked", info: GridInfo | None = None, tile: int = TILE) -> DataFrame:
    """(id, target, steps, length): for (id, parent, marked and perhaps link) the first marked node at or below each, the steps to it and the links' sum; null if none.

    With ``info``, ids are cells of that grid and tiles are contracted first.
    """
    link = F.col("link").cast("double") if "link" in nodes.columns else F.lit(0.0)
    own = nodes.select("id", "parent", F.col(marked).alias("marked"), link.alias("link"))
    if info is None:
        at = F.when(F.col("marked"), F.col("id")).otherwise(F.col("parent"))
        start = own.select("id", at.alias("at"), F.col("marked").alias("done"), F.when(F.col("marked"), 0).otherwise(1).cast("long").alias("steps"), F.when(F.col("marked"), 0.0).otherwise(F.col("link")).alias("length"))
        # one that points at a marked node has arrived there
        hit = own.filter("marked").select(F.col("id").alias("at"), F.lit(True).alias("hit"))
        start = start.join(hit, "at", "left").withColumn("done", F.col("done") | F.coalesce("hit", F.lit(False))).drop("hit")
        end = settle(start.select("id", "at", "done", "steps", "length"))
        return end.select("id", F.when(F.col("done"), F.col("at")).alias("target"), F.when(F.col("done"), F.col("steps")).alias("steps"), F.when(F.col("done"), F.col("length")).alias("length"))

    def local(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(pdf)
        stop = pdf.marked.to_numpy(bool)
        end, steps, length = forest.follow(stop, pdf.link.to_numpy(float))
        done = stop[end] & forest.ordered
        leaves = ~done & (forest.raw[end] >= 0) & forest.ordered
        at = np.where(done, forest.ids[end], forest.raw[end])
        links = pdf.link.to_numpy(float)[end]
        return pd.DataFrame({
            "id": forest.ids, "at": pd.array(np.where(done | leaves, at, 0), "Int64").copy(), "exit": pd.array(forest.ids[end], "Int64"), "done": done,
            "steps": steps + leaves, "length": length + np.where(leaves, links, 0.0), "ok": done | leaves, "rim": _rim(pdf, info, tile),
        })

    keyed = _tiled(own, info, tile)
    within = cut(keyed.groupBy("tr", "tc").applyInPandas(local, "id long, at long, exit long, done boolean, steps long, length double, ok boolean, rim boolean"), "within")
    within = within.select("id", F.when(F.col("ok"), F.col("at")).alias("at"), "done", "steps", "length", "rim")
    # every cell that leads out of its tile points at a rim cell of the next; so rim cells are enough to follow
    rim = settle(within.filter("rim").select("id", "at", "done", "steps", "length"))
    ahead = rim.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("there"), F.col("steps").alias("more"), F.col("length").alias("further"))
    got = within.join(ahead.withColumn("out", F.lit(False)), (within["at"] == ahead["at"]) & ~within["done"], "left").select(
        "id", F.when(F.col("done"), within["at"]).when(F.col("there"), F.col("next")).alias("target"), F.when(F.col("done"), F.col("steps")).when(F.col("there"), F.col("steps") + F.col("more")).alias("steps"),
        F.when(F.col("done"), F.col("length")).when(F.col("there"), F.col("length") + F.col("further")).alias("length"),
    )
    return got


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each connected component of undirected ``edges`` (a, b)."""
    edge_store, store = State("edges"), State("labels")
    both = edge_store.put(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = store.put(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id").select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        roots = hooked.groupBy(F.col("old").alias("root")).agg(F.min("c").alias("up"))
        raised = hooked.join(roots, F.col("old") == F.col("root")).select("id", F.least("c", "up").alias("c"), "old")
        ahead = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = store.put(raised.join(ahead, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), "old"))
        labels = new.select("id", "component")
        if not new.filter("component <> old").limit(1).count():
            edge_store.drop(edges.sparkSession)
            return labels


# --- within a tile --------------------------------------------------------------------------------


class Forest:
    """The receivers within a tile, and its cells in waves from the sources downwards; cells of cycles are in no wave."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.ids = pdf.id.to_numpy()
        sort = np.argsort(self.ids)
        self.raw = pdf.parent.fillna(-1).to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.ids[sort], self.raw), len(self.ids) - 1)
        self.inner = np.where((self.raw >= 0) & (self.ids[sort][at] == self.raw), sort[at], -1)
        self.waves: list[np.ndarray] = []
        degree = np.bincount(self.inner[self.inner >= 0], minlength=len(self.ids))
        wave = np.flatnonzero(degree == 0)
        while len(wave):
            self.waves.append(wave)
            below = self.inner[wave]
            below, n = np.unique(below[below >= 0], return_counts=True)
            degree[below] -= n
            wave = below[degree[below] == 0]
        self.ordered = np.zeros(len(self.ids), bool)
        for wave in self.waves:
            self.ordered[wave] = True

    def sums(self, amount: np.ndarray) -> np.ndarray:
        """Sums of ``amount`` over each cell and all above it."""
        total = amount.astype(float)
        for wave in self.waves:
            own = wave[self.inner[wave] >= 0]
            np.add.at(total, self.inner[own], total[own])
        return total

    def longest(self, start: np.ndarray, link: np.ndarray) -> np.ndarray:
        """The greatest of each cell's start and what arrives from above, links added on the way."""
        best = start.astype(float)
        for wave in self.waves:
            own = wave[self.inner[wave] >= 0]
            np.maximum.at(best, self.inner[own], best[own] + link[own])
        return best

    def follow(self, stop: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last cell, steps, length) of the way down from each cell, to the first that stops or has no receiver here."""
        end, steps, length = np.arange(len(self.ids)), np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids))
        for wave in reversed(self.waves):
            own = wave[(self.inner[wave] >= 0) & ~stop[wave]]
            below = self.inner[own]
            end[own], steps[own], length[own] = end[below], steps[below] + 1, length[below] + link[own]
        return end, steps, length


def _tiled(nodes: DataFrame, info: GridInfo, tile: int) -> DataFrame:
    """Adds r, c and the tile (tr, tc) of cell ids."""
    r, c = F.expr(f"id div {info.cols}").cast("int"), F.expr(f"id % {info.cols}").cast("int")
    return nodes.withColumn("r", r).withColumn("c", c).withColumn("tr", F.expr(f"r div {tile}")).withColumn("tc", F.expr(f"c div {tile}"))


def _rim(pdf: pd.DataFrame, info: GridInfo, tile: int) -> np.ndarray:
    r, c = pdf.r.to_numpy() % tile, pdf.c.to_numpy() % tile
    return (r == 0) | (c == 0) | (r == tile - 1) | (c == tile - 1)


def _valid(flow: DataFrame) -> DataFrame:
    """``flow`` with receivers that are no cells of it taken out."""
    there = flow.select(F.col("id").alias("parent"), F.lit(True).alias("_ok"))
    return flow.join(there, "parent", "left").withColumn("parent", F.when(F.col("_ok"), F.col("parent"))).drop("_ok")


def flow_accumulation(flow: DataFrame, info: GridInfo, weight: str | None = None, tile: int = TILE) -> DataFrame:
    """(id, r, c, dir, parent, acc): the weights (cells if none) of all cells upstream, the cell itself left out; null for the cells of a cycle (``cells_in_cycles`` counts them), within a tile or over many.

    ``flow`` has r, c, dir and the weight. Each tile is solved alone; what leaves it is summed along the
    contracted graph of border cells by path doubling; a second pass adds what enters.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = _valid(with_receiver(flow, info).select("id", "dir", "parent", w.alias("w")))
    cells = cut(_tiled(cells, info, tile), "flow")

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(pdf)
        total = forest.sums(pdf.w.to_numpy(float))
        leave, _, _ = forest.follow(np.zeros(len(pdf), bool), np.zeros(len(pdf)))
        out = np.flatnonzero((forest.inner < 0) & (forest.raw >= 0))
        rim = np.flatnonzero(_rim(pdf, info, tile))
        goes = np.isin(leave[rim], out)
        return pd.concat(
            [
                pd.DataFrame({"kind": 0, "id": forest.ids[out], "other": forest.raw[out], "w": total[out]}),
                pd.DataFrame({"kind": 1, "id": forest.ids[rim[goes]], "other": forest.ids[leave[rim[goes]]], "w": 0.0}),
            ]
        )

    rim = cut(cells.groupBy("tr", "tc").applyInPandas(exits, "kind int, id long, other long, w double"), "rim")
    leaving = rim.filter("kind = 0").select("id", F.col("other").alias("enters"), "w")
    through = rim.filter("kind = 1").select(F.col("id").alias("enters"), F.col("other").alias("parent"))
    graph = leaving.join(through, "enters", "left")
    try:
        totals, on = accumulate(graph.select("id", "parent", "w")), None
    except CycleError:
        # cycles over several tiles are cut; what they enter a tile by marks their way through it
        on = cut(cycles(graph.select("id", "parent")).select("id", F.lit(True).alias("on")), "cycles")
        totals = accumulate(graph.join(on, "id", "left").select("id", F.when(F.col("on").isNull(), F.col("parent")).alias("parent"), "w"))
    sums = totals.join(leaving.select("id", "enters"), "id")
    sums = sums.withColumn("on", F.lit(None).cast("boolean")) if on is None else sums.join(on, "id", "left")
    inflow = sums.groupBy(F.col("enters").alias("id")).agg(F.sum("total").alias("inflow"), F.max("on").alias("round"))

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(pdf)
        own = pdf.w.to_numpy(float)
        acc = forest.sums(own + pdf.inflow.fillna(0).to_numpy(float)) - own
        acc[~forest.ordered] = np.nan
        for k in np.flatnonzero(pdf["round"].eq(True).to_numpy(bool)):
            while k >= 0 and not np.isnan(acc[k]):
                acc[k] = np.nan
                k = forest.inner[k]
        return pd.DataFrame({"id": forest.ids, "r": pdf.r, "c": pdf.c, "dir": pdf.dir.astype("Int32"), "parent": pdf.parent.astype("Int64"), "acc": acc})

    return cells.join(inflow, "id", "left").groupBy("tr", "tc").applyInPandas(finish, "id long, r int, c int, dir int, parent long, acc double")


def cells_in_cycles(accumulated: DataFrame) -> DataFrame:
    """(cells, in_cycles) of what ``flow_accumulation`` gives."""
    return accumulated.agg(F.count("*").alias("cells"), F.coalesce(F.sum((F.col("acc").isNull() | F.isnan("acc")).cast("long")), F.lit(0)).alias("in_cycles"))


def upstream_longest(nodes: DataFrame, info: GridInfo, tile: int = TILE) -> DataFrame:
    """(id, total): the longest sum of links (id, parent, link) arriving at each cell of the grid, 0 at sources; tiles are contracted as for accumulation."""
    cells = cut(_tiled(nodes.select("id", "parent", F.col("link").cast("double").alias("link")), info, tile), "links")

    def exits(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest, link = Forest(pdf), pdf.link.to_numpy(float)
        best = forest.longest(np.zeros(len(pdf)), link)
        leave, _, length = forest.follow(np.zeros(len(pdf), bool), link)
        out = np.flatnonzero((forest.inner < 0) & (forest.raw >= 0))
        rim = np.flatnonzero(_rim(pdf, info, tile))
        goes = np.isin(leave[rim], out)
        return pd.concat(
            [
                pd.DataFrame({"kind": 0, "id": forest.ids[out], "other": forest.raw[out], "s": best[out], "link": link[out]}),
                pd.DataFrame({"kind": 1, "id": forest.ids[rim[goes]], "other": forest.ids[leave[rim[goes]]], "s": length[rim[goes]], "link": 0.0}),
            ]
        )

    rim = cut(cells.groupBy("tr", "tc").applyInPandas(exits, "kind int, id long, other long, s double, link double"), "rim")
    leaving = rim.filter("kind = 0").select("id", F.col("other").alias("enters"), "s", "link")
    through = rim.filter("kind = 1").select(F.col("id").alias("enters"), F.col("other").alias("parent"), F.col("s").alias("across"))
    graph = leaving.join(through, "enters", "left").select("id", "parent", "s", (F.col("link") + F.coalesce("across", F.lit(0.0))).alias("w"))
    totals = accumulate(graph, how="max")
    arriving = totals.join(leaving, "id").groupBy(F.col("enters").alias("id")).agg(F.max(F.col("total") + F.col("link")).alias("arriving"))

    def finish(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(pdf)
        best = forest.longest(pdf.arriving.fillna(0).to_numpy(float), pdf.link.to_numpy(float))
        return pd.DataFrame({"id": forest.ids, "total": np.where(forest.ordered, best, np.nan)})

    return cells.join(arriving, "id", "left").groupBy("tr", "tc").applyInPandas(finish, "id long, total double")


def walk_down(nodes: DataFrame, starts: DataFrame, info: GridInfo, limit_m: float, tile: int = TILE) -> DataFrame:
    """(start, pos, id, cum_m): the cells on the way down from ``starts`` (start, id), as long as the sum of links (id, parent, link) is within ``limit_m``.

    Tiles are contracted to the ways from their rim cells, and from the starts, to the first cell of the next tile. Pointers over these ways double as often as the longest walk has binary digits of tiles, and
    from the longest pointers to the shortest each doubles the places known on the walks; a last pass over the tiles fills in the cells between. An error if a walk without a limit goes round.
    """
    # a parent that is no cell ends a walk at the last pass
    cells = _tiled(nodes.select("id", "parent", F.col("link").cast("double").alias("link")), info, tile)
    cells = cut(cells.join(starts.select("id", F.lit(True).alias("begin")).distinct(), "id", "left").select("tr", "tc", "r", "c", "id", "parent", "link", F.coalesce("begin", F.lit(False)).alias("begin")), "links")
    kind = starts.schema["start"].dataType.simpleString()
    least = limit_m + 1e-9

    def ways(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        forest, link = Forest(pdf), pdf.link.to_numpy(float)
        end, steps, length = forest.follow(np.zeros(len(pdf), bool), link)
        out = (forest.raw[end] >= 0) & forest.ordered & (forest.inner[end] < 0)
        k = np.flatnonzero((_rim(pdf, info, tile) | pdf.begin.to_numpy(bool)) & out)
        return pd.DataFrame({"id": forest.ids[k], "at": forest.raw[end[k]], "steps": steps[k] + 1, "length": length[k] + link[end[k]]})

    within = F.col("length") <= least
    hops = [State("hops").put(cells.groupBy("tr", "tc").applyInPandas(ways, "id long, at long, steps long, length double").filter(within))]
    most = hops[0].count().bit_length() + 1
    while True:
        ahead = hops[-1].select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("length").alias("further"))
        further = hops[-1].join(ahead, "at").select("id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("length") + F.col("further")).alias("length"))
        further = State("hops").put(further.filter(within))
        if not further.limit(1).count():
            break
        hops.append(further)
        if len(hops) > most:
            raise CycleError("the receivers hold a cycle")

    store = State("walk")
    places = store.put(starts.select("start", "id").join(cells.select("id"), "id").select("start", "id", F.lit(0).cast("long").alias("pos"), F.lit(0.0).alias("cum_m")))
    for hop in reversed(hops):
        moved = places.join(hop, "id").select("start", F.col("at").alias("id"), (F.col("pos") + F.col("steps")).alias("pos"), (F.col("cum_m") + F.col("length")).alias("cum_m"))
        places = store.put(places.unionByName(moved.filter(F.col("cum_m") <= least)))

    def run(key: tuple, walks: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        below = {i: (p, d) for i, p, d in zip(own.id.tolist(), own.parent.tolist(), own.link.tolist(), strict=True)}
        rows = []
        for start, i, pos, cum in zip(walks.start.tolist(), walks.id.tolist(), walks.pos.tolist(), walks.cum_m.tolist(), strict=True):
            seen = 0
            while i in below:
                rows.append((start, pos, i, cum))
                p, d = below[i]
                if p is None or p != p or cum + d > least:
                    break
                i, pos, cum, seen = int(p), pos + 1, cum + d, seen + 1
                if seen > len(below) and limit_m == float("inf"):
                    raise CycleError("the receivers hold a cycle")
        return pd.DataFrame(rows, columns=["start", "pos", "id", "cum_m"])

    front = _tiled(places, info, tile).select("tr", "tc", "start", "id", "pos", "cum_m")
    here = cells.join(front.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi").select("tr", "tc", "id", "parent", "link")
    return cut(front.groupBy("tr", "tc").cogroup(here.groupBy("tr", "tc")).applyInPandas(run, f"start {kind}, pos int, id long, cum_m double"), "walk")
