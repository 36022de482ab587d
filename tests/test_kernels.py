"""Tiled kernels against plain Python, at tiles smaller than the grid."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvispark.operators import drainage, fill, graph, stencil
from fluvispark.operators.stencil import OFFSETS
from fluvispark.sources.grids import GridInfo


def cells(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])], "r int, c int, z double")


def neighbours(z, i, j):
    for k, (di, dj) in enumerate(OFFSETS):
        a, b = i + di, j + dj
        if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and not np.isnan(z[a, b]):
            yield k, a, b


def flooded(z):
    seeds = [(i, j) for i, j in np.argwhere(~np.isnan(z)).tolist() if len(list(neighbours(z, i, j))) < 8]
    out = {s: z[s] for s in seeds}
    heap = [(z[s], s) for s in seeds]
    heapq.heapify(heap)
    while heap:
        v, (i, j) = heapq.heappop(heap)
        if v > out[i, j]:
            continue
        for _, a, b in neighbours(z, i, j):
            new = max(z[a, b], v)
            if new < out.get((a, b), math.inf):
                out[a, b] = new
                heapq.heappush(heap, (new, (a, b)))
    return out


def surface(seed, shape=(41, 37), holes=0.05, step=0.5):
    r = np.random.default_rng(seed)
    z = np.round(r.random(shape) * 12 / step) * step + 0.2 * np.arange(shape[1])
    z[r.random(shape) < holes] = np.nan
    return z


@pytest.mark.parametrize(("seed", "tile", "holes"), [(1, 4, 0.05), (2, 5, 0.0), (3, 64, 0.1), (4, 7, 0.3)])
def test_filling_over_several_levels_of_blocks(spark, seed, tile, holes):
    z = surface(seed, holes=holes)
    got = {(x.r, x.c): x.filled for x in fill.fill_depressions(cells(spark, z), GridInfo(*z.shape), tile=tile).collect()}
    assert got == flooded(z)


def test_filling_a_bowl_without_boundary_of_its_own(spark):
    z = np.full((20, 20), 9.0)
    z[5:15, 5:15] = 1.0
    z[9, 9] = -3.0
    got = {(x.r, x.c): x.filled for x in fill.fill_depressions(cells(spark, z), GridInfo(20, 20), tile=4).collect()}
    assert set(got.values()) == {9.0}


def plain_flats(z, dirs, weight=2, toward_only=False, small=0):
    """Pass after pass: distances over equal elevation from the outlets and from higher ground, then the lowest mask."""
    tol = 0.0 if toward_only else 1e-9
    scan = list(range(8)) if toward_only else [4, 5, 6, 7, 0, 1, 2, 3]
    order = (lambda k: scan.index(k)) if toward_only else (lambda k: (k % 2, scan.index(k)))
    here = [tuple(p) for p in np.argwhere(~np.isnan(z)).tolist()]
    drain = {p for p in here if dirs.get(p) is None and len(list(neighbours(z, *p))) < 8}
    dirs = dict(dirs)

    def layers(start, flat):
        level, front = dict.fromkeys(start, 1), list(start)
        while front:
            new = []
            for p in front:
                for _, a, b in neighbours(z, *p):
                    if (a, b) in flat and (a, b) not in level and abs(z[a, b] - z[p]) <= tol:
                        level[a, b] = level[p] + 1
                        new.append((a, b))
            front = new
        return level

    while True:
        flat = {p for p in here if dirs.get(p) is None and p not in drain}
        outs = {}
        for p in flat:
            exits = [k for k, a, b in neighbours(z, *p) if (dirs.get((a, b)) is not None or (a, b) in drain) and z[a, b] <= z[p] + tol]
            if exits:
                outs[p] = min(exits, key=order)
        toward = layers(outs, flat)
        mask = dict(toward)
        if not toward_only:
            reached = set(toward)
            high = [p for p in reached if p not in outs and any(z[a, b] > z[p] + tol for _, a, b in neighbours(z, *p))]
            away = layers(high, reached)
            label = {}
            for p in sorted(reached):
                if p not in label:
                    for q in layers([p], reached):
                        label[q] = p
            height, size = {}, {}
            for p in reached:
                size[label[p]] = size.get(label[p], 0) + 1
                height[label[p]] = max(height.get(label[p], 0), away.get(p, 0))
            mask = {p: (weight * toward[p] + (height[label[p]] - away[p] if p in away else 0)) if size[label[p]] > small else toward[p] for p in reached}
        new = dict(outs)
        for p in mask:
            if p not in new:
                steps = [(mask[a, b], order(k), k) for k, a, b in neighbours(z, *p) if (a, b) in mask and abs(z[a, b] - z[p]) <= tol and mask[a, b] < mask[p]]
                if steps:
                    new[p] = min(steps)[2]
        if not new:
            return dirs
        dirs.update(new)


@pytest.mark.parametrize(("method", "tile", "small"), [("barnes", 6, 0), ("toward", 6, 0), ("barnes", 64, 12)])
def test_flats_against_plain_search(spark, method, tile, small):
    z = surface(7, shape=(25, 23), holes=0.04, step=6.0)
    info = GridInfo(*z.shape)
    own = cells(spark, z)
    flow = stencil.d8(own, info).join(own, ["r", "c"]).select("r", "c", "z", "dir")
    start = {(x.r, x.c): x.dir for x in flow.collect()}
    got = {(x.r, x.c): x.dir for x in fill.resolve_flats(flow, info, method=method, tile=tile, small_flat_cells=small).collect()}
    assert got == {p: d for p, d in ((q, plain_flats(z, start, toward_only=method == "toward", small=small).get(q)) for q in got)}


def test_a_chain_of_flats_takes_as_many_passes_as_it_needs(spark):
    """Each step down the staircase is a flat that drains only once the one below it is routed: more than 50 passes."""
    n = 60
    z = np.full((3, 2 * n + 2), np.nan)
    z = np.full((5, n + 2), 500.0)
    z[2, :] = 100.0
    z[2, 0] = 99.0
    info = GridInfo(*z.shape)
    own = cells(spark, z)
    flow = stencil.d8(own, info).join(own, ["r", "c"]).select("r", "c", "z", "dir")
    got = fill.resolve_flats(flow, info, tile=8).collect()
    assert all(x.dir is not None for x in got if 0 < x.r < 4 and 0 < x.c < n + 1)


def routed(spark, seed, tile):
    z = surface(seed, shape=(33, 29), holes=0.0, step=0.01)
    info = GridInfo(*z.shape)
    flow = graph.flow_accumulation(stencil.d8(cells(spark, z), info), info, tile=tile)
    rows = {x.id: x for x in flow.collect()}
    return flow, info, rows


@pytest.mark.parametrize("tile", [4, 9, 64])
def test_descent_and_longest_ways(spark, tile):
    flow, info, rows = routed(spark, 5, tile)
    marks = {i for i in rows if i % 11 == 0}
    link = {i: 0.0 if x.parent is None else math.hypot(*(a * 30 for a in OFFSETS[x.dir])) for i, x in rows.items()}
    nodes = flow.select("id", "parent", (F.col("id") % 11 == 0).alias("marked"), drainage.link_length(info).alias("link"))
    got = {x.id: (x.target, x.steps, None if x.length is None else round(x.length, 6)) for x in graph.descend(nodes, info=info, tile=tile).collect()}
    plain = {x.id: (x.target, x.steps, None if x.length is None else round(x.length, 6)) for x in graph.descend(nodes).collect()}
    want = {}
    for i in rows:
        at, n, d = i, 0, 0.0
        while at is not None and at not in marks:
            n, d, at = n + 1, d + link[at], rows[at].parent
        want[i] = (None, None, None) if at is None else (at, n, round(d, 6))
    assert got == want and plain == want
    best = dict.fromkeys(rows, 0.0)
    for i in rows:
        at, d = i, 0.0
        while rows[at].parent is not None:
            d, at = d + link[at], rows[at].parent
            best[at] = max(best[at], d)
    longest = {x.id: x.total for x in graph.upstream_longest(nodes, info, tile=tile).collect()}
    assert set(longest) == set(best) and all(abs(longest[i] - best[i]) < 1e-6 for i in best)


@pytest.mark.parametrize("tile", [4, 64])
def test_walks_down(spark, tile):
    flow, info, rows = routed(spark, 6, tile)
    starts = sorted(rows)[::97]
    got = {}
    walked = graph.walk_down(flow.select("id", "parent", drainage.link_length(info).alias("link")), spark.createDataFrame([(i, i) for i in [*starts, 10**7]], "start long, id long"), info, 200.0, tile=tile)
    for x in walked.collect():
        got.setdefault(x.start, {})[x.pos] = (x.id, round(x.cum_m, 6))
    for i in starts:
        at, d, way = i, 0.0, []
        while True:
            way.append((at, round(d, 6)))
            x = rows[at]
            if x.parent is None or d + math.hypot(*(a * 30 for a in OFFSETS[x.dir])) > 200 + 1e-9:
                break
            d, at = d + math.hypot(*(a * 30 for a in OFFSETS[x.dir])), x.parent
        assert [got[i][k] for k in range(len(got[i]))] == way
    assert 10**7 not in got


def test_a_cycle_is_an_error(spark):
    with pytest.raises(ValueError, match="cycle"):
        graph.descend(spark.createDataFrame([(0, 1, False), (1, 0, False)], "id long, parent long, marked boolean")).collect()


def test_components_over_tiles(spark):
    r = np.random.default_rng(3)
    mask = [(i, j) for i in range(20) for j in range(22) if r.random() < 0.5]
    got = {(x.r, x.c): x.component for x in fill.connected(spark.createDataFrame([(i, j, 0.0) for i, j in mask], "r int, c int, z double"), GridInfo(20, 22), None, tile=6).collect()}
    label = {}
    for p in sorted(mask):
        if p not in label:
            todo = [p]
            label[p] = p[0] * 22 + p[1]
            while todo:
                i, j = todo.pop()
                for di, dj in OFFSETS:
                    q = (i + di, j + dj)
                    if q in set(mask) and q not in label:
                        label[q] = label[p]
                        todo.append(q)
    assert got == label


def test_a_long_walk_takes_rounds_by_its_logarithm(spark, monkeypatch):
    n = 400  # one column of 100 tiles
    nodes = spark.createDataFrame([(i, i + 1 if i + 1 < n else None, 2.0) for i in range(n)], "id long, parent long, link double")
    writes, put = [], graph.State.put
    monkeypatch.setattr(graph.State, "put", lambda self, df: writes.append(self.label) or put(self, df))
    got = graph.walk_down(nodes, spark.createDataFrame([("a", 0), ("b", 390)], "start string, id long"), GridInfo(n, 1), float("inf"), tile=4)
    rows = sorted(map(tuple, got.select("start", "pos", "id", "cum_m").collect()))
    assert rows == [("a", i, i, 2.0 * i) for i in range(n)] + [("b", i, 390 + i, 2.0 * i) for i in range(10)]
    assert len(writes) <= 20


def test_a_walk_round_a_cycle_is_an_error(spark):
    nodes = spark.createDataFrame([(i, (i + 1) % 8, 1.0) for i in range(8)], "id long, parent long, link double")
    for tile in (2, 8):
        with pytest.raises(Exception, match="cycle"):
            graph.walk_down(nodes, spark.createDataFrame([(0, 0)], "start long, id long"), GridInfo(8, 1), float("inf"), tile=tile).collect()


def test_descent_and_boundary_in_one_pass(spark):
    r = np.random.default_rng(4)
    z = {(i, j): float(r.integers(5)) for i in range(11) for j in range(7) if r.random() < 0.9}
    own, info = spark.createDataFrame([(*k, v) for k, v in z.items()], "r int, c int, z double"), GridInfo(11, 7)
    at = lambda df, *names: {(x.r, x.c): tuple(x[n] for n in names) for x in df.collect()}
    for tile in (4, 256):
        both = at(stencil.d8_surface(own, info, tile=tile), "dir", "drop", "boundary", "z")
        plain, edge = at(stencil.d8(own, info), "dir", "drop"), at(stencil.boundary(own), "boundary")
        assert both == {k: (*plain[k], *edge[k], v) for k, v in z.items()}


def test_routing_makes_its_directions_once(spark, monkeypatch):
    from fluvispark.plans import terrain

    monkeypatch.setattr(terrain, "cut", lambda df, label: df)
    flow, _ = terrain.routed(spark, "/root/testdata/sf0.001")
    # the stencil's pass is written down in the accumulation; what is left is the second pass over its tiles
    assert flow._jdf.queryExecution().optimizedPlan().toString().count("FlatMapGroupsInPandas") == 1
