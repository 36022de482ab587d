"""Outlines traced in tiles against a plain tracer."""

import numpy as np
import pytest

from fluvispark.operators import geometry, rings
from fluvispark.sources.grids import GridInfo


def plain_rings(mask):
    """Simple rings as lists of corners where they turn, cells on the left; from edge to edge, split where a corner comes twice."""
    step = {}
    for r, c in mask:
        for inside, a, b in (((r - 1, c), (r, c + 1), (r, c)), ((r, c - 1), (r, c), (r + 1, c)), ((r + 1, c), (r + 1, c), (r + 1, c + 1)), ((r, c + 1), (r + 1, c + 1), (r, c + 1))):
            if inside not in mask:
                step.setdefault(a, []).append(b)
    out, left = [], {(a, b) for a, bs in step.items() for b in bs}
    while left:
        a, b = min(left)
        edges = [(a, b)]
        while True:
            (a, b), ways = edges[-1], step[edges[-1][1]]
            d = (b[0] - a[0], b[1] - a[1])
            turned = (b[0] - d[1], b[1] + d[0])
            then = (b, turned if turned in ways else ways[0])
            if then == edges[0]:
                break
            edges.append(then)
        left -= set(edges)
        stack = []
        for e in edges:
            known = [k for k, x in enumerate(stack) if x[0] == e[0]]
            if known:
                out.append(stack[known[0] :])
                del stack[known[0] :]
            stack.append(e)
        out.append(stack)
    return [[e[1] for k, e in enumerate(loop) if (e[1][0] - e[0][0], e[1][1] - e[0][1]) != (loop[(k + 1) % len(loop)][1][0] - e[1][0], loop[(k + 1) % len(loop)][1][1] - e[1][1])] for loop in out]


def canonical(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


def parts_of(mask):
    left, out = set(mask), []
    while left:
        todo, own = [left.pop()], set()
        while todo:
            r, c = todo.pop()
            own.add((r, c))
            for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(own)
    return out


def traced(spark, zones, info, tile):
    rows = [(z, r, c) for z, mask in zones.items() for r, c in mask]
    found, vertices = rings.trace(spark.createDataFrame(rows + rows[:5], "outlet string, r int, c int").repartition(4), info, tile)
    at = {}
    for v in vertices.collect():
        at.setdefault((v.outlet, v.ring), []).append((v.pos, (v.r, v.c)))
    return found.collect(), {k: [p for _, p in sorted(v)] for k, v in at.items()}


def zones():
    rng = np.random.default_rng(7)
    n, m = 23, 19
    grid = [(r, c) for r in range(n) for c in range(m)]
    out = {"full": set(grid), "dot": {(0, 0)}, None: {(22, 18), (22, 17)}}
    for k, share in enumerate((0.45, 0.6, 0.85)):
        out[f"random{k}"] = {p for p in grid if rng.random() < share}
    out["rings"] = {(r, c) for r, c in grid if max(abs(r - 11), abs(c - 9)) % 2 == 0}
    out["diagonals"] = {(r, c) for r, c in grid if (r + c) % 2 == 0}
    out["bow"] = {(r, c) for r in range(2, 12) for c in range(2, 12)} - {(3, 3), (4, 4), (5, 5), (5, 7), (2, 8), (3, 9), (4, 8)}
    out["spiral"] = {p for p in grid if (p[0] % 4 != 3 or p[1] == (0 if p[0] % 8 == 7 else m - 1))}
    return out, GridInfo(n, m, 100.0, 900.0, 10.0, 5.0)


@pytest.mark.parametrize("tile", [4, 7, 256])
def test_rings_equal_plain_ones(spark, tile):
    own, info = zones()
    found, at = traced(spark, own, info, tile)
    assert {r.outlet for r in found} == set(own)
    for z, mask in own.items():
        want = sorted(map(canonical, plain_rings(mask)))
        assert sorted(canonical(at[z, r.ring]) for r in found if r.outlet == z) == want, z
        mine = [r for r in found if r.outlet == z]
        assert sum(r.cells for r in mine) == len(mask) and all(len(at[z, r.ring]) == r.vertices and r.hole == (r.cells < 0) for r in mine)
        parts = {}
        for r in mine:
            parts.setdefault(r.part, []).append(r)
        assert sorted(sum(r.cells for r in p) for p in parts.values()) == sorted(map(len, parts_of(mask)))
        assert all(sum(not r.hole for r in p) == 1 for p in parts.values())


def test_names_do_not_depend_on_tiles(spark):
    own, info = zones()
    several = [sorted((r.outlet or "", r.ring, r.part, r.cells, r.edges, r.vertices) for r in traced(spark, own, info, tile)[0]) for tile in (9, 64)]
    assert several[0] == several[1]


def test_strung():
    first, steps = rings.strung(np.array([1, 2, -1, 4, 5, 3, 6]), np.array([10, 11, 12, 9, 7, 8, 1]))
    assert first.tolist() == [0, 0, 0, 4, 4, 4, 6] and steps.tolist() == [0, 1, 2, 2, 0, 1, 0]


def test_no_zone(spark):
    none = spark.createDataFrame([], "outlet int, r int, c int")
    found, vertices = rings.trace(none, GridInfo(5, 5))
    assert found.count() == 0 and vertices.count() == 0 and geometry.zone_polygons(none, GridInfo(5, 5)).count() == 0


def test_polygons(spark):
    own, info = zones()
    rows = [(z, r, c) for z, mask in own.items() for r, c in mask]
    for row in geometry.zone_polygons(spark.createDataFrame(rows, "outlet string, r int, c int"), info, 8).collect():
        mask, plain = own[row.outlet], plain_rings(own[row.outlet])
        assert abs(row.area_m2 - 50 * len(mask)) < 1e-6 and row.n_parts == len(parts_of(mask))
        assert (row.n_holes, row.n_vertices) == (len(plain) - row.n_parts, sum(len(p) + 1 for p in plain))
        _, parts = geometry.parse_wkb(bytes(row.wkb))
        assert abs(sum(geometry.signed_area(r[:-1]) for p in parts for r in p) - row.area_m2) < 1e-6
        assert all(geometry.signed_area(p[0][:-1]) > 0 and all(geometry.signed_area(h[:-1]) < 0 for h in p[1:]) for p in parts)
