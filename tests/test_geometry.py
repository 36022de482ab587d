import numpy as np

from fluvispark.operators import geometry as G
from fluvispark.sources.grids import GridInfo


def test_outline_area_is_the_cells_area():
    r = np.random.default_rng(2)
    for _ in range(20):
        mask = {(i, j) for i in range(9) for j in range(9) if r.random() < 0.6}
        rings = G.outline(mask)
        assert abs(sum(G.signed_area([(c, -q) for q, c in ring]) for ring in rings) + len(mask)) < 1e-9


def test_ring_with_a_hole():
    mask = {(i, j) for i in range(3) for j in range(3)} - {(1, 1)}
    assert sorted(len(r) for r in G.outline(mask)) == [4, 4]


def test_line_cells_touch():
    for b in ((0, 0), (3, 7), (-4, 2), (5, -5)):
        cells = G.line_cells((0, 0), b)
        assert cells[0] == (0, 0) and cells[-1] == b
        assert all(max(abs(p[0] - q[0]), abs(p[1] - q[1])) == 1 for p, q in zip(cells, cells[1:]))


def test_wkb_round_trip():
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    assert G.parse_wkb(G.wkb_point(1.5, 2.5)) == ("Point", (1.5, 2.5))
    assert G.parse_wkb(G.wkb_line(ring)) == ("LineString", ring)
    assert G.parse_wkb(G.wkb_polygon([ring])) == ("Polygon", [ring])


def test_rasterised_outline_is_the_mask(spark):
    r = np.random.default_rng(4)
    info = GridInfo(8, 9)
    mask = [(i, j) for i in range(8) for j in range(9) if r.random() < 0.6]
    member = spark.createDataFrame([("X", i, j) for i, j in mask], "outlet string, r int, c int")
    edges = []
    for row in G.zone_outlines(member, info).collect():
        p = list(zip(row.xs, row.ys))
        edges += [("X", *a, *b) for a, b in zip(p, [*p[1:], p[0]])]
    got = G.rasterize(spark.createDataFrame(edges, "zone string, x0 double, y0 double, x1 double, y1 double"), info)
    assert sorted((x.r, x.c) for x in got.collect()) == sorted(mask)
