"""Routing against closed forms and plain Python."""

import numpy as np
import pytest

from fluvispark.operators import drainage, fill, graph, stencil, uncertainty
from fluvispark.sources.grids import GridInfo


def cells(spark, z):
    return spark.createDataFrame([(i, j, float(z[i, j])) for i in range(z.shape[0]) for j in range(z.shape[1]) if not np.isnan(z[i, j])], "r int, c int, z double")


def routed(spark, z, tile):
    info = GridInfo(*z.shape)
    own = cells(spark, z)
    filled = fill.fill_depressions(own, info, tile=tile).select("r", "c", F_filled())
    flow = fill.resolve_flats(stencil.d8(filled, info).join(filled, ["r", "c"]), info)
    return graph.flow_accumulation(flow, info, tile=tile), info


def F_filled():
    from pyspark.sql import functions as F

    return F.col("filled").alias("z")


def test_single_pit_is_raised_to_its_lowest_neighbour(spark):
    z = 100.0 - np.arange(20)[:, None] * np.ones((1, 20))
    z[10, 10] -= 5
    got = {(r.r, r.c): r for r in fill.fill_depressions(cells(spark, z), GridInfo(20, 20), tile=8).collect()}
    assert got[10, 10].filled == 89 and sum(r.raised for r in got.values()) == 1 and sum(r.seed for r in got.values()) == 76


def test_every_cell_of_a_walled_plateau_is_routed(spark):
    z = np.full((15, 15), 50.0)
    z[-1] = 40
    acc, info = routed(spark, z, 8)
    rows = acc.collect()
    assert all(r.acc is not None and r.acc == r.acc for r in rows)
    inner = [r for r in rows if 0 < r.r < 14 and 0 < r.c < 14]
    assert all(r.dir is not None for r in inner)
    assert sum(r.acc + 1 for r in rows if r.parent is None) == 225


@pytest.mark.parametrize("tile", [5, 64])
def test_tiled_accumulation_equals_direct(spark, tile):
    z = np.random.default_rng(1).random((17, 13)) + np.arange(17)[:, None]
    info = GridInfo(17, 13)
    flow = stencil.d8(cells(spark, z), info, tile=tile)
    got = {r.id: r for r in graph.flow_accumulation(flow, info, tile=tile).collect()}
    want = dict.fromkeys(got, 0)
    for i in got:
        at = got[i].parent
        while at is not None:
            want[at] += 1
            at = got[at].parent
    assert {i: r.acc for i, r in got.items()} == want


def test_strahler_of_a_confluence(spark):
    # two sources join, then meet a third
    parent = {0: 2, 1: 2, 2: 4, 3: 4, 4: None}
    flow = spark.createDataFrame([(i, p) for i, p in parent.items()], "id long, parent long")
    got = {r.id: r["order"] for r in drainage.strahler(flow, flow).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 1, 4: 2}


def test_error_field_has_its_deviation_and_correlation():
    f = uncertainty.error_field(0, 0, 200, 200, 2.5, 5.0, 7, 1)
    assert abs(f.std() - 2.5) < 0.25
    assert abs(np.corrcoef(f[:, :-5].ravel(), f[:, 5:].ravel())[0, 1] - np.exp(-1)) < 0.08
