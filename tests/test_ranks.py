"""Dense numbers, exact quantiles, interval joins and cycles, against plain code."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fluvispark.operators import graph, intervals, ranks
from fluvispark.sources.grids import GridInfo


def test_numbers_have_no_gaps(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 1, 1, 2, 50]), rng.choice("ab")) for k in range(3000)]
    df = spark.createDataFrame(rows, "k int, v int, s string").repartition(7)
    got, n = ranks.numbered(df, [F.desc("v"), F.col("s"), F.col("k")], "number", 5)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert n == 3000 and [(r.k, r.number) for r in got.orderBy("number").collect()] == [(r[0], i + 5) for i, r in enumerate(want)]
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    none, n = ranks.numbered(df.limit(0), [F.col("k")])
    assert n == 0 and none.count() == 0


def plain_quantile(values, p):
    """Linear between neighbouring ranks; NaN is the greatest."""
    own = sorted(values, key=lambda v: (math.isnan(v), v))
    at = (len(own) - 1) * p
    low, high = own[math.floor(at)], own[math.ceil(at)]
    return low + (high - low) * (at - math.floor(at)) if high != low else low


def test_quantiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.choice([None, 3.0, 3.0, 3.0, rng.random(), rng.gauss(0, 100)]), float(rng.randint(0, 4))) for _ in range(4000)] + [("one", 7.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").repartition(6)
    shares = [0.0, 0.1, 0.5, 0.75, 0.995, 1.0]
    wanted = {f"x{i}": (F.col("x"), p) for i, p in enumerate(shares)} | {"y": (F.col("y"), 0.5), "x2": (F.col("x") * 2, 0.5)}
    got = {r.k: r for r in ranks.quantiles(df, wanted, ("k",)).collect()}
    assert set(got) == {None, "a", "b", "one"}
    for k in got:
        x, y = ([r[c] for r in rows if r[0] == k and r[c] is not None] for c in (1, 2))
        for i, p in enumerate(shares):
            want = plain_quantile([2 * v for v in x], 0.5) if i == 2 else plain_quantile(x, p)
            assert abs(got[k][f"x{i}"] - want) < 1e-9
        assert got[k].y == (plain_quantile(y, 0.5) if y else None)
    whole = ranks.quantiles(df, {"q": (F.col("x"), 0.3)}).collect()
    assert len(whole) == 1 and abs(whole[0].q - plain_quantile([r[1] for r in rows if r[1] is not None], 0.3)) < 1e-9
    assert ranks.quantiles(df.limit(0), {"q": (F.col("x"), 0.3)}).collect()[0].q is None


def test_quantiles_look_at_few_rows_a_task(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        df = spark.range(0, 40_000, 1, 8).select((F.col("id") % 20_000).cast("double").alias("x"), F.lit(1).alias("k"))
        seen = []
        cut = ranks.cut
        ranks.cut = lambda d, label: seen.append(cut(d, label)) or seen[-1]
        try:
            assert ranks.quantiles(df, {"q": (F.col("x"), 0.5)}, ("k",)).first().q == 9999.5
        finally:
            ranks.cut = cut
        sizes = [r.n for r in seen[0].groupBy("_part").agg(F.count("*").alias("n")).collect()]
        assert len(sizes) > 20 and max(sizes) < 20_000 / 40 * 4  # one group over many ranges; each value once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("closed", [False, True])
def test_overlaps(spark, closed):
    rng = random.Random(3)

    def layer(n, tag):
        out = []
        for k in range(n):
            start = rng.choice([None, *[float(rng.randint(-40, 40)) / 2] * 20])
            length = rng.choice([0, 0.5, 1, 1, 2, 3, 40, -2, 0.001])
            out.append((rng.choice([None, 0, 0, 1, 2]), f"{tag}{k}", start, None if start is None else start + length))
        return out

    a, b = layer(150, "a"), layer(120, "b")
    left = spark.createDataFrame(a, "road int, left_id string, a0 double, a1 double").repartition(3)
    right = spark.createDataFrame(b, "road int, right_id string, b0 double, b1 double").repartition(2)
    got = sorted((r.left_id, r.right_id, r.overlap_start, r.overlap_end) for r in intervals.overlaps(left, right, ("a0", "a1"), ("b0", "b1"), ("road",), closed).collect())
    want = []
    for k, i, s, e in a:
        for m, j, u, v in b:
            if k is not None and k == m and None not in (s, u):
                lo, hi = max(s, u), min(e, v)
                proper = (e >= s and v >= u and lo <= hi) if closed else (e > s and v > u and lo < hi)
                if proper:
                    want.append((i, j, lo, hi))
    assert got == sorted(want)
    with pytest.raises(ValueError, match="road"):
        intervals.overlaps(left, right, ("a0", "a1"), ("b0", "b1"))
    assert intervals.overlaps(left.limit(0), right, ("a0", "a1"), ("b0", "b1"), ("road",)).count() == 0


# --- cycles -------------------------------------------------------------------------------------------

STEP = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))


def plain_accumulation(flow, rows, cols):
    parent = {}
    for (r, c), d in flow.items():
        p = (r + STEP[d][0], c + STEP[d][1]) if d is not None else None
        parent[r, c] = p if p in flow else None
    total, degree = dict.fromkeys(flow, 0.0), dict.fromkeys(flow, 0)
    for p in parent.values():
        if p:
            degree[p] += 1
    ready = [x for x in flow if not degree[x]]
    done = set()
    while ready:
        x = ready.pop()
        done.add(x)
        p = parent[x]
        if p:
            total[p] += total[x] + 1
            degree[p] -= 1
            if not degree[p]:
                ready.append(p)
    return {x: total[x] if x in done else None for x in flow}


@pytest.mark.parametrize("tile", [3, 4, 256])
def test_cycles_over_tiles(spark, tile):
    rng = random.Random(5)
    rows, cols = 12, 13
    flow = {(r, c): rng.choice([0, 2, 2, 1, 4, None]) for r in range(rows) for c in range(cols) if rng.random() < 0.95}
    ring = [(r, 2) for r in range(2, 9)] + [(9, c) for c in range(2, 10)] + [(r, 10) for r in range(9, 2, -1)] + [(2, c) for c in range(10, 2, -1)]
    for k, x in enumerate(ring):  # one cycle over many tiles
        y = ring[(k + 1) % len(ring)]
        flow[x] = STEP.index((y[0] - x[0], y[1] - x[1]))
    flow[5, 5], flow[5, 6] = 0, 4  # and one of two cells
    got = graph.flow_accumulation(spark.createDataFrame([(r, c, d) for (r, c), d in flow.items()], "r int, c int, dir int"), GridInfo(rows, cols), tile=tile)
    want = plain_accumulation(flow, rows, cols)
    assert {(r.r, r.c): r.acc for r in got.collect()} == want
    count = graph.cells_in_cycles(got).first()
    assert (count.cells, count.in_cycles) == (len(flow), sum(v is None for v in want.values())) and count.in_cycles >= len(ring) + 2


def test_cycles_are_named_by_their_least_node(spark):
    links = {k: k + 1 for k in range(1, 40)} | {40: 30, 50: 51, 51: 50, 60: 50, 70: 70, 80: 81, 81: None}
    got = graph.cycles(spark.createDataFrame(list(links.items()), "id long, parent long"))
    assert {r.id: r.cycle for r in got.collect()} == {**dict.fromkeys(range(30, 41), 30), 50: 50, 51: 50, 70: 70}
    with pytest.raises(graph.CycleError):
        graph.accumulate(spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "id long, parent long, w double"))
