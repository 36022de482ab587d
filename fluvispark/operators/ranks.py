"""Dense numbers and exact quantiles by range partitions: what an order needs of the whole table is a number a partition.

Rows are dealt to ranges of the order and sorted there, once; counts of the ranges give each its offset, or say in which range a rank lies. No window and no sort
spans the table, and no task holds more than its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.grids import cut

#: monotonically_increasing_id: the partition above, the row's number in it below
ROW_BITS = 33


def numbered(rows: DataFrame, order: list[Column], column: str = "n", start: int = 1) -> tuple[DataFrame, int]:
    """(``rows`` with their numbers in ``order`` from ``start`` without gaps, how many they are). Rows that tie in the order get different numbers; order by more columns if it matters which."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    written = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", ROW_BITS).cast("int")
    counts = {r.part: r.n for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, offsets = start, []
    for k in sorted(counts):
        offsets.append((k, before))
        before += counts[k]
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _before long")
    at = F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return written.withColumn("_part", part).join(table, "_part").withColumn(column, at + F.col("_before")).drop("_at", "_part", "_before"), before - start


def padded(number: Column, most: int, width: int = 3) -> Column:
    """A number as text with leading zeros, as wide as the greatest needs, at least ``width``."""
    return F.lpad(number.cast("string"), max(width, len(str(most))), "0")


def quantiles(rows: DataFrame, wanted: dict[str, tuple[Column, float]], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a column each of ``wanted``): the exact quantiles (column, share) of each group, interpolated between neighbouring ranks; nulls do not count, NaN is the greatest.

    Equal values are counted before anything is shuffled; the different ones are dealt to ranges of (keys, column, value), whose counts tell which ranges hold the wanted
    ranks, and only those are looked through. A group without a value has no row (without keys: nulls).
    """
    names = list(wanted)
    columns = {repr(c): c for c, _ in wanted.values()}
    places = {text: k for k, text in enumerate(columns)}
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), c.cast("double").alias("x")) for k, c in enumerate(columns.values())]))
    group = [*keys, "_v"]
    flat = rows.select(*keys, values.alias("_e")).select(*keys, F.col("_e.v").alias("_v"), F.col("_e.x").alias("_x")).filter("_x is not null")
    counted = flat.groupBy(*group, "_x").agg(F.count("*").alias("_n"))
    ranged = cut(counted.repartitionByRange(*group, "_x").withColumn("_part", F.spark_partition_id()), "ranges")
    blocks = ranged.groupBy(*group, "_part").agg(F.sum("_n").alias("_n"))
    own = Window.partitionBy(*group)
    blocks = blocks.select(*group, "_part", "_n", (F.sum("_n").over(own.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("_total"))
    asked = F.array(*[F.struct(F.lit(k).alias("i"), F.lit(places[repr(c)]).alias("v"), F.lit(float(p)).alias("p"), F.lit(up).alias("up")) for k, (c, p) in enumerate(wanted.values()) for up in (0, 1)])
    ranks = blocks.withColumn("_a", F.explode(asked)).filter("_a.v = _v")
    at = (F.col("_total") - 1) * F.col("_a.p")
    rank = F.when(F.col("_a.up") == 1, F.ceil(at)).otherwise(F.floor(at))
    held = ranks.select(*group, "_part", "_before", "_n", F.col("_a.i").alias("_i"), F.col("_a.up").alias("_up"), rank.cast("long").alias("_rank"), (at - F.floor(at)).alias("_share"))
    held = cut(held.filter("_rank >= _before and _rank < _before + _n").select(*group, "_part", "_i", "_up", (F.col("_rank") - F.col("_before")).alias("_rank"), "_share"), "ranks")
    named = held.select(*[F.col(c).alias(f"_k{c}") for c in (*group, "_part")], "_i", "_up", "_rank", "_share")
    same = [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in (*group, "_part")]
    match = same[0]
    for s in same[1:]:
        match = match & s
    looked = ranged.join(named.select(*[f"_k{c}" for c in (*group, "_part")]).distinct(), match, "left_semi")
    upto = F.sum("_n").over(Window.partitionBy(*group, "_part").orderBy("_x"))
    found = looked.withColumn("_upto", upto).join(named, match & (F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto")))
    pick = lambda k, up, c="_x": F.max(F.when((F.col("_i") == k) & (F.col("_up") == up), F.col(c)))
    low = [pick(k, 0) for k in range(len(names))]
    out = found.groupBy(*keys).agg(*[F.when(pick(k, 0, "_share") == 0, a).otherwise(a + (pick(k, 1) - a) * pick(k, 0, "_share")).alias(n) for k, (n, a) in enumerate(zip(names, low, strict=True))])
    return out
