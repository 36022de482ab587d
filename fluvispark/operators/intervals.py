"""Joins of intervals with intervals by where they overlap.

Intervals are put into levels by length (powers of two) and bins of their level's width: an interval lies in at most two bins of its own level and of any wider one. Two
intervals that overlap share a bin at the wider one's level; so each is listed at its own level for all narrower ones of the other side, and at each wider level that
is in use for those of that level alone. The join is on (key, level, bin), an equality that spreads a key over as many bins as its intervals are long; a pair is kept
in the bin where its overlap begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _levelled(rows: DataFrame, start: str, end: str, tag: str) -> DataFrame:
    length = F.col(end).cast("double") - F.col(start).cast("double")
    level = F.when(length > 0, F.ceil(F.log2(length)).cast("int"))
    return rows.withColumn(f"_level{tag}", level)


def _listed(rows: DataFrame, start: str, end: str, tag: str, levels: list[int]) -> DataFrame:
    """A row for each bin at the own level and at each wider one in use; points and empty intervals begin at the narrowest."""
    own = F.coalesce(F.col(f"_level{tag}"), F.lit(levels[0]))
    wider = F.filter(F.array(*map(F.lit, levels)), lambda m: m >= own)
    at = lambda x, m: F.floor(F.col(x).cast("double") / F.pow(F.lit(2.0), m.cast("double"))).cast("long")
    rows = rows.withColumn("_m", F.explode(wider)).withColumn(f"_own{tag}", F.col("_m") == own)
    return rows.withColumn("_bin", F.explode(F.sequence(at(start, F.col("_m")), at(end, F.col("_m")))))


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: tuple[str, ...] = (), closed: bool = False) -> DataFrame:
    """Pairs of rows of ``left`` and ``right`` (columns of both; names must differ but for ``keys``) that agree in ``keys`` and whose intervals overlap, with ``overlap_start`` and ``overlap_end``.

    Half-open intervals, unless ``closed``: touching ones do not overlap, and empty ones (end at or before start) overlap nothing. Closed ones overlap if they share a point; those that end before they
    start overlap nothing. Nulls in keys or ends overlap nothing.
    """
    (a0, a1), (b0, b1) = left_ends, right_ends
    clash = (set(left.columns) & set(right.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(sorted(clash))}")
    fit = lambda s, e: (F.col(e) >= F.col(s)) if closed else (F.col(e) > F.col(s))
    left, right = _levelled(left.filter(fit(a0, a1)), a0, a1, "a"), _levelled(right.filter(fit(b0, b1)), b0, b1, "b")
    # the levels in use: at most some two thousand numbers, as doubles have exponents
    levels = sorted({r[0] for r in left.select(F.col("_levela").alias("m")).union(right.select("_levelb")).distinct().collect() if r[0] is not None}) or [0]
    left, right = _listed(left, a0, a1, "a", levels), _listed(right, b0, b1, "b", levels)
    start, end = F.greatest(F.col(a0), F.col(b0)), F.least(F.col(a1), F.col(b1))
    pairs = left.join(right, [*keys, "_m", "_bin"]).filter(F.col("_owna") | F.col("_ownb"))
    first = F.floor(start.cast("double") / F.pow(F.lit(2.0), F.col("_m").cast("double"))).cast("long") == F.col("_bin")
    meet: Column = start <= end if closed else start < end
    return pairs.filter(meet & first).withColumn("overlap_start", start).withColumn("overlap_end", end).drop("_m", "_bin", "_owna", "_ownb", "_levela", "_levelb")
