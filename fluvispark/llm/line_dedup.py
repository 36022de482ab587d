"""Line dedup over overlapping three-line windows.

Every run of ``WINDOW`` consecutive lines of a document is hashed to 128 bits; windows that occur more than
once anywhere are found by a group-by on their hash; every occurrence but the first (least doc_id,
then least position) covers its lines, and covered lines are removed. Overlapping windows thus
merge into whole repeated passages without any pairwise comparison.

Scale. Only (hash, doc_id, position) is shuffled. The group-by keeps one row a hash, pre-aggregated
before the shuffle, so a window that a third of all documents share is no hot task; occurrences
return through a join on repeated hashes alone, whose skew adaptive execution splits (it may, since
the other side has one row a hash).

Lines are the parts between line feeds, compared without surrounding white space; blank lines
are in no window and are kept unless the lines around them are both removed. Defined results: a null text stays null; a
text of fewer than three non-blank lines has no window and is left alone; a document's own
repeated windows count like any others; repeated doc_ids are distinct rows, told apart by text
(rows equal in id and text are one row for finding windows, and each is cleaned).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 3
WHITE = " \t\n\x0b\x0c\r"


def _lines(text: str) -> Column:
    """The non-blank lines, trimmed, with their positions (from 0)."""
    parts = F.transform(F.split(F.col(text), "\n", -1), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(WHITE)).alias("s")))
    return F.filter(parts, lambda x: x["s"] != "")


def windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, part, h, first, last): the hash and the positions of each window; ``part`` tells texts of one id apart."""
    lines = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("part"), _lines("text").alias("lines"))
    starts = F.when(F.size("lines") >= width, F.sequence(F.lit(1), F.size("lines") - (width - 1))).otherwise(F.array().cast("array<int>"))

    def window(k: Column) -> Column:
        own = F.slice("lines", k, width)
        texts = [F.element_at(F.col("lines"), k + j)["s"] for j in range(width)]
        # one hash of the lines in order and another of them in reverse, after a number
        h = F.struct(F.xxhash64(*texts).alias("a"), F.xxhash64(F.lit(width), *texts[::-1]).alias("b"))
        return F.struct(h.alias("h"), own[0]["i"].alias("first"), own[width - 1]["i"].alias("last"))

    return lines.select("doc_id", "part", F.explode(F.transform(starts, window)).alias("w")).select("doc_id", "part", "w.h", "w.first", "w.last")


def covered(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, part, spans): the windows of each document that occurred before."""
    found = windows(docs, width).distinct()
    heads = found.groupBy("h").agg(F.min(F.struct("doc_id", "part", "first")).alias("head"), F.max(F.struct("doc_id", "part", "first")).alias("other"))
    repeated = heads.filter("head <> other").select("h", "head")
    later = found.join(repeated, "h").filter(F.struct("doc_id", "part", "first") != F.col("head"))
    return later.groupBy("doc_id", "part").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and any more columns, of whatever names) with repeated lines removed from ``text``, plus n_lines and n_removed (replaced if there)."""
    own_id, part, found, lines, kept = C.fresh([*docs.columns, "n_lines", "n_removed"], "_id", "_part", "_spans", "_lines", "_kept")
    spans = covered(docs.select("doc_id", "text"), width).select(F.col("doc_id").alias(own_id), F.col("part").alias(part), F.col("spans").alias(found))
    joined = docs.join(spans, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64("text") == F.col(part)), "left")
    # the windows of a text, in order of their first lines, are in order of their last lines too: what is kept lies between one's last and the next one's first
    n = F.size(found)

    def between(k: Column) -> Column:
        after = F.when(k > 0, F.get(found, k - 1)["last"] + 1).otherwise(0)
        until = F.when(k < n, F.get(found, k)["first"]).otherwise(F.size(lines))
        return F.slice(lines, after + 1, F.greatest(until - after, F.lit(0)))

    return (
        joined.withColumn(lines, F.split("text", "\n", -1))
        .withColumn(kept, F.when(F.col(found).isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), n), between))))
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.when(F.col(found).isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long"))
        .withColumn("text", F.when(F.col(found).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .drop(own_id, part, found, lines, kept)
    )
