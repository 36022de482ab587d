"""Document fingerprints: one-permutation MinHash with optimal densification and packed low bits.

Each distinct word shingle is hashed once; the high bits choose one of ``BINS`` bins, which keeps
its least hash. An empty bin i borrows from the first non-empty bin of its own pseudo-random probe
sequence h(i, 1), h(i, 2), ... (Shrivastava, "Optimal Densification for Fast and Accurate Minwise
Hashing", 2017). Only ``BITS`` low-order bits of each bin are kept, packed; two unrelated bins
then agree with probability 2**-BITS, which ``likeness`` corrects (Li and König, 2010).

Defined results: a null text is empty; an empty text's fingerprint is the marker ``EMPTY``, like
only itself (likeness 1); texts of fewer than ``WIDTH`` words have their whole word sequence as
their one shingle; a text with no words but white space is empty too. Equal texts have equal
fingerprints. Words are cut at ASCII white space and A-Z are lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BINS, BITS, WIDTH = 256, 4, 5
EMPTY = "-"
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_PROBES: list[np.ndarray] = []


def _probes(rounds: int) -> np.ndarray:
    """Bins tried by each empty bin, one row a round; grown on demand."""
    while len(_PROBES) < rounds:
        t = np.uint64((len(_PROBES) + 1) * 0xD1342543DE82EF95 % (1 << 64))
        _PROBES.append((C.mix(np.arange(BINS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t) % np.uint64(BINS)).astype(np.int64))
    return _PROBES


def fingerprint_of(shingle_hashes: np.ndarray) -> str:
    if not len(shingle_hashes):
        return EMPTY
    h = np.sort(shingle_hashes)
    bins = (h >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    value = np.zeros(BINS, np.uint64)
    full = np.zeros(BINS, bool)
    value[bins[first]] = h[first]
    full[bins[first]] = True
    empty, t = np.flatnonzero(~full), 0
    while len(empty):
        t += 1
        source = _probes(t)[t - 1][empty]
        hit = full[source]
        value[empty[hit]] = value[source[hit]]
        empty = empty[~hit]
    low = (C.mix(value) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    bits = np.unpackbits(low[:, None], axis=1)[:, 8 - BITS :]
    return np.packbits(bits.ravel()).tobytes().hex()


def bins_of(fingerprint: str) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bytes.fromhex(fingerprint), np.uint8)).reshape(BINS, BITS)
    return np.packbits(bits, axis=1)


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity, corrected for chance agreement of the kept bits; 0 to 1."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    share, chance = float((bins_of(a) == bins_of(b)).mean()), 2.0**-BITS
    return min(1.0, max(0.0, (share - chance) / (1 - chance)))


def fingerprints(texts: list[str]) -> list[str]:
    out = []
    for first, end, buf, offsets in C.slices(pa.array(texts, pa.large_string())):
        s, e, row = C.word_spans(C.WHITE[buf], offsets)
        words = C.span_hashes(C.BYTES[buf], s, e)
        cut = np.searchsorted(row, np.arange(end - first + 1))
        out += [fingerprint_of(C.shingles(words[cut[i] : cut[i + 1]], WIDTH)) for i in range(end - first)]
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of ``following``."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs`` (doc_id, text); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text").fill_null("").to_pylist()), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ROWS = 256


def _rows(block: list[tuple], print_of: list[str]) -> pa.RecordBatch:
    """Results for all but the last of ``block`` ((doc_id, text) in order); ``print_of`` has their fingerprints."""
    own, texts = block[:-1], [b[1] for b in block]
    changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    edit_print = fingerprints(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([b[0] for b in own], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array(print_of[:-1], pa.string()),
            pa.array(edit_print, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(print_of, edit_print, strict=False)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(print_of, print_of[1:], strict=False)], pa.float64()),
        ],
        names=[x.split()[0] for x in OUT.split(", ")],
    )


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares each row with the next of its bucket; a bucket's closing row only closes it."""
    bucket, block, prints = None, [], []
    for batch in batches:
        for part in C.pieces_of(batch, ROWS):
            rows = list(zip(*(part.column(c).to_pylist() for c in ("bucket", "doc_id", "text", "closing")), strict=True))
            found = fingerprints([r[2] for r in rows])
            for (b, doc_id, text, closing), p in zip(rows, found, strict=True):
                if b != bucket:
                    bucket, block, prints = b, [], []
                block.append((doc_id, text))
                prints.append(p)
                if closing or len(block) > ROWS:
                    if len(block) > 1:
                        yield _rows(block, prints)
                    block, prints = block[-1:], prints[-1:]


def compare_with_next(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``OUT`` per row of ``docs`` (doc_id, text), against the next row in ascending doc_id order.

    Rows go to buckets of consecutive ids, cut at quantiles of the ids alone (a column scan). The
    first row of each bucket is also sent, as its closing row, to the bucket before, so that no
    bucket needs another's output and the texts are shuffled once. Repeated ids follow one another
    in the order of their texts and share a bucket; a null id counts as the least id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * (partitions or C.pieces(docs))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    cuts = rows.agg(F.percentile_approx(key, [k / n for k in range(1, n)], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    bucket = _bucket(key, cuts)
    # ids alone: at most n rows
    firsts = [r.k for r in rows.select(key.alias("k"), bucket.alias("b")).groupBy("b").agg(F.min("k").alias("k")).orderBy("b").collect()]
    if not firsts:
        return spark.createDataFrame([], OUT)
    buckets = [int(np.searchsorted(cuts, k, "right")) for k in firsts]
    before = dict(zip(firsts, [buckets[-1], *buckets[:-1]], strict=True))
    closes = spark.createDataFrame([(k, b) for k, b in before.items()], "k long, to int")
    dealt = rows.select(bucket.alias("bucket"), "doc_id", "text", F.lit(False).alias("closing"))
    # of a repeated first id only the least text closes
    heads = rows.withColumn("k", key).join(F.broadcast(closes), "k").groupBy("k", "to").agg(F.min_by("doc_id", "text").alias("doc_id"), F.min("text").alias("text"))
    closing = heads.select(F.col("to").alias("bucket"), "doc_id", "text", F.lit(True).alias("closing"))
    return dealt.union(closing).repartition(max(1, n // 4), "bucket").sortWithinPartitions("bucket", "closing", F.col("doc_id").asc_nulls_first(), "text").mapInArrow(_chain, OUT)


def _bucket(key, cuts: list[int]):
    """The number of cuts not above ``key``; in two steps, each over about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda c: c <= key))
    group = lambda values: F.array(*[F.lit(c) for c in values])
    coarse = below(group(cuts[step - 1 :: step]))
    fine = F.array(*[group(cuts[k : k + step - 1] or [(1 << 63) - 1]) for k in range(0, len(cuts), step)], F.array().cast("array<bigint>"))
    if step == 1:
        return coarse
    return coarse * step + below(F.element_at(fine, coarse + 1))
