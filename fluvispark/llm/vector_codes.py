"""Product codes of vectors: each of a vector's equal parts is replaced by the number of its nearest codebook entry.

Method. The nearest entry of a part is found by a VA-file over the codebook: every coordinate of an entry is quantised to
``BITS`` bits, that is, to one of at most 2**BITS cells of like many entries. For a part to be coded, a table holds the
least and the greatest squared distance from each of its coordinates to each cell; sums of looked-up values bound the
distance to every entry from below and above. Entries whose lower bound exceeds the least upper bound can't be nearest;
the others, ties included, are compared by exact integer distances.

Distribution. Every round is one pass over the vectors where they lie: a task codes its vectors a few hundred at a time
and gives back the counts and component sums of each entry, one row an entry and part. Spark adds those up; what
reaches the driver are entries x parts rows, whatever the data's size. The codebooks travel inside the tasks' code: their
size is that of ``entries`` vectors, a parameter. Nothing is shuffled but those sums.

Arithmetic. Components become floor(1024 * x), integers; from there on all is exact. So that squared distances fit a long,
integers saturate at +-2**27 for up to 64 components (a bit less for every fourfold length), that is, at 131,072.0.

Defined results. A vector that is null, or holds a null or non-finite component, is dropped. The length of codes is set by
the vectors that make the codebooks: the first of the least ids whose length is a multiple of ``parts``; vectors of any
other length keep their row with null code and error. Ids that are null come last; rows of one id are ordered by their vector and
each counts. With fewer kept vectors than ``entries``, the codebooks have that many entries; with none, the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

BITS = 5
BATCH = 512
SCALE = 1024.0


def saturation(width: int) -> int:
    """The greatest absolute integer component for vectors of ``width`` components: twice it, squared, times ``width`` is below 2**63."""
    return 1 << max(1, (62 - max(1, width - 1).bit_length()) // 2 - 1)


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 * x) of finite vectors (rows), saturated."""
    most = float(saturation(vectors.shape[1]))
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)


class VaFile:
    """Codebook entries (rows of integers) with their coordinates quantised to cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        n, self.width = entries.shape
        cells = min(1 << bits, n)
        order = np.sort(entries, axis=0)
        # cells of like many entries; equal coordinates share a cell, so its interval holds all of them
        cuts = order[(np.arange(1, cells) * n) // cells]
        self.cell = np.stack([np.searchsorted(cuts[:, d], entries[:, d], "right") for d in range(self.width)], axis=1)
        big = np.iinfo(np.int64).max
        self.low, self.high = np.full((self.width, cells), big), np.full((self.width, cells), -big)
        for d in range(self.width):
            np.minimum.at(self.low[d], self.cell[:, d], entries[:, d])
            np.maximum.at(self.high[d], self.cell[:, d], entries[:, d])
        self.used = self.low <= self.high

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, entries x queries."""
        n, kind = len(self.entries), self._kind(queries)
        lower, upper = np.zeros((n, len(queries)), kind), np.zeros((n, len(queries)), kind)
        for d in range(self.width):
            q = queries[:, d]
            lo, hi = (np.where(self.used[d], x, 0)[:, None] for x in (self.low[d], self.high[d]))
            below, above = lo - q, q - hi
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            lower += (near * near).astype(kind)[self.cell[:, d]]
            upper += (far * far).astype(kind)[self.cell[:, d]]
        return lower, upper

    def _kind(self, queries: np.ndarray):
        """32-bit integers where no sum can overflow them."""
        reach = int(np.abs(queries).max(initial=0)) + int(np.abs(self.entries).max(initial=0))
        return np.int32 if self.width * reach * reach < 1 << 31 else np.int64

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lower) and squared distance of each query."""
        lower, upper = self.bounds(queries)
        row, entry = np.nonzero((lower <= upper.min(axis=0)).T)
        difference = queries[row] - self.entries[entry]
        distance = np.einsum("ij,ij->i", difference, difference)
        first = np.searchsorted(row, np.arange(len(queries)))
        least = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == least[row])
        hit = hit[np.searchsorted(row[hit], np.arange(len(queries)))]
        return entry[hit], least


@dataclass(frozen=True)
class Codebooks:
    """parts x entries x components a part."""

    books: np.ndarray

    @property
    def width(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def sha256(self) -> str:
        """Of all integers by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()

    def files(self) -> list[VaFile]:
        return [VaFile(b) for b in self.books]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that rows of entry numbers stand for."""
        return np.concatenate([b[codes[:, k]] for k, b in enumerate(self.books)], axis=1)


def finite(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is not null and has only finite components."""
    v = F.col(column)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.filter(v.isNotNull() & ~F.coalesce(F.exists(v, bad), F.lit(False)))


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that width, their integer vectors) of a list column without nulls."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    values = column.filter(pa.array(lengths == width)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return rows, quantised(values)


def _coded(files: list[VaFile], vectors: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, codes, errors by part), a few hundred rows at a time."""
    wide = files[0].width
    for k in range(0, len(vectors), BATCH):
        block = vectors[k : k + BATCH]
        got = [f.nearest(block[:, p * wide : (p + 1) * wide]) for p, f in enumerate(files)]
        yield slice(k, k + len(block)), np.stack([g[0] for g in got], axis=1), np.stack([g[1] for g in got], axis=1)


def start(vectors: DataFrame, parts: int = 4, entries: int = 256, id_column: str = "vec_id", column: str = "embedding") -> Codebooks | None:
    """Codebooks from the parts of the ``entries`` first vectors by id; None if there is no vector. ``vectors``: only finite ones."""
    cols = vectors.select(F.col(id_column).alias("id"), F.col(column).cast("array<double>").alias("v")).filter(F.size("v") > 0).filter(F.size("v") % parts == 0)
    first = [F.col("id").asc_nulls_last(), F.col("v")]
    lead = cols.orderBy(*first).limit(1).collect()
    if not lead:
        return None
    width = len(lead[0].v)
    rows = cols.filter(F.size("v") == width).orderBy(*first).limit(entries).collect()  # ``entries`` rows, a parameter
    whole = quantised(np.array([r.v for r in rows], float))
    return Codebooks(np.ascontiguousarray(whole.reshape(len(rows), parts, width // parts).transpose(1, 0, 2)))


def improve(vectors: DataFrame, books: Codebooks, column: str = "embedding") -> Codebooks:
    """One round: every part to its nearest entry, every used entry to the componentwise floor of its parts' mean."""
    parts, entries, wide = books.books.shape
    width, table = books.width, books.books

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Codebooks(table).files()
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, wide), np.int64)
        for batch in batches:
            for rows, codes, _ in _coded(files, vectors_of := _matrix(batch.column(0), width)[1]):
                block = vectors_of[rows].reshape(-1, parts, wide)
                for p in range(parts):
                    count[p] += np.bincount(codes[:, p], minlength=entries)
                    order = np.argsort(codes[:, p], kind="stable")
                    used, at = np.unique(codes[order, p], return_index=True)
                    total[p, used] += np.add.reduceat(block[order, p], at, axis=0)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    sums = vectors.select(column).mapInArrow(C.tidy(run), "part int, entry int, n long, sums array<long>").groupBy("part", "entry")
    exact = sums.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(wide)]).alias("sums"))
    new = table.copy()
    for r in exact.collect():  # parts x entries rows
        new[r.part, r.entry] = [int(s) // r.n for s in r.sums]
    return Codebooks(new)


def fit(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id", column: str = "embedding") -> Codebooks | None:
    kept = finite(vectors, column)
    books = start(kept, parts, entries, id_column, column)
    for _ in range(rounds if books else 0):
        books = improve(kept, books, column)
    return books


def encode(vectors: DataFrame, books: Codebooks | None, id_column: str = "vec_id", column: str = "embedding", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, code, error) of every finite vector; ``code`` has each part's entry number, two hex digits each (more if there are more than 256 entries)."""
    kept = finite(vectors, column).select(id_column, *carry, F.col(column).alias("_v_"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if books is None:
        return kept.sparkSession.createDataFrame([], schema)
    table, width = books.books, books.width
    digits = max(2, len(f"{table.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Codebooks(table).files()
        names = [f"{k:0{digits}x}" for k in range(table.shape[1])]
        for batch in batches:
            rows, whole = _matrix(batch.column(batch.num_columns - 1), width)
            code, error = np.full(batch.num_rows, None, object), np.zeros(batch.num_rows, np.int64)
            for at, codes, errors in _coded(files, whole):
                code[rows[at]] = ["".join(map(names.__getitem__, c)) for c in codes.tolist()]
                error[rows[at]] = errors.sum(axis=1)
            missing = np.ones(batch.num_rows, bool)
            missing[rows] = False
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(code, pa.string()), pa.array(error, pa.int64(), mask=missing)], [f.name for f in schema])

    return kept.mapInArrow(C.tidy(run), schema)


def with_label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the sum of ``error`` over the rows of the same label (nulls are one label), at most the greatest long.

    The sums are made by partial aggregation and written; Spark joins them back by what their size allows, and splits a hot label where it has to shuffle.
    """
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy(F.col(label).alias("_label_")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    sums, _ = C.materialise(sums, "label-errors")
    return coded.join(sums, F.col(label).eqNullSafe(F.col("_label_")), "left").drop("_label_")
