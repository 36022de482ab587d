"""Shared helpers of the training-data operators: tables, durable cuts of lineage, vectorised hashing.

The hashing helpers work on the raw UTF-8 buffers of Arrow batches, a slice of about
``CHUNK_BYTES`` at a time, so that a Python worker's memory does not depend on how many
rows Spark puts in a batch.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 18
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset: the warehouse (an error if that is a local folder), or on a single machine (master ``local``) a folder of our own, deleted at exit."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if house.startswith("file:") or house.startswith("/"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; the warehouse is on each machine's own disk")
        return f"{house}/_fluvispark"
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="fluvispark-")
        atexit.register(shutil.rmtree, _OWN_DIR["dir"], ignore_errors=True)
    return _OWN_DIR["dir"]


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialise(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage durably.

    Returns the reread table and its path, for ``delete`` once it is no longer needed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores behind as keep it apart from the columns ``taken`` (in any case) and from the others."""
    known, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in known:
            n += "_"
        known.add(n.lower())
        out.append(n)
    return out


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def pieces(df: DataFrame, bytes_each: int = 32 << 20) -> int:
    """A number of partitions for ``df`` by the stored size of what it reads: at least the session's, so many more that a partition has about ``bytes_each``."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    least = parallelism(df.sparkSession)
    return least if size > 1 << 58 else max(least, -(-size // bytes_each))  # a table from the driver has no size


#: Caches that an operator keeps in a worker from task to task.
SPARE: list[dict] = []


def tidy(run):
    """``run`` over batches; before, caches of other operators are emptied, after, the worker gives back memory it no longer needs. Workers live on and serve other tasks."""

    def wrapped(batches):
        for cache in SPARE:
            cache.clear()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def pieces_of(batch: pa.RecordBatch, rows: int = 256):
    """A batch a few rows at a time, so that what is made of them is never all in memory."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def crc_of_id(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, vectorised."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown as needed."""

    base = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK_BYTES)
            inverse = pow(self.base, -1, 1 << 64)
            for name, b in (("up", self.base), ("down", inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up, self.down


POWERS = Powers()


def symbol_table(size: int, fold_ascii: bool) -> np.ndarray:
    """A random-looking 64-bit value per symbol; with ``fold_ascii`` A-Z share those of a-z."""
    t = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if fold_ascii:
        t[65:91] = t[97:123]
    return t


BYTES = symbol_table(256, fold_ascii=True)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices ``values[start:end]``: a polynomial hash from prefix sums, then mixed."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def slices(column: pa.Array, chunk: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, byte buffer, row offsets in it) over a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1
        end = min(n, max(first + 1, end))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(separator: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of non-separators; runs never cross rows."""
    inside = ~separator
    starts = inside.copy()
    starts[1:] &= separator[:-1]
    ends = inside.copy()
    ends[:-1] &= separator[1:]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(separator))]
    starts[bounds] |= inside[bounds]
    ends[bounds - 1] |= inside[bounds - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = [not chr(b).isalnum() for b in range(128)]


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width``-word shingles of one document; with fewer words, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    width = min(width, n)
    h = words[: n - width + 1] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, width):
        h = mix(h ^ words[k : n - width + 1 + k]) * np.uint64(2 * k + 0x9E3779B97F4A7C15)
    return mix(h ^ np.uint64(width))
