"""MinHash near-dedup with min-max hashing.

Each permutation of the shingle hashes contributes both its minimum and its maximum, so a
signature of ``2 * permutations`` values costs ``permutations`` hash evaluations (Ji et al.,
"Min-Max Hash for Jaccard Similarity", 2013). Values are cut into bands; documents that share
a band are candidates, and a candidate pair becomes a link only when the Jaccard similarity of
the *full* shingle sets reaches the threshold.

Every two documents of a band's bucket end up compared, or in one component already. The work is arranged
such that a group of alike documents, linked or not, makes few rows:

1. Texts of equal shingle sets collapse to one representative.
2. Star rounds, ``STARS`` of them: each bucket has one pivot, and every document is compared with the one pivot it
   shares most buckets with. That is at most one pair a document and round, and joins most of a group.
3. What is left are buckets with members of several components. Documents outside a component of ``BIG`` or more
   that share a bucket with it are compared with all of it; members of smaller components are compared among
   themselves, in buckets of up to ``RUN`` of them by signature first, pair by pair, and in larger ones by full
   sets. The comparisons with big components and in large buckets are products of blocks of about ``BLOCK``
   documents: a task reads two blocks of sets, counts all their intersections by one matrix product, and
   returns at most a spanning forest of the links it sees.

So rows grow with the input and, for a group of alike documents without links, with the square of its size over
``BLOCK``; no bucket, component or group is collected, capped or sampled. Pairs of small buckets whose signatures agree on far
fewer values than the threshold implies (``SIGMAS`` standard deviations, of values taken as independent; a
pair at the threshold is lost with a chance of about 3e-7) are not read. Components come from distributed
label propagation with pointer jumping; only one number of a round reaches the driver.

Defined results: null or wordless texts have an empty set, are linked with nothing and are
their own component; repeated rows of a ``doc_id`` are one node with one component, linked through
any of its texts (a wordless row goes with the others of its id); a null ``doc_id`` has a null component and is kept. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH, THRESHOLD = 5, 0.8
PERMUTATIONS, ROWS = 96, 5
STARS, SIGMAS = 2, 5.0
BIG, RUN, BLOCK, BLOCK_SHINGLES = 32, 32, 128, 100_000
#: Columns of a block's matrix at a time.
COLUMNS = 16_384


def _multipliers(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    seed = C.mix(np.arange(1, 2 * permutations + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    return (seed[:permutations] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[permutations:] >> np.uint64(32)).astype(np.uint32)


def signature(shingle_set: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """Minima then maxima of each permutation over a non-empty set of 64-bit hashes (uint32[2 * permutations])."""
    a, b = _multipliers(permutations)
    x = (shingle_set >> np.uint64(32)).astype(np.uint32)
    low = np.full(permutations, 0xFFFFFFFF, np.uint32)
    high = np.zeros(permutations, np.uint32)
    for i in range(0, len(x), 2048):
        h = np.multiply.outer(a, x[i : i + 2048])
        h += b[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.concatenate((low, high))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band of ``rows`` values; the band's number is part of the key."""
    bands = len(sig) // rows
    v = sig[: bands * rows].reshape(bands, rows).astype(np.uint64)
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        h = C.mix(h ^ v[:, k])
    return h


def sets_of(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; A-Z lower-cased, words split at ASCII white space."""
    for first, end, buf, offsets in C.slices(texts):
        s, e, row = C.word_spans(C.WHITE[buf], offsets)
        words = C.span_hashes(C.BYTES[buf], s, e)
        cut = np.searchsorted(row, np.arange(end - first + 1))
        for i in range(end - first):
            yield np.unique(C.shingles(words[cut[i] : cut[i + 1]], width))


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, sigs = [], [], [], []
            for x in sets_of(batch.column("text"), width):
                sizes.append(len(x))
                if not len(x):
                    digests.append(b"")
                    bands.append(None)
                    sigs.append(b"")
                    continue
                k = np.arange(1, len(x) + 1, dtype=np.uint64)
                # order is fixed by sorting, so equal sets, and only they, share both sums and the size
                digests.append(np.array([C.mix(x * k).sum(), C.mix(x + k).sum(), len(x)], np.uint64).tobytes())
                sig = signature(x)
                bands.append(band_keys(sig).view(np.int64))
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    return run


def _full_sets(width: int):
    """(id, hashes): the set of each text, as the bytes of its sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([x.tobytes() for x in sets_of(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sets], names=["id", "hashes"])

    return run


def _views(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The hashes of each row of a binary column, without a copy of them."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out = []
    for c in chunks:
        c = c.cast(pa.large_binary())
        if not len(c):
            continue
        at = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = c.buffers()[2]
        out += [np.frombuffer(data, np.uint64, (e - s) // 8, s) if e > s else np.zeros(0, np.uint64) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return out


def _verify(threshold: float):
    share = round(threshold * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_views(batch.column("ha")), _views(batch.column("hb")), strict=True):
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum()) if len(small) else 0
                keep.append(1_000_000 * both >= share * (len(x) + len(y) - both) > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, full: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    one, other = (full.select(F.col("id").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab")
    return pairs.join(one, "a").join(other, "b").select("a", "b", "ha", "hb").mapInArrow(C.tidy(_verify(threshold)), "a long, b long")


def _alike(n: str | Column, other: str | Column, threshold: float) -> Column:
    """Whether sets of these sizes can reach the threshold at all."""
    return F.least(n, other) >= F.lit(threshold - 1e-9) * F.greatest(n, other)


def _in_runs(threshold: float):
    """Plausible pairs of different components within each run of equal buckets; rows (bucket, m, n, c, sig) come sorted by bucket."""
    k = 2 * PERMUTATIONS
    least = int(k * threshold - SIGMAS * (k * threshold * (1 - threshold)) ** 0.5)

    def pairs(bucket: np.ndarray, m: np.ndarray, n: np.ndarray, c: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        for d in range(1, len(bucket)):
            i = np.flatnonzero(bucket[:-d] == bucket[d:])
            if not len(i):
                return
            i = i[(c[i] != c[i + d]) & (np.minimum(n[i], n[i + d]) >= (threshold - 1e-9) * np.maximum(n[i], n[i + d]))]
            for lo in range(0, len(i), 20_000):
                j = i[lo : lo + 20_000]
                j = j[(sig[j] == sig[j + d]).sum(axis=1) >= least]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(m[j], m[j + d])), pa.array(np.maximum(m[j], m[j + d]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            own = [batch.column(x).to_numpy(zero_copy_only=False) for x in ("bucket", "m", "n", "c")]
            own.append(np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, k))
            if held is not None:
                own = [np.concatenate(x) for x in zip(held, own, strict=True)]
            if not len(own[0]):
                continue
            cut = len(own[0]) - int((own[0] == own[0][-1]).sum())  # the last run may go on
            yield from pairs(*(x[:cut] for x in own))
            held = [x[cut:].copy() for x in own]
        if held is not None:
            yield from pairs(*held)

    return run


def intersections(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all sets of ``x`` with all of ``y``, by products of their incidence matrices."""
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    for sets in (x, y):
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        sides.append((every, np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
    shared = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    if not len(shared):
        return out.astype(np.int64)
    places = []
    for every, row in sides:
        at = np.minimum(np.searchsorted(shared, every), len(shared) - 1)
        hit = shared[at] == every
        places.append((at[hit], row[hit]))
    for lo in range(0, len(shared), COLUMNS):
        parts = []
        for (at, row), sets in zip(places, (x, y), strict=True):
            part = np.zeros((len(sets), min(COLUMNS, len(shared) - lo)), np.float32)
            inside = (at >= lo) & (at < lo + COLUMNS)
            part[row[inside], at[inside] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return np.rint(out).astype(np.int64)


def _forest(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The links that join something not joined by those before."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while up.setdefault(i, i) != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    keep = ([], [])
    for i, j in zip(a, b, strict=True):
        p, q = root(i), root(j)
        if p != q:
            up[p] = q
            keep[0].append(min(i, j))
            keep[1].append(max(i, j))
    return keep


def _blocks(threshold: float):
    """Links between the two sides of a task, or within its one side; at most a spanning forest of them."""
    share = round(threshold * 1_000_000)

    def run(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["id"].to_numpy()
        sets = _views(table["hashes"])
        xs = np.flatnonzero(side == 0)
        ys = np.flatnonzero(side == 1) if side.any() else xs
        x, y = [sets[i] for i in xs], [sets[i] for i in ys]
        nx, ny = np.array([len(s) for s in x], np.int64), np.array([len(s) for s in y], np.int64)
        both = intersections(x, y)
        i, j = np.nonzero((1_000_000 * both >= share * (nx[:, None] + ny[None, :] - both)) & (both > 0))
        a, b = _forest(ids[xs[i]].tolist(), ids[ys[j]].tolist())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _dealt(rows: DataFrame, blocks: Column) -> DataFrame:
    return rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks))


def _n_blocks(count: str, shingles: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1))


def _against_big(placed: DataFrame, labels: DataFrame, sizes: DataFrame) -> tuple[DataFrame, str]:
    """Tasks (kind, key, bi, bj, side, id), and a path to delete: documents outside a big component that share a bucket with it, against all of it.

    ``placed``: (bucket, m, n, c, cn); ``sizes``: (component, cn, shingles). Of two big components the smaller one's members ask.
    """
    held = placed.filter(F.col("cn") >= BIG).select("bucket", F.col("c").alias("component"), F.col("cn").alias("on")).distinct()
    outside = (F.col("c") != F.col("component")) & ((F.col("cn") < F.col("on")) | ((F.col("cn") == F.col("on")) & (F.col("c") < F.col("component"))))
    ask = placed.join(held, "bucket").filter(outside).groupBy("component", F.col("m").alias("id")).agg(F.max("n").alias("n"))
    ask, at = C.materialise(ask, "asking")
    plan = ask.groupBy("component").agg(F.count("*").alias("q"), F.sum("n").alias("qs")).join(sizes, "component").select("component", _n_blocks("q", "qs").alias("bx"), _n_blocks("cn", "shingles").alias("by"))
    x = _dealt(ask.join(plan, "component"), F.col("bx")).select("component", F.col("block").alias("bi"), F.explode(F.sequence(F.lit(0), F.col("by") - 1)).alias("bj"), F.lit(0).alias("side"), "id")
    y = _dealt(labels.join(plan, "component"), F.col("by")).select("component", F.explode(F.sequence(F.lit(0), F.col("bx") - 1)).alias("bi"), F.col("block").alias("bj"), F.lit(1).alias("side"), "id")
    return x.union(y).select(F.lit(0).alias("kind"), F.col("component").alias("key"), F.col("bi").cast("long").alias("bi"), F.col("bj").cast("long").alias("bj"), "side", "id"), at


def _within_buckets(loose: DataFrame) -> DataFrame:
    """Tasks as above: the members (bucket, m, n, count, shingles) of large buckets against one another."""
    own = loose.select("bucket", F.col("m").alias("id"), _n_blocks("count", "shingles").alias("b"))
    own = _dealt(own, F.col("b")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    return own.select(F.lit(1).alias("kind"), F.col("bucket").alias("key"), F.least("block", "j").cast("long").alias("bi"), F.greatest("block", "j").cast("long").alias("bj"), (F.col("block") > F.col("j")).cast("int").alias("side"), "id")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b); hooking onto the least neighbour, then pointer jumping.

    Only nodes with a link take part in the rounds; each round writes one table of labels.
    """
    both, edges_at = C.materialise(links.union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels, at = C.materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        hooked = labels.join(near, "id").select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        # a root takes the least label any of its tree has seen, then everyone follows two pointers
        roots = hooked.groupBy(F.col("old").alias("root")).agg(F.min("c").alias("up"))
        raised = hooked.join(roots, F.col("old") == F.col("root")).select("id", F.least("c", "up").alias("c"), "old")
        ahead = labels.select(F.col("id").alias("c"), F.col("component").alias("cc"))
        new = raised.join(ahead, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("component"), "old")
        new, new_at = C.materialise(new, "labels")
        moved = new.filter("component <> old").limit(1).count()
        labels = new.select("id", "component")
        C.delete(nodes.sparkSession, at)
        at = new_at
        if not moved:
            break
    out, out_at = C.materialise(nodes.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "components")
    C.delete(nodes.sparkSession, edges_at)
    C.delete(nodes.sparkSession, at)
    return out, out_at


def near_duplicates(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    temporary: list[str] = []

    def kept(df: DataFrame, label: str) -> DataFrame:
        df, at = C.materialise(df, label)
        temporary.append(at)
        return df

    def joined_up(nodes: DataFrame, links: DataFrame) -> DataFrame:
        out, at = components(nodes, links)
        temporary.append(at)
        return out

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches, _ = C.materialise(
        docs.mapInArrow(C.tidy(_sketch(width)), "doc_id long, n_shingles long, digest binary, bands array<long>, sig binary"), "sketches"
    )
    # one representative per set of shingles
    sets, _ = C.materialise(
        sketches.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")),
        "sets",
    )
    banded = sets.select(F.explode("bands").alias("bucket"), F.col("rep").alias("m"), "n")
    shared = banded.groupBy("bucket").agg(F.min("m").alias("lo"), F.max("m").alias("hi")).filter("lo < hi").select("bucket")
    members = kept(banded.join(shared, "bucket").select("bucket", "m", "n"), "buckets")
    nodes = kept(members.select(F.col("m").alias("id")).distinct(), "nodes")
    texts = docs.join(nodes, F.col("doc_id") == F.col("id"), "left_semi").select(F.col("doc_id").alias("id"), "text")
    full = kept(texts.mapInArrow(C.tidy(_full_sets(width)), "id long, hashes binary"), "full-sets")

    def unsettled(labels: DataFrame) -> DataFrame:
        """The members of buckets that hold several components, with their component as ``c``."""
        own = members.join(labels.select(F.col("id").alias("m"), F.col("component").alias("c")), "m")
        mixed = own.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bucket")
        return own.join(mixed, "bucket").select("bucket", "m", "n", "c")

    links, labels = spark.createDataFrame([], "a long, b long"), None
    for k in range(STARS):
        own = members.withColumn("c", F.col("m")) if labels is None else unsettled(labels)
        pivots = own.groupBy("bucket").agg(F.min_by(F.struct(F.col("m").alias("p"), F.col("n").alias("pn"), F.col("c").alias("pc")), F.xxhash64(F.lit(k), "m") if k else F.col("m")).alias("s")).select("bucket", "s.*")
        beside = own.join(pivots, "bucket").filter((F.col("c") != F.col("pc")) & _alike("n", "pn", threshold))
        best = beside.groupBy("m", "p").agg(F.count("*").alias("shared")).groupBy("m").agg(F.max_by("p", F.struct("shared", -F.col("p"))).alias("p"))
        links = links.union(kept(_linked(best.select(F.least("m", "p").alias("a"), F.greatest("m", "p").alias("b")).distinct(), full, threshold), "links"))
        labels = joined_up(nodes, links)

    sizes = labels.join(sets.groupBy(F.col("rep").alias("id")).agg(F.max("n").alias("n")), "id").groupBy("component").agg(F.count("*").alias("cn"), F.sum("n").alias("shingles"))
    sizes = kept(sizes, "sizes")
    placed = kept(unsettled(labels).join(sizes.select(F.col("component").alias("c"), "cn"), "c").select("bucket", "m", "n", "c", "cn"), "unsettled")
    tasks, at = _against_big(placed, labels, sizes)
    temporary.append(at)
    loose = placed.filter(F.col("cn") < BIG)
    counts = loose.groupBy("bucket").agg(F.count("*").alias("count"), F.sum("n").alias("shingles"), F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("bucket", "count", "shingles")
    loose = loose.join(counts, "bucket")
    few = loose.filter(F.col("count") <= RUN).join(sets.select(F.col("rep").alias("m"), "sig"), "m").select("bucket", "m", "n", "c", "sig")
    pairs = few.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(C.tidy(_in_runs(threshold)), "a long, b long").distinct()
    tasks = tasks.union(_within_buckets(loose.filter(F.col("count") > RUN)))
    found = tasks.join(full, "id").groupBy("kind", "key", "bi", "bj").applyInArrow(_blocks(threshold), "a long, b long")
    links = links.union(kept(_linked(pairs, full, threshold).union(found), "links"))

    # ids that come with different texts link the representatives of these
    none = F.lit(b"")
    several = sketches.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce("digest", none)).alias("lo"), F.max(F.coalesce("digest", none)).alias("hi")).filter("lo < hi").select("doc_id")
    held = kept(sketches.filter("n_shingles > 0").join(several, "doc_id", "left_semi").join(sets.select("digest", "rep"), "digest").select("doc_id", "rep").distinct(), "held")
    of_id = None
    if held.limit(1).count():
        nodes = nodes.union(held.select("doc_id")).union(held.select("rep")).distinct()
        links = links.union(held.filter("doc_id <> rep").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b")).distinct())
    labels, _ = components(nodes, links)
    if held.limit(1).count():
        of_id, _ = C.materialise(held.select("doc_id").distinct().join(labels.withColumnRenamed("id", "doc_id"), "doc_id").withColumnRenamed("component", "own"), "components")
    for at in temporary:
        C.delete(spark, at)
    by_set = sets.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    placed = sketches.select("doc_id", "n_shingles", "digest").join(by_set, "digest", "left")
    placed = placed.withColumn("own", F.lit(None).cast("long")) if of_id is None else placed.join(of_id, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("own", "component", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
