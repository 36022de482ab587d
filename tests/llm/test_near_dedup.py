"""Near-dedup around its own sizes: components of 31 to 33, buckets past a block, groups alike without links."""

import random

import numpy as np
import pytest

from fluvispark.llm import near_dedup


def words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def edited(r, base, k):
    out = list(base)
    for i in r.sample(range(len(out)), k):
        out[i] = f"e{r.randrange(10**9)}"
    return out


def brute(texts):
    sets = [set(zip(w, w[1:])) for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            p, q = root(i), root(j)
            if p != q:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    up[max(p, q)] = min(p, q)
    return {i: root(i) for i in range(len(texts))}


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, width=2).collect()}


@pytest.mark.parametrize("n", [31, 32, 33, 300])
def test_groups_with_documents_at_their_rim(spark, n):
    """A group of ``n`` linked documents, others alike but below the threshold, and some linked to one member alone."""
    r = random.Random(n)
    base = words(r, 100)
    group = [edited(r, base, 1) for _ in range(n)]
    rim = [edited(r, base, k) for k in (6, 7, 8, 9, 10, 11, 12, 13) for _ in range(5)]
    far = edited(r, base, 9)
    chain = [edited(r, far, 3) for _ in range(4)]
    texts = [" ".join(t) for t in [*group, *rim, far, *chain, *(words(r, 60) for _ in range(20))]]
    r.shuffle(texts)
    assert found(spark, texts) == brute(texts)


def test_alike_documents_without_links(spark):
    """Nothing is linked, everything shares buckets: compared in blocks, more than one of them."""
    r = random.Random(5)
    base = words(r, 80)
    texts = [" ".join(edited(r, base, 7)) for _ in range(260)]
    want = brute(texts)
    assert len(set(want.values())) > 200
    assert found(spark, texts) == want


def test_intersections_of_blocks(monkeypatch):
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 120, 299, 7)]
    for columns in (16_384, 13):
        monkeypatch.setattr(near_dedup, "COLUMNS", columns)
        got = near_dedup.intersections(sets[:4], sets)
        assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets] for x in sets[:4]]


def test_runs_cut_by_batches():
    """Runs that go on in the next batch are compared whole."""
    import pyarrow as pa

    r = np.random.default_rng(1)
    bucket = np.sort(r.integers(0, 40, 300))
    m, n = np.arange(300), r.integers(90, 110, 300)
    sig = [bytes(2 * near_dedup.PERMUTATIONS)] * 300
    batch = pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(m), pa.array(n), pa.array(m), pa.array(sig, pa.binary())], names=["bucket", "m", "n", "c", "sig"])
    want = {(i, j) for j in range(300) for i in range(j) if bucket[i] == bucket[j] and min(n[i], n[j]) >= 0.8 * max(n[i], n[j])}
    for size in (1, 7, 300):
        out = near_dedup._in_runs(0.8)(iter(batch.slice(k, size) for k in range(0, 300, size)))
        assert {(a, b) for x in out for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())} == want
