"""Codes of vectors against plain distances, and their odd rows."""

import numpy as np
import pytest

from fluvispark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long, part int, entry int, n long, sums string, _v_ int"


def plain(queries, entries):
    d = ((queries[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    best = [min(range(len(entries)), key=lambda e, row=row: (row[e], e)) for row in d]
    return best, [d[k, e] for k, e in enumerate(best)]


@pytest.mark.parametrize("seed", range(6))
def test_va_file_finds_the_nearest_entry(seed):
    rng = np.random.default_rng(seed)
    reach = [3, 100, 5000, 1 << 20, 1 << 26, 1][seed]
    entries = rng.integers(-reach, reach + 1, (int(rng.integers(1, 257)), 16))
    entries[rng.integers(0, len(entries), 5)] = entries[0]  # equal entries: the lower number wins
    queries = np.concatenate([rng.integers(-reach, reach + 1, (200, 16)), entries[:20]])
    index, least = V.VaFile(entries, bits=int(rng.integers(1, 6))).nearest(queries)
    assert (index.tolist(), least.tolist()) == plain(queries, entries)


def test_bounds_hold_and_few_candidates_are_left():
    rng = np.random.default_rng(1)
    entries, queries = (rng.integers(-200, 200, (n, 16)) for n in (256, 100))
    lower, upper = V.VaFile(entries).bounds(queries)
    d = ((queries[None] - entries[:, None]) ** 2).sum(axis=2)
    assert (lower <= d).all() and (d <= upper).all()
    assert (lower <= upper.min(axis=0)).mean() < 0.1


def plain_fit(vectors, entries, rounds, parts=4):
    """Codebooks, codes and errors by plain k-means of integers; ``vectors``: in id order."""
    whole = [[int(np.floor(1024.0 * float(np.float32(x)))) for x in v] for v in vectors]
    wide = len(whole[0]) // parts
    cut = [[w[p * wide : (p + 1) * wide] for w in whole] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]
    near = lambda p: plain(np.array(cut[p]), np.array(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            got = near(p)[0]
            for e in set(got):
                own = [x for x, g in zip(cut[p], got, strict=True) if g == e]
                books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [near(p) for p in range(parts)]
    return books, list(zip(*(f[0] for f in found), strict=True)), [sum(f[1][k] for f in found) for k in range(len(whole))]


def rows():
    rng = np.random.default_rng(5)
    return [(k, rng.normal(0, 0.2, 16).astype(np.float32).tolist(), [None, 0, 1][k % 3]) for k in range(150)]


def test_same_as_plain_k_means(spark):
    own = rows()
    odd = [(-1, None, 0), (-2, [1.0] * 15 + [None], 0), (-3, [1.0] * 15 + [float("nan")], 0), (-4, [1.0] * 15 + [float("-inf")], 1)]
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, 4, "y", 5) for r in own + odd], SCHEMA).repartition(5)
    books = V.fit(table, entries=20)
    want, codes, errors = plain_fit([r[1] for r in own], 20, 4)
    assert books.books.tolist() == want
    got = {r.vec_id: r for r in V.with_label_errors(V.encode(table, books, carry=("label",))).collect()}
    assert sorted(got) == [r[0] for r in own]
    sums = {label: sum(e for r, e in zip(own, errors, strict=True) if r[2] == label) for label in (None, 0, 1)}
    for (k, _, label), code, error in zip(own, codes, errors, strict=True):
        assert (got[k].code, got[k].error, got[k].label_error) == ("".join(f"{c:02x}" for c in code), error, sums[label])


def test_odd_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    books = V.fit(none)
    assert books is None and V.with_label_errors(V.encode(none, books, carry=("label",))).count() == 0
    mixed = [(5, [0.5] * 8, 1), (5, [0.5] * 8, 1), (5, [0.25] * 8, 1), (None, [1.0] * 8, 1), (1, [], None), (2, [1.0] * 7, None), (9, [3.0e38] * 8, 2), (9, [-3.0e38] * 8, 2)]
    table = spark.createDataFrame(mixed, none.schema)
    books = V.fit(table)
    assert books.books.shape == (4, 6, 2)
    got = V.encode(table, books).collect()
    assert len(got) == len(mixed) and sum(r.code is None and r.error is None for r in got) == 2
    assert all(r.error == 0 for r in got if r.code is not None)  # as many entries as vectors


def test_decode():
    books = V.Codebooks(np.arange(2 * 3 * 2).reshape(2, 3, 2))
    assert books.decode(np.array([[2, 0]])).tolist() == [[4, 5, 6, 7]]
