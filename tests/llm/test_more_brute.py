"""Quality, mixing, fingerprints, line dedup and long items against plain Python."""

import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fluvispark.llm import decontamination, fingerprints, line_dedup, mixing, quality
from fluvispark.llm import _common as C

SF = "/root/testdata/sf0.01"


def plain_em(patterns, rounds=200):
    keys = sorted(patterns)
    votes = {p: [p // 3**j % 3 for j in range(8)] for p in keys}
    post = {}
    for p in keys:
        good, bad = votes[p].count(1), votes[p].count(0)
        post[p] = 0.2 if bad > good else min(0.95, max(0.05, (good + 1) / (good + bad + 1.5)))
    for _ in range(rounds):
        total = sum(patterns.values())
        share = sum(patterns[p] * post[p] for p in keys) / total
        table = {}
        for j in range(8):
            for v in range(3):
                for c in (0, 1):
                    w = {p: patterns[p] * (post[p] if c else 1 - post[p]) for p in keys}
                    table[j, c, v] = (sum(w[p] for p in keys if votes[p][j] == v) + 1) / (sum(w.values()) + 3)
        new = {}
        for p in keys:
            z = math.log(share + 1e-9) - math.log(1 - share + 1e-9) + sum(math.log(table[j, 1, votes[p][j]] / table[j, 0, votes[p][j]]) for j in range(8))
            new[p] = 1 / (1 + math.exp(-max(-30, min(30, z))))
        moved = max(abs(new[p] - post[p]) for p in keys)
        post = new
        if moved < 1e-6:
            break
    return post


def test_expectation_maximisation_is_plain_em():
    r = random.Random(3)
    patterns = Counter(sum(r.choices((0, 1, 2), weights=(6, 1, 1) if r.random() < 0.3 else (1, 7, 2))[0] * 3**j for j in range(8)) for _ in range(400))
    _, _, got = quality.expectation_maximisation(dict(patterns))
    want = plain_em(patterns)
    assert max(abs(got[p] - want[p]) for p in want) < 1e-6


def test_votes_of_plain_texts():
    texts = ["", "\n".join(["Plain words of a text that is of some length and goes on for a while."] * 5), "THE ALL OF AND " * 20, "x # $ % & " * 10, "the same line\n" * 8, "go " * 60]
    names = {n: k for k, n in enumerate(quality.LABELLERS)}
    votes = np.concatenate([v for v, *_ in quality.features(pa.array(texts))])
    assert set(votes[0]) == {quality.BAD}
    assert votes[1][names["symbols"]] == votes[1][names["length"]] == votes[1][names["line_ends"]] == quality.GOOD
    assert votes[2][names["capitals"]] == votes[3][names["symbols"]] == votes[4][names["line_repeats"]] == votes[5][names["variety"]] == quality.BAD


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bad_documents_are_dropped(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = Counter((labels[r.doc_id], r.kept) for r in quality.classify(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.doc_id in labels)
    print(got)
    assert got[0, False] >= 0.95 * (got[0, False] + got[0, True]) and got[1, True] >= 0.95 * (got[1, True] + got[1, False])


def test_mixture_is_made_of_block_permutations(spark):
    docs = [(i % 700, "w " * (1 + i % 5), "big" if i % 8 else "small") for i in range(720)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string"), repetition_limit=2.5, block_docs=20).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for source, own in by.items():
        total = sum(1 + i % 5 for i in range(720) if ("big" if i % 8 else "small") == source)
        own.sort(key=lambda r: r.place)
        quota = None
        before, orders = 0, defaultdict(list)
        for r in own:
            if r.place > 0 and quota is None and before:
                quota = before / r.place
            assert quota is None or abs(r.place * quota - before) < 1e-6 * quota + 1e-6 or r.epoch > 2
            before += r.n_tokens
            if not orders[r.epoch] or orders[r.epoch][-1] != r.block:
                orders[r.epoch].append(r.block)
        assert all(len(set(o)) == len(o) for o in orders.values())  # a block is visited once an epoch
        assert set(orders[1]) == {r.block for r in own}
        full = [e for e in orders if sum(r.n_tokens for r in own if r.epoch == e) == total]
        assert 1 in full and (source == "big" or 2 in full)
        if source == "small":
            assert orders[1] != orders[2] and sorted(orders[1]) == sorted(orders[2])
            half = [r for r in own if r.epoch == 3]
            assert 0 < len(half) < len([r for r in own if r.epoch == 1])


def test_shown_documents_keep_their_columns_and_rows_without_id_apart(spark):
    docs = spark.createDataFrame([(None, "a b", "x", 1), (None, "c d", "x", 2), (1, "e f", "y", 3), (1, "g h " * 50, "y", 4), (1, "g h " * 50, "y", 4)], "doc_id long, text string, source string, row int")
    got = mixing.shown(docs, repetition_limit=2.0)
    assert got.columns == docs.columns
    rows = Counter((r.doc_id, r.text, r.row) for r in got.collect())
    assert rows[None, "a b", 1] >= 1 and rows[None, "c d", 2] >= 1 and rows[1, "e f", 3] >= 1


def plain_fingerprint(hashes):
    bins = {}
    for h in hashes:
        b = h >> 56
        bins[b] = min(h, bins.get(b, h))
    out = []
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD & mask
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 & mask
        return h ^ h >> 33

    for b in range(256):
        source, t = b, 0
        while source not in bins:
            t += 1
            source = mix((b * 0x9E3779B97F4A7C15 + t * 0xD1342543DE82EF95) & mask) % 256
        out.append(mix(bins[source]) & 15)
    return "".join(f"{x:x}" for x in out)


def test_fingerprints_are_plain_one_permutation_minhash():
    r = random.Random(4)
    for n in (1, 2, 30, 400, 5000):
        hashes = [r.getrandbits(64) for _ in range(n)]
        assert fingerprints.fingerprint_of(np.array(hashes, np.uint64)) == plain_fingerprint(hashes)
    a, b = (plain_fingerprint([r.getrandbits(64) for _ in range(300)]) for _ in "ab")
    same = sum(x == y for x, y in zip(a, b)) / 256
    assert abs(fingerprints.likeness(a, b) - max(0.0, (same - 1 / 16) / (15 / 16))) < 1e-9


def plain_dedup(docs):
    seen, out = set(), {}
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        body = [(i, x.strip(" \t\n\x0b\x0c\r")) for i, x in enumerate(lines)]
        body = [(i, x) for i, x in body if x]
        gone = set()
        for k in range(len(body) - 2):
            key = tuple(x for _, x in body[k : k + 3])
            if key in seen:
                gone |= set(range(body[k][0], body[k + 2][0] + 1))
            seen.add(key)
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def test_line_dedup_is_plain(spark):
    r = random.Random(6)
    line = lambda: r.choice(["", " ", *(f"line {k}" for k in range(6))])
    docs = [(i, "\n".join(line() for _ in range(r.randint(1, 25)))) for i in range(80)] + [(90, "\n".join(f"l {k % 50}" for k in range(4000)))]
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_dedup(docs)


def test_retrieval_is_that_of_all_scores():
    """Block-max WAND retrieves just what exhaustive scoring does, for items of 3 to 5,000 words."""
    r = np.random.default_rng(3)
    word = lambda n: " ".join(f"w{k}" for k in np.minimum(r.zipf(1.4, n), 3000))
    items = [(k, word(n)) for k, n in enumerate([3, 4, 5, 6, 9, 17, 33, 40, 64, 65, 90, 200, 700, 5000] * 6)]
    sets = [np.unique(w) for w in decontamination.words_of(pa.array([t for _, t in items]))]
    terms, df = np.unique(np.concatenate(sets), return_counts=True)
    mean = float(np.mean([len(t.split()) for _, t in items]))
    index = decontamination.build_index(items, len(items), (terms, df), mean, 0.6)
    texts = [word(300) for _ in range(20)] + [word(30) + " " + items[k][1] + " " + word(50) for k in range(14)]
    docs = list(decontamination.words_of(pa.array(texts)))
    got = {(d, p, i): s for d, p, i, s in decontamination.retrieve(index, docs, 0.6)}
    idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in zip(terms.tolist(), df.tolist())}
    want = {}
    for i, w in enumerate(decontamination.words_of(pa.array([t for _, t in items]))):
        for a in decontamination.piece_starts(len(w)):
            tf = Counter(w[a : a + 64].tolist())
            weight = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(tf.values()) / mean)) for t, n in tf.items()}
            own = sum(weight.values())
            for d, x in enumerate(docs):
                for p in range(-(-len(x) // 64)):
                    s = sum(weight.get(t, 0) for t in set(x[64 * p : 64 * p + 128].tolist())) / own
                    if s >= 0.6:
                        want[d, p, i] = max(s, want.get((d, p, i), 0))
    near = {k for k, s in want.items() if s < 0.6001}
    assert set(got) - near == set(want) - near and all(abs(got[k] - want[k]) < 1e-4 for k in got if k in want)
    assert {(20 + k, k) for k in range(14)} <= {(d, i) for d, _, i in got}


def test_polynomial_hashes_tell_slices_apart():
    data = np.frombuffer(b"abcabcabd", np.uint8)
    h = C.span_hashes(C.BYTES[data], np.array([0, 3, 6, 0]), np.array([3, 6, 9, 2]))
    assert h[0] == h[1] and len(set(h.tolist())) == 3


def test_passages_without_a_hopeful_block_are_not_searched(monkeypatch):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(6))) for i in range(64)]
    terms = np.unique(np.concatenate([w for w in decontamination.words_of(pa.array([x for _, x in items]))]))
    index = decontamination.build_index(items, len(items), (terms, np.ones(len(terms), np.int64)), 6.0, 0.6)
    calls, search = [], decontamination.search
    monkeypatch.setattr(decontamination, "search", lambda *a: calls.append(1) or search(*a))
    # four words, each of an item in another block
    docs = list(decontamination.words_of(pa.array([" ".join(f"w{i}x0" for i in (0, 17, 34, 51)), items[40][1], "w3x0 " * 70 + items[3][1]])))
    assert {(d, i) for d, _, i, _ in decontamination.retrieve(index, docs, 0.6)} == {(1, 40), (2, 3)}
    assert len(calls) == 3  # the copy of item 3 lies in two passages
