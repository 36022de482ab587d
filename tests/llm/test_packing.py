"""Packing: tokens equal the library's, plans hold every piece, sequences are gapless and few."""

import os
import random
import zlib
from array import array
from collections import Counter

import pytest

from fluvispark.llm import packing as P
from fluvispark.llm import queries

SF = "/root/testdata/sf0.001"
NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("public_tokenizers")
    return queries.tokenizer_path(NAME)


def ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


TEXTS = ["", " ", "Plain words, and MARKS!! don't; they'll ''s x_y (z)", "tabs\tand odd spaces\x1cand\x00", "İstanbul ǅ Σίσυφος ΑΣ. ß ﬁ ŉ é ́a 日本語 😀 ½ 12345 a1b2", "a<|endoftext|>b <|startoftext|>", "\n\n lead  and   trail \n", "x" * 3000, "'s 't're 've", "-- ... ?!"]


@pytest.mark.parametrize("text", TEXTS)
def test_tokens_equal_the_library(path, text):
    assert P.WordEncoder(path).encode(text) == array("I", ids(path, text)).tobytes()


def fewest(lengths, capacity):
    """The least number of sequences, by search."""
    items, best = sorted(lengths, reverse=True), [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                at = rooms.index(room)
                place(k + 1, rooms[:at] + [room - items[k]] + rooms[at + 1 :])
        place(k + 1, [*rooms, capacity - items[k]])

    place(0, [])
    return best[0]


def count(planned, histogram, capacity):
    got: Counter = Counter()
    for content, n in planned:
        assert n > 0 and sum(content) <= capacity
        for length in content:
            got[length] += n
    assert got == Counter(histogram)
    return sum(n for _, n in planned)


def test_plans_hold_every_piece_and_are_near_the_least():
    rng = random.Random(2)
    extra = 0
    for _ in range(40):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 9))]
        used = count(P.plan(Counter(lengths), 64, 2), Counter(lengths), 64)
        extra += used - fewest(lengths, 64)
    assert extra <= 2


@pytest.mark.parametrize("kind", ["short", "long", "even", "huge"])
def test_large_plans(kind):
    rng = random.Random(4)
    lengths = {"short": lambda: min(4096, int(rng.lognormvariate(5.8, 1)) + 1), "long": lambda: rng.randint(1000, 2200), "even": lambda: rng.choice([1500, 1000, 596, 4096]), "huge": lambda: rng.randint(1, 4096)}[kind]
    h = Counter(lengths() for _ in range(5000))
    if kind == "huge":
        h = Counter({x: n * 10**7 for x, n in h.items()})
    used, least = count(P.plan(h), h, 4096), -(-sum(x * n for x, n in h.items()) // 4096)
    plain = P._Open(4096)
    P._best_fit(dict(h), plain, 4096)
    assert used <= 1.004 * sum(n for g in plain.groups for n in g.values()) + 1
    assert used <= least * {"short": 1.005, "long": 1.04, "even": 1.025, "huge": 1.06}[kind] + 1


def held(rows, docs, path, capacity=4096):
    """Checks pieces against the library's ids, and that sequences have no gaps."""
    want: Counter = Counter()
    for doc, text in docs:
        own = array("I", [*ids(path, text), 1])
        for k, at in enumerate(range(0, len(own), capacity)):
            part = own[at : at + capacity]
            want[doc, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark, path):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op13_configuration_packing(spark, SF).collect()
    used = held(rows, docs, path)
    assert used <= -(-sum(r.length for r in rows) // 4096) + 1


def test_odd_documents_and_whole_sequences(spark, path):
    long = " ".join(f"word{i}" for i in range(9000))
    docs = [(None, "no id"), (1, None), (1, ""), (2, long), (2, long), (3, "x"), *[(9, "the same short text")] * 300, *[(k, TEXTS[k % len(TEXTS)]) for k in range(10, 60)]]
    table = spark.createDataFrame([(d, t, 1, 2, "z", 3, 4) for d, t in docs], "doc_id long, text string, piece int, task int, length string, nth int, rank int").repartition(6)
    packed = P.pack(table, path, with_ids=True)
    rows = packed.collect()
    held(rows, docs, path)
    whole = {r.sequence_id: r for r in P.sequences(packed).collect()}
    for r in rows:
        s = whole[r.sequence_id]
        assert zlib.crc32(bytes(s.ids)[4 * r.offset : 4 * (r.offset + r.length)]) == r.ids_crc32
        assert s.doc_ids[s.offsets.index(r.offset)] == r.doc_id
    assert P.pack(table.limit(0), path).count() == 0
