"""Operators against brute force on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fluvispark.llm import decontamination, fingerprints, mixing, near_dedup, pii, quality, queries, token_planes

WORDS = [f"{a}{b}" for a in ("al", "be", "co", "du", "er") for b in ("na", "ri", "to", "sum")]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    out = [" ".join(r.choice(WORDS) for _ in range(r.randint(1, 120))) for _ in range(60)]
    for k in range(25):  # near copies, edited more and more
        words = out[k % 5].split()
        for _ in range(k // 4):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_near_duplicates_link_exactly(spark, texts):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:])))
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(frame(spark, texts), width=2).collect()}
    assert got == {i: (len(sets[i]), label[i]) for i in range(len(texts))}


def test_an_id_with_unlike_texts_links_them(spark, texts):
    a, b, c, d = texts[:4]
    assert min(len(t.split()) for t in (a, b, c, d)) > 3
    rows = [(3, a), (5, a), (5, b), (7, b), (7, ""), (9, c), (8, c), (8, d), (2, d), (11, c), (20, ""), (20, None), (None, a), (None, b)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    component = {3: 3, 5: 3, 7: 3, 9: 2, 8: 2, 2: 2, 11: 2, 20: 20}
    assert got == sorted((i or 0, component.get(i, 0), component.get(i, i) == i) for i, _ in rows)


def test_token_files_hold_what_the_tokenizer_gives(spark, texts, tmp_path):
    texts = [*texts, "Ünïcode, 日本 and  two spaces\n\nit's 12,5", ""]
    token_planes.write(frame(spark, texts), f"file://{tmp_path}/t", queries.tokenizer_path())
    reader, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r in token_planes.read(spark, f"file://{tmp_path}/t").orderBy("doc_id").collect():
        ids = np.array([*reader.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_planes_round_trip():
    for n in (0, 1, 100, 16_384, 40_000):
        ids = np.random.default_rng(n).integers(0, 50_257, n).astype("<u4")
        assert (token_planes.decode_chunk(token_planes.encode_chunk(ids)) == ids).all()


def test_likeness_estimates_jaccard():
    r = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        a = r.integers(0, 1 << 63, 3000).astype(np.uint64)
        b = np.concatenate((a[: int(3000 * share)], r.integers(0, 1 << 63, 3000 - int(3000 * share)).astype(np.uint64)))
        both = int(3000 * share)
        assert abs(fingerprints.likeness(fingerprints.fingerprint_of(a), fingerprints.fingerprint_of(b)) - both / (6000 - both)) < 0.12


def test_edited_texts(spark, texts):
    for r in fingerprints.compare_with_next(frame(spark, texts)).collect():
        own, other = texts[r.doc_id], texts[(r.doc_id + 1) % len(texts)]
        k = len(own) // 4
        assert r.edited_sha256 == hashlib.sha256((own[: len(own) - k] + other[:k]).encode()).hexdigest()


def test_every_planted_item_is_found(spark, texts):
    r = random.Random(9)
    items = [(k, " ".join(r.choice(WORDS) + str(r.randrange(90)) for _ in range(20 + 7 * k))) for k in range(12)]
    docs = [t + " " + items[k][1].upper() + ". " + t if k < 12 else t for k, t in enumerate(texts)]
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for i, d in enumerate(docs):
        w = re.findall("[a-z0-9]+", d.lower())
        hay = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for j, t in items:
            v = t.split()
            own = {tuple(v[k : k + 5]) for k in range(len(v) - 4)}
            if len(own & hay) >= 0.8 * len(own):
                want.add((i, j))
    assert got == want and len(want) == 12


def test_long_items_are_found_at_every_alignment(spark):
    r = random.Random(4)
    word = lambda: r.choice(WORDS) + str(r.randrange(400))
    items = [(n, " ".join(word() for _ in range(n))) for n in (64, 65, 130, 214, 300, 1000)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    fill = [word() for _ in range(decontamination.STRIDE)]
    docs = {(n, k): " ".join([*fill[:k], t, *fill]) for n, t in items for k in range(decontamination.STRIDE)}
    keys = list(docs)
    for size in (32 << 20, 1 << 15):  # also with the pieces of an item in several parts
        some = keys if size > 1 << 20 else keys[::21]
        got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(frame(spark, [docs[k] for k in some]), bench, max_index_bytes=size).collect()}
        assert got == {(i, n) for i, (n, _) in enumerate(some)}
        assert decontamination.clean(frame(spark, [docs[k] for k in some]), bench, max_index_bytes=size).count() == 0


def test_items_without_an_id_are_found(spark, texts):
    bench = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (4, texts[2])], "item_id long, text string")
    docs = frame(spark, [*texts[:3], "zu zu zu"])
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs, bench).collect()} == {(0, None), (1, None), (2, 4)}
    assert [x.doc_id for x in decontamination.clean(docs, bench).collect()] == [3]


def test_copies_edited_at_any_word_are_found(spark):
    r = random.Random(6)
    word = lambda: r.choice(WORDS) + str(r.randrange(400))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(25), text(29), text(39), text(60), text(30) + "? " + text(5), text(6) + "? " + text(30), "Question: " + text(30) + " Answer: " + text(12)]
    around, docs = text(20), {}
    for i, t in enumerate(items):
        words = t.split()
        for k, w in enumerate(words):
            changed = "?" if w.endswith("?") else ":" if w.endswith(":") else ""
            n, lost = len(words) - 4, min(k + 1, len(words) - 4) - max(k - 4, 0)
            if n - lost >= 0.8 * n:
                docs[i, k] = " ".join([around, *words[:k], "changed" + changed, *words[k + 1 :], around])
    keys = list(docs)
    assert len(keys) == 8 + 29 + 39 + 60 + 35 + 36 + 44
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(frame(spark, [docs[k] for k in keys]), bench).collect()}
    assert got == {(d, i) for d, (i, _) in enumerate(keys)}


def test_a_question_without_its_answer_is_left(spark):
    r = random.Random(7)
    question = " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(40)) + "? "
    bench = spark.createDataFrame([(0, question + "zu"), (1, question + "zu ro"), (2, question + "zu ro mi"), (3, question + "zu ro mi ka lo")], "item_id long, text string")
    tails = ["", "other words here", "ro it is not", "zu ro mi ka lo"]
    got = {(x.doc_id, x.item_id) for x in decontamination.contaminated(frame(spark, [question + t for t in tails]), bench).collect()}
    assert got == {(3, 0), (3, 1), (3, 2), (3, 3)}


RUNS = ["pay 7536784127813050 4845168114407329 now", "call +1 (843) 555-7672 170.106.47.218 now", "pay 12 4111 1111 1111 1111 now"]


def test_numbers_side_by_side_are_proposed(spark):
    got = {r.doc_id: {(pii.KINDS[c.kind], RUNS[r.doc_id][c.start : c.end]): c.label for c in r.candidates} for r in pii.candidates(pii.base_spans(frame(spark, RUNS))).collect()}
    digits = lambda t: re.sub("[^0-9]", "", t)
    for i, text in enumerate(RUNS):
        groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", text)]
        spans = [text[a:d] for k, (a, _) in enumerate(groups) for _, d in groups[k:]]
        assert {t for k, t in got[i] if k == "card"} == {t for t in spans if 13 <= len(digits(t)) <= 19 and not re.search(r"[()]|  ", t)}
        assert {digits(t) for k, t in got[i] if k == "phone"} == {digits(t) for t in spans if 7 <= len(digits(t)) <= 15}
    assert got[0]["card", "7536784127813050"] is None and got[0]["card", "4845168114407329"] is None
    assert got[1]["phone", "+1 (843) 555-7672"] is None and got[1]["phone", "+1 (843) 555-7672 170"] == 0 and got[1]["ip", "170.106.47.218"] == 1
    assert got[2]["card", "4111 1111 1111 1111"] is None


def test_numbers_side_by_side_are_added(spark):
    r = random.Random(8)

    def card():
        body = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(body + c for c in "0123456789" if sum(int(x) if k % 2 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(body + c)) % 10 == 0)

    four = lambda t: " ".join(t[k : k + 4] for k in range(0, 16, 4))
    plain = [f"pay {card()} now. pay {four(card())} now. call +1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)} now." for _ in range(1200)]
    got = {x.doc_id: {RUNS[x.doc_id][s.start : s.end] for s in x.added} for x in pii.find(frame(spark, RUNS + plain)).collect() if x.doc_id < 3}
    assert got == {0: {"7536784127813050", "4845168114407329"}, 1: {"+1 (843) 555-7672"}, 2: {"4111 1111 1111 1111"}}


def test_mixture_meets_its_quotas(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 10 else "small") for i in range(900)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, repetition_limit=3.0, block_docs=50).collect()
    tokens = {s: sum(1 + i % 7 for i in range(900) if ("big" if i % 10 else "small") == s) for s in ("big", "small")}
    shown = {s: sum(r.n_tokens for r in rows if r.source == s) for s in tokens}
    weight = {r.source: r.weight for r in rows}
    assert abs(weight["small"] / tokens["small"] / (weight["big"] / tokens["big"]) - 3) < 1e-4
    assert shown["big"] == tokens["big"] and 0 <= tokens["small"] * 3 - shown["small"] <= 8
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows)


def test_labellers_are_weighed_by_agreement():
    good, bad = sum(3**j for j in range(8)), 0
    noisy = good - 3**2  # one labeller dissents
    table, share, post = quality.expectation_maximisation({good: 600, bad: 150, noisy: 100})
    assert post[good] > 0.9 and post[noisy] > 0.9 and post[bad] < 0.1 and 0.7 < share < 0.9
