"""Personal data: base spans against plain Python on whole tables, added spans against planted ones."""

import os
import random
import re

import pytest

from fluvispark.llm import pii

SF = "/root/testdata/sf0.001"


def luhn(digits):
    return sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(reversed(digits))) % 10 == 0


def plain(text):
    digits = lambda t: re.sub("[^0-9]", "", t)
    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(x) <= 255 for x in t.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda t: 13 <= len(digits(t)) <= 19 and luhn(digits(t))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, (p, ok) in enumerate(rules) for m in re.finditer(p, text or "") if ok(m.group())]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_base_spans_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in pii.find(docs).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == plain(texts[r.doc_id])
        taken = [*r.base, *r.added]
        assert all(a is b or a.end <= b.start or b.end <= a.start for a in r.added for b in taken)


def card(r):
    body = "4" + "".join(r.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if luhn(body + c))


def phone(r):
    return f"{r.randint(200, 989)}", f"{r.randint(200, 999)}", f"{r.randint(0, 9999):04d}"


WORDS = "the house stands near an old river and many people walk there every day with their dogs or alone".split()


def filler(r, n=8):
    return " ".join(r.choice(WORDS) for _ in range(n))


def decoy(r):
    return r.choice([
        lambda: f"order {r.randint(10**6, 10**8)}", lambda: f"on 20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", lambda: f"for {r.randint(1, 9)},{r.randint(100, 999)}.{r.randint(10, 99)} euros",
        lambda: f"from {r.randint(1800, 1950)}-{r.randint(1951, 2020)}", lambda: f"number {r.randint(10**12, 10**13)}", lambda: "look (at) the house. it stands", lambda: f"at {r.randint(10, 23)}:{r.randint(10, 59)}", lambda: "ab" * 12,
    ])()


def base(r):
    a, b, c = phone(r)
    return [f"joe.{r.randrange(10**4)}@mail{r.randrange(90)}.example.com", ".".join(str(r.randint(20, 255)) for _ in range(4)), card(r), f"+1 ({a}) {b}-{c}"]


def variants(r):
    """(kind, text before, span, text after) that no base pattern finds whole."""
    a, b, c = phone(r)
    quad = ".".join(str(r.randint(20, 255)) for _ in range(4))
    number = card(r)
    name = f"ann{r.randrange(10**4)}"
    token = "".join(r.choice("0123456789abcdef") for _ in range(32))
    return [
        (0, "", r.choice([f"{name} [at] mail{r.randrange(90)}.example.org", f"{name}(at)example{r.randrange(90)}.net", f"{name} [at] example{r.randrange(90)} [dot] net"]), ""),
        (1, f"{r.randint(300, 9999)}.", quad, ""),
        (2, "", r.choice("./_").join(number[k : k + 4] for k in range(0, 16, 4)), ""),
        (3, "", r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1 ({a}) {b}-{c}"]), ""),
        (4, r.choice(["password=", 'token = "', "api_key: "]), token, ""),
    ]


def test_planted_variants_are_added_and_decoys_left(spark):
    r = random.Random(11)
    texts, want = [], {}
    for _ in range(1500):
        texts.append(f"{filler(r)} {r.choice(base(r))} {filler(r)} {decoy(r)} {filler(r)}" + (f" token={r.getrandbits(128):032x} " if r.random() < 0.3 else ""))
    for _ in range(500):
        kind, before, span, after = r.choice(variants(r))
        head = filler(r) + " " + before
        want[len(texts)] = (kind, len(head), len(head) + len(span))
        texts.append(f"{head}{span}{after} {filler(r)} {decoy(r)}")
    got = {x.doc_id: {(s.kind, s.start, s.end) for s in x.added} for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    tokens = {i: {(4, m.start(1), m.end(1)) for m in re.finditer("token=([0-9a-f]+)", t)} for i, t in enumerate(texts) if i not in want}
    for kind, name in enumerate(pii.KINDS):
        planted = {(i, w) for i, w in want.items() if w[0] == kind}
        found = {(i, s) for i, spans in got.items() for s in spans if s[0] == kind and s not in tokens.get(i, ())}
        recall, precision = len(found & planted) / len(planted), len(found & planted) / max(1, len(found))
        print(name, len(planted), "recall", round(recall, 3), "precision", round(precision, 3))
        assert recall >= 0.9 and precision >= 0.9, name


def test_a_kind_with_few_examples_is_found_too(spark):
    r = random.Random(5)
    texts = [f"{filler(r)} {r.choice(base(r))} {filler(r)} {decoy(r)}" for _ in range(300)]
    tokens = {}
    for k in range(6):  # of another make than the templates: upper case, a colon, no quotes
        i, token = 50 * k, "".join(r.choice("0123456789ABCDEF") for _ in range(40))
        head = f"{texts[i]} {r.choice(['api_key: ', 'SECRET = ', 'password='])}"
        tokens[i] = (4, len(head), len(head) + 40)
        texts[i] = f"{head}{token} {filler(r)}"
    got = {x.doc_id: {(s.kind, s.start, s.end) for s in x.added} for x in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(t in got[i] for i, t in tokens.items())
    assert sum(s[0] == 4 for own in got.values() for s in own) == len(tokens)
