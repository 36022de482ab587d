"""Repair of conversations against exhaustive search and plain code."""

import hashlib
import itertools
import os
import random
import re
import zlib

import pytest

from fluvispark.llm import conversation_repair as R
from fluvispark.llm import queries

SF = "/root/testdata/sf0.001"
LEGAL = re.compile("(s?(ua)+)?")


def search(codes):
    """Least (cost, audit) by trying every edit of every row and every insert around it, on strings of initials."""
    rows = [codes[k : k + 2] for k in range(0, len(codes), 2)]
    inserts = ["", "u", "a", "ua", "au"]
    best = None
    options = []
    for initial, fault in rows:
        own = [("D", "", 3)]
        if fault not in "bd":
            extra = int(fault == "t")
            own += [("K", initial, extra), ("R", "u", 2 + extra), ("R", "a", 2 + extra)]
        options.append(own)
    for edits in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            audit, roles, cost = "", "", 0
            for k in range(len(rows) + 1):
                audit, roles, cost = audit + "I" * len(extra[k]), roles + extra[k], cost + 2 * len(extra[k])
                if k < len(rows):
                    audit, roles, cost = audit + edits[k][0], roles + edits[k][1], cost + edits[k][2]
            if (best is None or (cost, audit) < best) and LEGAL.fullmatch(roles):
                best = cost, audit
    return best


def test_cheapest_and_least_edits_of_short_conversations():
    rng = random.Random(3)
    for n in range(4):
        for _ in range(12 if n else 1):
            codes = "".join(rng.choice("sua?") + rng.choice("fftbd") for _ in range(n))
            assert R.solve(codes) == search(codes), codes


def test_long_conversations_go_the_same_way():
    codes = "sf" + "ufaf" * 5000 + "at"
    cost, audit = R.solve(codes)
    assert cost == 3 and audit == "K" * 10001 + "D"


def test_played():
    rows = [("system", "x"), ("user", "1"), ("user", "2"), ("assistant", "")]
    assert list(R.played("KKIKD", iter(rows))) == [("system", "x"), ("user", "1"), ("assistant", ""), ("user", "2")]
    assert list(R.played("DRRDI", iter(rows))) == [("user", "1"), ("assistant", "2"), ("user", "")]


def plain(rows):
    """The contract's rows from (conv_id, turn, role, text), by plain code."""
    space, order = " ", {}
    for conv, turn, role, text in rows:
        own = order.setdefault(conv, [])
        role, text = space if role is None else role, space if text is None else text
        one = lambda v: space if v is None else str(v)
        kind = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in order.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        turns = {r[0] for r in own} - {None}
        seen, codes, counts = set(), "", dict.fromkeys("btd", 0)
        for _, role, text in own:
            end = text.strip(R.WHITE)
            fault = "b" if not end else "d" if (role, text) in seen else "f" if end[-1] in ".!?" else "t"
            counts.update({fault: counts.get(fault, 0) + 1})
            seen.add((role, text))
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "?") + fault
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = R.solve(codes)
        text = "\n".join(f"{r}:{t}" for r, t in R.played(audit, iter([r[1:] for r in own])))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = "gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def of(df):
    got = df.collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_same_as_plain_code(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert of(queries.op12_tight_arc_repair(spark, SF)) == plain(rows)


def odd_rows():
    rng = random.Random(8)
    texts = [None, "", " \t\n", "Yes.", "yes", "A longer text?\n", "é!", "x" * 300_000 + ".", "no "]
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, None, *range(6)]), rng.choice([None, "", "system", "user", "assistant", "tool"]), rng.choice(texts)) for _ in range(300)]
    return rows + [(77, 3, "user", "Same.")] * 400 + [(78, None, None, None)]


def test_odd_rows(spark):
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "f", 2, "a", 3) for r in rows], "conv_id long, turn long, role string, text string, n int, fault string, position int, audit string, kind int").repartition(4)
    damaged = R.damaged(table)
    got = of(R.audit(damaged, table))
    assert got == plain(rows)
    decisions = R.decide(damaged, table)
    texts: dict = {}
    for r in R.repaired(damaged, decisions).orderBy("conv_id", "position").collect():
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(texts.get(c, [])).encode()).hexdigest() for c in got} == {c: g[-1] for c, g in got.items()}


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert R.audit(R.damaged(none), none).count() == 0
    assert R.repaired(none, R.decide(none)).count() == 0
