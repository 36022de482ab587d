"""Repair of conversations: the cheapest edits that make the roles follow a system turn, if any, then user and assistant in turn.

Faults. A row is *blank* if its text holds no character but space and the ASCII controls 9 to 13; else *duplicate* if the same
role and text came earlier in the conversation; else *truncated* if its last such character is none of ``.!?``. Rows of a
conversation are taken by turn (nulls first); rows of one turn by role, then by the MD5 of their text.

Edits. Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (a user or assistant row of empty text) 2; blank and
duplicate rows must be deleted; a truncated row that stays adds 1. Roles count by their first letter, and must read
``(s?(ua)+)?`` in the end.

Method. States of that pattern times rows done form an acyclic graph whose arcs are edits. Least costs from the start
(forward) and to the end (backward) mark the tight arcs, those on some cheapest way; a set of frontier nodes then
moves along the tight arcs of the least letter, so that of all cheapest edits the ASCII-least audit comes out.

Distribution. Faults are columns; earlier equal rows are found by the least turn of each (conversation, role, MD5), aggregated
before it is shuffled, and a join on keys that no two different rows share. The edits of a conversation are one small state
machine: its rows reach it as two letters each, without texts, sorted by Spark and streamed. Texts take one shuffle, as a sorted stream behind their conversation's
audit, and are handled one at a time. So a conversation of any length takes memory of some 70 bytes a row, which its audit (one cell of the result) takes part in anyway.

Defined results: null roles and texts read as one space; a null conversation id is one conversation; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

WHITE = " \t\n\x0b\x0c\r"
#: states: nothing yet, after the system turn, after a user turn, after an assistant turn
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
FAR = 1 << 60
#: letters of a row's fault as it reaches the state machine: fine, truncated, blank, duplicate, and a mark of an id without rows
FINE, TRUNCATED, BLANK, DUPLICATE, GONE = "ftbd-"


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, if it may."""
    if initial == "s":
        return SYSTEM if state == START else None
    if initial == ("a" if state == USER else "u"):
        return NEXT[state]
    return None


def arcs(state: int, row: str | None) -> Iterator[tuple[str, int, int, int]]:
    """(letter, rows consumed, next state, cost) of the edits at a state before ``row`` (letters of its initial and its fault); None: no row is left. In ASCII order."""
    if row is not None:
        yield "D", 1, state, DELETE
    yield "I", 0, NEXT[state], INSERT
    if row is not None and row[1] not in (BLANK, DUPLICATE):
        extra = int(row[1] == TRUNCATED)
        to = kept_state(state, row[0])
        if to is not None:
            yield "K", 1, to, KEEP + extra
        yield "R", 1, NEXT[state], REROLE + extra


def forward(rows: list[str]) -> array:
    """Least cost from the start to each node, four to a row."""
    n = len(rows)
    cost = array("q", [FAR]) * (4 * (n + 1))
    cost[START] = 0
    for k in range(n + 1):
        at = 4 * k
        for state in (START, SYSTEM, USER, ASSISTANT, USER):  # inserts go round within a row
            if cost[at + state] + INSERT < cost[at + NEXT[state]]:
                cost[at + NEXT[state]] = cost[at + state] + INSERT
        if k < n:
            for state in range(4):
                for letter, _, to, c in arcs(state, rows[k]):
                    if letter != "I" and cost[at + state] + c < cost[at + 4 + to]:
                        cost[at + 4 + to] = cost[at + state] + c
    return cost


def backward(rows: list[str]) -> array:
    """Least cost from each node to an end: all rows done, in the start state or after an assistant turn."""
    n = len(rows)
    cost = array("q", [FAR]) * (4 * (n + 1))
    cost[4 * n + START] = cost[4 * n + ASSISTANT] = 0
    for k in range(n, -1, -1):
        at = 4 * k
        if k < n:
            for state in range(4):
                cost[at + state] = min(cost[at + 4 + to] + c for letter, _, to, c in arcs(state, rows[k]) if letter != "I")
        for state in (ASSISTANT, USER, ASSISTANT, SYSTEM, START):
            cost[at + state] = min(cost[at + state], cost[at + NEXT[state]] + INSERT)
    return cost


def audit_of(rows: list[str]) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits of ``rows``, the ASCII-least of them."""
    ahead, behind = forward(rows), backward(rows)
    total, n = behind[START], len(rows)
    letters: list[str] = []
    frontier = {(0, START)}
    while not any(k == n and behind[4 * k + s] == 0 for k, s in frontier):
        tight: dict[str, set[tuple[int, int]]] = {}
        for k, state in frontier:
            for letter, took, to, c in arcs(state, rows[k] if k < n else None):
                if ahead[4 * k + state] + c + behind[4 * (k + took) + to] == total:
                    tight.setdefault(letter, set()).add((k + took, to))
        least = min(tight)
        letters.append(least)
        frontier = tight[least]
    return total, "".join(letters)


def _rows_of(codes: str) -> list[str]:
    same: dict[str, str] = {}  # a list of few strings, many times
    return [same.setdefault(row, row) for row in map("".join, zip(codes[::2], codes[1::2], strict=True))]


@functools.lru_cache(maxsize=20_000)
def _short(codes: str) -> tuple[int, str]:
    return audit_of(_rows_of(codes))


def solve(codes: str) -> tuple[int, str]:
    """``audit_of`` rows given as two letters each (initial, fault); short conversations are much alike and remembered."""
    return _short(codes) if len(codes) <= 64 else audit_of(_rows_of(codes))


def played(letters: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation: ``letters`` applied to ``rows`` (role, text)."""
    state = START
    for letter in letters:
        if letter == "I":
            state = NEXT[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if letter == "R":
            state = NEXT[state]
            yield ROLE[state], text
        elif letter == "K":
            state = SYSTEM if role[:1] == "s" else NEXT[state]
            yield role, text


# --- on tables ------------------------------------------------------------------------------


def prepared(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text), nulls of role and text read as one space."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``prepared`` rows damaged by crc32(``conv_id:turn``) % 20 (nulls: one space): 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 sets the role user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).cast("int")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = prepared(conversations).filter(kind != 0)
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("again"))
    return rows.select("conv_id", "turn", "role", "text", F.explode("again")).drop("col")


def _digest(c: str = "text") -> Column:
    return F.unhex(F.md5(F.col(c).cast("binary")))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, fault): the different rows of each turn, how often they stand there, and the fault of the first of them (the others are blank or duplicate)."""
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    own = F.when(end == "", BLANK).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    rows = rows.select("conv_id", "turn", "role", _digest().alias("digest"), own.alias("own"))
    rows = rows.groupBy("conv_id", "turn", "role", "digest", "own").agg(F.count("*").alias("n"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("t"), F.lit(True).alias("is_first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & F.col("turn").eqNullSafe(F.col("t"))
    fault = F.when((F.col("own") == BLANK) | F.col("is_first"), F.col("own")).otherwise(DUPLICATE)
    return rows.join(first, same, "left").select("conv_id", "turn", "role", "digest", "n", fault.alias("fault"))


class _Tally:
    """The rows of one conversation, as they come by in order."""

    def __init__(self) -> None:
        self.codes: list[str] = []
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = self.turn = None
        self.before: str | None = None

    def add(self, turn: int | None, initial: str, fault: str, n: int) -> None:
        if turn is not None:
            self.turns += turn != self.turn
            self.least, self.most, self.turn = turn if self.least is None else self.least, turn, turn
        self.blank += n if fault == BLANK else 0
        self.duplicate += (fault == DUPLICATE) + (n - 1 if fault != BLANK else 0)
        self.truncated += fault == TRUNCATED
        self.illegal += (self.before is not None and self.before + initial not in ("su", "ua", "au")) + n - 1
        self.before = initial
        letter = initial if initial in ("s", "u", "a") else "?"
        self.codes.append(letter + fault + (letter + (BLANK if fault == BLANK else DUPLICATE)) * (n - 1))

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.most is not None else 0
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *solve("".join(self.codes)))


DECISION = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def decide(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text) and of ``ids`` (conv_id; those without rows get zeros and an empty audit)."""
    marked = faults(rows).select("conv_id", "turn", "role", "digest", "n", "fault")
    if ids is not None:
        marks = ids.select("conv_id").distinct().select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n"), F.lit(GONE).alias("fault"))
        marked = marked.unionByName(marks)
    kind = dict(rows.dtypes)["conv_id"]
    in_order = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest").select("conv_id", "turn", F.left("role", F.lit(1)).alias("initial"), "n", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        own, tally, out = object(), None, []
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *[pa.field(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in DECISION.split(", ")]])
            for conv, turn, initial, n, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tally is None or conv != own:
                    if tally is not None:
                        out.append((own, *tally.row()))
                    own, tally = conv, _Tally()
                if fault != GONE:
                    tally.add(turn, initial, fault, n)
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if tally is not None:
            out.append((own, *tally.row()))
        if out:
            yield _batch(out, schema)

    return in_order.mapInArrow(C.tidy(run), f"conv_id {kind}, {DECISION}")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _behind_audits(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, role, text) sorted as ``decide`` takes them, each conversation behind a row of null role that has its audit as text."""
    texts = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", _digest().alias("digest"))
    audits = decisions.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    return texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str | None, str]]:
    for batch in batches:
        for part in C.pieces_of(batch):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


class _Rows:
    """The rows of one conversation at a time out of a sorted stream; the next audit row ends them."""

    def __init__(self, stream: Iterator) -> None:
        self.stream, self.held = stream, None

    def __iter__(self) -> Iterator[tuple[object, Iterator[tuple[str, str]]]]:
        self.held = next(self.stream, None)
        while self.held is not None:
            conv, letters = self.held[0], self.held[2]
            own = self._own()
            yield conv, played(letters, own)
            for _ in own:  # rows that the last letters left
                pass

    def _own(self) -> Iterator[tuple[str, str]]:
        self.held = next(self.stream, None)
        while self.held is not None and self.held[1] is not None:
            role, text = self.held[1:]
            self.held = next(self.stream, None)
            yield role, text


def repaired(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the rows of every repaired conversation, positions from 0."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
        out, size = [], 0
        for conv, done in _Rows(_stream(_chained(first, batches))):
            for k, (role, text) in enumerate(done):
                out.append((conv, k, role, text))
                size += len(text)
                if size > C.CHUNK_BYTES or len(out) >= 4096:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return _behind_audits(rows, decisions).mapInArrow(C.tidy(run), f"conv_id {kind}, position long, role string, text string")


def _chained(first, rest) -> Iterator:
    yield first
    yield from rest


def digests(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired conversation's ``role:text``, joined by line feeds, as lowercase hex."""
    kind = dict(rows.dtypes)["conv_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        schema = pa.schema([first.schema.field(0), ("repaired_sha256", pa.string())])
        out = []
        for conv, done in _Rows(_stream(_chained(first, batches))):
            h = hashlib.sha256()
            for k, (role, text) in enumerate(done):
                h.update(f"{chr(10) if k else ''}{role}:{text}".encode())
            out.append((conv, h.hexdigest()))
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _behind_audits(rows, decisions).mapInArrow(C.tidy(run), f"conv_id {kind}, repaired_sha256 string")


def audit(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``decide`` and ``digests`` in one table; the decisions are written, as both read them."""
    decisions, _ = C.materialise(decide(rows, ids), "repairs")
    hashes = digests(rows, decisions).withColumnRenamed("conv_id", "_conv_")
    return decisions.join(hashes, F.col("conv_id").eqNullSafe(F.col("_conv_"))).drop("_conv_")
