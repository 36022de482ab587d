"""Packing documents into sequences of at most ``capacity`` tokens, as few as it can.

Method. Pieces of one length are alike, so the problem is one over the histogram of lengths (at most ``capacity`` rows). Lengths are put into
classes of ``UNIT`` tokens (rounded up) and a configuration linear program over the classes is solved by multiplicative weights: a class's
weight is its size squared times exp(-ETA * share covered so far); a knapsack dynamic program finds the configuration of greatest
weight among classes that still have demand; it is taken as often as half of what its scarcest class has left allows, and the weights follow.
Every step halves a class, so the steps are at most classes x log2(pieces). Then the solution is rounded: each configuration that all but fills a sequence is
realised its whole number of times with lengths of its classes, all but its smallest member; what is left (those smallest members,
fractions, the shortest pieces, which are not in the program) goes best-fit, longest first, into the open sequences and then into new ones. All of
this works on counts: no step depends on the number of documents.

Distribution. One pass tokenises the documents where they lie, cuts what is longer than ``capacity``, and numbers the pieces of each length within
its task; the pieces (without ids, unless asked for) are written. Counts by task and length, summed up in task order, turn these into ranks; a piece's length
and rank say which sequence and which place in it are its own, by a search in the table of realised configurations, whose size depends on ``capacity`` alone. No sequence
is ever gathered in one place, no row is shuffled but to find its task's offset.

Tokenising. The tokenizer lower-cases, normalises and splits at white space, so pre-tokens never hold a space or a line feed; a text
is cut at those, and each different piece encoded once per worker through a bounded cache. Pieces of Latin letters and ASCII marks take a direct way to the model, all others
the full tokenizer; with a tokenizer of other settings every text does.

Defined results: a null text is empty and gives just the end id; repeated or null ids each get their rows; an empty table gives an empty result; texts that hold a
special token's string are encoded as the tokenizer does by default. Extra columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C
from .token_planes import _Cache

CAPACITY = 4096
#: classes of so many tokens; how fast weights fall; how much more a large piece weighs than its size says; the share of a sequence that a configuration
#: must fill to be used; the share up to which a piece is left to best fit
UNIT, ETA, BEND, FULL, SAND = 16, 0.3, 2.0, 63 / 64, 1 / 16
#: up to so many different lengths, each is a class of its own
FEW = 64
CACHE_WORDS = 600_000


# --- tokenising ---------------------------------------------------------------------------------


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for a lower-casing BPE file that drops white space, with a cache of words."""

    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        assert array("I").itemsize == 4
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        self.plain = self._is_plain(spec)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuttable = self.plain and not any(" " in s or "\n" in s for s in self.special)
        self.shown = self._byte_letters()
        self.pieces = _Cache(self._piece, CACHE_WORDS)

    @staticmethod
    def _is_plain(spec: dict) -> bool:
        level = spec["pre_tokenizer"] or {}
        steps = [s["type"] for s in level.get("pretokenizers", [])]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split = level.get("pretokenizers", [{}])[0]
        # fixed value: the splitting pattern of this family of tokenizers
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        return steps == ["Split", "ByteLevel"] and kinds == ["NFC", "Replace", "Lowercase"] and split.get("pattern") == {"Regex": pattern} and bool(split.get("invert")) and not spec["model"].get("dropout")

    @staticmethod
    def _byte_letters() -> dict[int, int]:
        """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 on."""
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {b: b for b in shown} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece:
            return b""
        core = piece.rstrip(self.MARKS)
        if core.isalpha() and max(core) <= "ɏ" and "İ" not in core:
            tail = piece[len(core) :]
            low = core.lower()
            if not tail:
                return self._word(low) if low == core else self.pieces[low]
            return self.pieces[low] + self.pieces[tail] if not any(s in piece for s in self.special) else self._whole(piece)
        if not core:
            return self._word(piece) if not any(s in piece for s in self.special) else self._whole(piece)
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuttable:
            return self._whole(text)
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document's ids and ``end_id``: place in the document, length, checksum, and number among those of its length in its task; ``with_ids`` also the ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, codec, end = TaskContext.get().partitionId(), encoder(tokenizer), array("I", [end_id]).tobytes()
        seen: Counter[int] = Counter()
        for batch in batches:
            for part in C.pieces_of(batch):
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids = codec.encode(text.as_py()) + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc, k, at // 4, n, zlib.crc32(own), task, seen[n], *([own] if with_ids else [])))
                        seen[n] += 1
                kinds = [part.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = PIECES.format(id=dict(docs.dtypes)["doc_id"]) + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(C.tidy(run), schema)


# --- the configuration linear program ------------------------------------------------------------


def best_configuration(profit: np.ndarray, sizes: np.ndarray, room: int) -> list[int]:
    """Positions in ``sizes`` (ascending whole numbers), with repetitions, of a multiset of total size at most ``room`` and greatest profit: the unbounded knapsack's dynamic program."""
    value, take = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        fit = int(np.searchsorted(sizes, r, "right"))
        value[r] = value[r - 1]
        if fit:
            got = value[r - sizes[:fit]] + profit[:fit]
            k = int(got.argmax())
            if got[k] > value[r]:
                value[r], take[r] = got[k], k
    out = []
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            out.append(int(take[room]))
            room -= int(sizes[take[room]])
    return out


def configurations(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], float]]:
    """A fractional solution of the configuration linear program: [({class size: members}, times)], no class covered beyond its demand; what a class has left is below one member."""
    sizes = np.array(sorted(demand), dtype=np.int64)
    need = np.array([demand[s] for s in sizes.tolist()], float)
    left, weight, out = need.copy(), sizes.astype(float) ** BEND, []
    while (live := np.flatnonzero(left >= 1.0)).size:
        # a class has no more members in a configuration than it has left
        chosen = Counter(live[k] for k in best_configuration(weight[live], sizes[live], room))
        members = {int(k): min(n, int(left[k])) for k, n in chosen.items()}
        times = max(1.0, 0.5 * min(left[k] / n for k, n in members.items()))
        for k, n in members.items():
            left[k] -= n * times
            weight[k] *= math.exp(-ETA * n * times / need[k])
        out.append(({int(sizes[k]): n for k, n in members.items()}, times))
    return out


class _Open:
    """Open sequences by the room they have left: contents (lengths in order) with a number of sequences each."""

    def __init__(self, capacity: int) -> None:
        self.groups: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
        self.some = 0  # bit r: there is a sequence with room r

    def add(self, room: int, content: tuple[int, ...], count: int) -> None:
        group = self.groups[room]
        group[content] = group.get(content, 0) + count
        self.some |= 1 << room

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length``."""
        fit = self.some >> length
        return length + (fit & -fit).bit_length() - 1 if fit else None

    def take(self, room: int, most: int) -> tuple[tuple[int, ...], int]:
        group = self.groups[room]
        content, count = next(iter(group.items()))
        if count <= most:
            del group[content]
            if not group:
                self.some &= ~(1 << room)
            return content, count
        group[content] = count - most
        return content, most


def plan(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in order, number of sequences)] that hold exactly the pieces of ``histogram`` (length: count)."""
    left = {length: n for length, n in histogram.items() if n > 0}
    if len(left) <= FEW:
        unit = 1
    open_ = _Open(capacity)
    classes: dict[int, list[int]] = {}
    demand: Counter[int] = Counter()
    for length in sorted(left):
        size = -(-length // unit)
        if length <= SAND * capacity:
            continue
        classes.setdefault(size, []).append(length)
        demand[size] += left[length]
    for members, times in configurations(demand, capacity // unit) if capacity >= unit else []:
        if sum(s * n for s, n in members.items()) < FULL * (capacity // unit):
            continue
        count = int(times + 1e-9)
        slots = sorted((s for s, n in members.items() for _ in range(n)), reverse=True)
        _realise(slots[: max(1, len(slots) - 1)], count, classes, left, open_, capacity)
    _best_fit(left, open_, capacity)
    return [(content, n) for group in open_.groups for content, n in group.items()]


def _realise(slots: list[int], count: int, classes: dict[int, list[int]], left: dict[int, int], open_: _Open, capacity: int) -> None:
    """Open ``count`` sequences with a member of each slot's class, of whatever lengths the classes have left, longest first."""
    while count > 0:
        chosen: list[int] = []
        for s in slots:
            own = classes[s]
            while own and (left.get(own[-1], 0) - chosen.count(own[-1]) <= 0):
                if left.get(own[-1], 0):  # the last of it is in this very sequence
                    break
                own.pop()
            spare = next((x for x in reversed(own) if left[x] - chosen.count(x) > 0), None)
            if spare is not None:
                chosen.append(spare)
        if not chosen:
            return
        n = min(count, *(left[x] // chosen.count(x) for x in set(chosen)))
        for x in chosen:
            left[x] -= n
        open_.add(capacity - sum(chosen), tuple(chosen), n)
        count -= n


def _best_fit(left: dict[int, int], open_: _Open, capacity: int) -> None:
    """Every piece that is left, longest first, into the open sequence with the least room that holds it, else into a new one."""
    for length in sorted((x for x, n in left.items() if n), reverse=True):
        n = left[length]
        while n:
            room = open_.tightest(length)
            if room is None:
                each = min(n, capacity // length)
                full, over = divmod(n, each)
                open_.add(capacity - each * length, (length,) * each, full)
                if over:
                    open_.add(capacity - over * length, (length,) * over, 1)
                n = 0
            else:
                each = min(n, room // length)
                content, count = open_.take(room, n // each)
                open_.add(room - each * length, content + (length,) * each, count)
                n -= each * count
        left[length] = 0


# --- from configurations to places ----------------------------------------------------------------


class Places:
    """Where the piece of a length and a rank goes, as arrays sorted by length and rank."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]]) -> None:
        used: Counter[int] = Counter()
        rows, base = [], 0
        for content, count in planned:
            offset = 0
            for length, n in Counter(content).items():
                rows.append((length, used[length], n, base, offset))
                used[length] += n * count
                offset += n * length
            base += count
        rows.sort()
        self.length, self.first, self.members, self.base, self.offset = (np.array(c, np.int64) for c in (zip(*rows, strict=True) if rows else ((),) * 5))
        self.key = self.length << np.int64(48) | self.first
        self.sequences = base

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        k = np.searchsorted(self.key, length << np.int64(48) | rank, "right") - 1
        at = rank - self.first[k]
        return self.base[k] + at // self.members[k], self.offset[k] + at % self.members[k] * length


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece; ``with_ids`` also its ids. ``sequence_id`` runs from 0, ``offset`` is the place in the sequence."""
    own, _ = C.materialise(pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    counts, _ = C.materialise(own.groupBy("task", "length").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = Places(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = own.join(bases, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before"))
    extra = ["ids"] if with_ids else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            sequence, offset = places.of(get("length"), get("rank"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(get("length")), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset), *(batch.column(c) for c in extra)], names)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return ranked.mapInArrow(C.tidy(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, offsets, ids): the packed sequences themselves, of ``pack(..., with_ids=True)``; a sequence has at most ``capacity`` pieces."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    whole = packed.groupBy("sequence_id").agg(rows.alias("rows"))
    joined = F.aggregate("rows", F.unhex(F.lit("")), lambda a, r: F.concat(a, r["ids"]))
    return whole.select("sequence_id", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.offset").alias("offsets"), joined.alias("ids"))
