"""Benchmark decontamination: BM25 over the test items, block-max WAND, then overlap checks.

The items are the indexed collection and every passage of the corpus is a query (half-overlapping
windows of ``2 * STRIDE`` words over the whole text). An item of more than ``STRIDE`` words is indexed
as pieces of that length, which overlap so that every five-word shingle lies in one of them; any
``STRIDE`` words of a text lie whole in some passage. Weights are BM25 contributions divided by the
piece's score of itself, so one threshold serves items of any length; an item is retrieved with the
score of its best piece. Retrieval is by BM25 alone: a copy that keeps the shingle overlap but has lost just those words that hold nearly
all of an item's weight is not retrieved (items of one template, which differ in a few words of their own, when these are what was cut or changed).

The index is inverted: for each term a list of its postings (piece, weight) in the order of the pieces, cut into blocks of
``BLOCK`` pieces; of each block of a list its greatest weight is kept, and of each list the greatest of all. Pieces of similar length (to a
power of two) have lists of their own, as a word's weight in a short piece says nothing of the long ones. As the threshold is known, the most frequent
words of a piece, up to a weight that cannot reach it alone, need no postings; their weight is kept as a number of the piece, and its maximum of the block.

Block-max WAND, for a passage at a time. (0) Passages whose lists' maxima cannot sum to the threshold are skipped, a batch of them at once. (1) The block
maxima of the passage's lists are summed, for many passages at once; blocks that cannot reach the threshold with their light words are skipped. (2) The postings of the other
blocks are read; pieces that cannot reach it are skipped. (3) What is left is scored exactly. All items with a piece at or
above the threshold are retrieved; there is no top-k and no cap.

Verification. Retrieved pairs are read word for word: the share of the item's distinct five-word
shingles inside the passage (stretched by the item's length on both sides) must reach ``overlap``.
Of an item with an answer, which is what follows its last ``?`` or ``Answer:``, both the question part and
the answer part must be found to ``part`` of theirs as well: by shingles, or, for parts of 3 to ``STRIDE``
words, word by word in order (one less the edits a word to the nearest stretch of the text), whichever is more.
Items without an answer have null for these two.

Scale. A pass over the corpus for each part of the index, no shuffle of it. Document frequencies and lengths are counted in Spark. The items are dealt by hash to as many parts as
keep each part's index at about ``max_index_bytes`` (some 100,000 items of 60 words); parts are built, broadcast and searched one after the other, so that what
is broadcast, or held by the driver, is bounded whatever the benchmark's size, but for an item that is larger alone.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased. Defined
results: null or wordless texts and items match nothing; items or parts of fewer than five
words have their whole sequence as their one shingle; repeated items or documents each match on their own
(rows equal in both ids, null ones too, count once); items without an id are searched like others and have a null
``item_id``; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

WIDTH, STRIDE, BLOCK = 5, 64, 16
#: How much of the threshold the terms of a piece may weigh that have no postings.
LIGHT = 0.75
#: How many sums of block maxima are held at once.
BOUNDS = 1 << 17
K1, LENGTH_WEIGHT = 1.2, 0.75
OUT = "doc_id long, item_id long, score double, overlap double, question_overlap double, answer_overlap double"


@dataclass
class Item:
    """Word hashes of an item and of its two parts."""

    item_id: int
    words: np.ndarray
    question: np.ndarray | None
    answer: np.ndarray | None


@dataclass
class Lists:
    """The inverted lists of the pieces of one class of lengths; ``owner`` is each piece's item.

    By term: ``list_max``, and ``lists`` (its first block entry). Block entries, by term and block: ``block``,
    ``block_max`` and ``postings`` (the first posting). Postings: ``piece`` and ``weight``. They hold each piece's
    essential terms; ``light`` is what its other terms weigh together, and ``light_max`` the most of that in a block. By
    piece, for exact scores: ``forward`` (its first place), ``term`` and ``term_weight`` of all its terms.
    """

    list_max: np.ndarray
    lists: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    postings: np.ndarray
    piece: np.ndarray
    weight: np.ndarray
    light: np.ndarray
    light_max: np.ndarray
    forward: np.ndarray
    term: np.ndarray
    term_weight: np.ndarray
    owner: np.ndarray


@dataclass
class Index:
    """Sorted hashes of all terms, the lists of each class, and the items."""

    terms: np.ndarray
    classes: list[Lists]
    items: list[Item]


def words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    for first, end, buf, offsets in C.slices(texts):
        s, e, row = C.word_spans(C.NOT_ALNUM[buf], offsets)
        words = C.span_hashes(C.BYTES[buf], s, e)
        cut = np.searchsorted(row, np.arange(end - first + 1))
        for i in range(end - first):
            yield words[cut[i] : cut[i + 1]]


def split_item(text: str) -> tuple[str | None, str | None]:
    """(question, answer) of an item's text; none where nothing marks an answer or a part has no words."""
    low = text.lower()
    cut = low.rfind("answer:")
    cut = cut + 7 if cut > 0 else text.rfind("?") + 1
    if 0 < cut < len(text) and text[cut:].strip() and text[:cut].strip():
        return text[:cut], text[cut:]
    return None, None


def piece_starts(n: int) -> list[int]:
    """Where the pieces of an item of ``n`` words begin; each has ``STRIDE`` words, or all of a shorter item."""
    if n <= STRIDE:
        return [0]
    last = n - STRIDE
    return [*range(0, last, STRIDE - WIDTH + 1), last]


def build_index(rows: list[tuple[int, str]], n_items: int, frequency: tuple[np.ndarray, np.ndarray], mean_words: float, threshold: float) -> Index:
    """The index of ``rows`` (id, text); the statistics are those of the whole benchmark: ``frequency`` has sorted term hashes and the numbers of items that hold them."""
    texts = [t for _, t in rows]
    halves = [split_item(t) for t in texts]
    words = list(words_of(pa.array(texts, pa.string())))
    questions = list(words_of(pa.array([q for q, _ in halves], pa.string())))
    answers = list(words_of(pa.array([a for _, a in halves], pa.string())))
    parts = [(q, a) if len(q) and len(a) else (None, None) for q, a in zip(questions, answers, strict=True)]
    items = [Item(i, w, q, a) for (i, _), w, (q, a) in zip(rows, words, parts, strict=True)]
    pieces = [(i, w[a : a + STRIDE]) for i, w in enumerate(words) if len(w) for a in piece_starts(len(w))]
    terms = np.unique(np.concatenate([w for _, w in pieces])) if pieces else np.zeros(0, np.uint64)
    df = frequency[1][np.searchsorted(frequency[0], terms)] if len(terms) else np.zeros(0)
    idf = np.log(1 + (n_items - df + 0.5) / (df + 0.5))
    classes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, w in pieces:
        classes.setdefault((len(w) - 1).bit_length(), []).append((i, w))
    return Index(terms, [_lists(terms, idf, classes[k], mean_words, threshold) for k in sorted(classes)], items)


def _lists(terms: np.ndarray, idf: np.ndarray, pieces: list[tuple[int, np.ndarray]], mean_words: float, threshold: float) -> Lists:
    sizes = np.array([len(w) for _, w in pieces], np.int64)
    n, v, blocks = len(pieces), len(terms), -(-len(pieces) // BLOCK)
    term = np.searchsorted(terms, np.concatenate([w for _, w in pieces]))
    # by piece, then term
    place, tf = np.unique(np.repeat(np.arange(n), sizes) * v + term, return_counts=True)
    piece, term = place // v, place % v
    weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_WEIGHT + LENGTH_WEIGHT * sizes[piece] / mean_words))
    weight /= np.bincount(piece, weights=weight, minlength=n)[piece]
    forward = np.searchsorted(piece, np.arange(n + 1))
    # the most frequent terms of a piece that together stay below LIGHT of the threshold are not essential
    order = np.lexsort((term, idf[term], piece))
    sums = np.cumsum(weight[order])
    before = np.concatenate(([0.0], sums))[forward[:-1]]
    light = np.zeros(len(order), bool)
    light[order] = sums - before[piece[order]] < LIGHT * threshold
    rest = np.bincount(piece, weights=weight * light, minlength=n)
    list_max = np.zeros(v, np.float32)
    np.maximum.at(list_max, term, weight.astype(np.float32))
    by_term = np.flatnonzero(~light)
    by_term = by_term[np.lexsort((piece[by_term], term[by_term]))]
    key, postings = np.unique(term[by_term] * blocks + piece[by_term] // BLOCK, return_index=True)
    block_max = np.maximum.reduceat(weight[by_term], postings)
    light_max = np.maximum.reduceat(rest, np.arange(0, n, BLOCK))
    return Lists(
        list_max, np.searchsorted(key, np.arange(v + 1) * blocks), (key % blocks).astype(np.int32), block_max.astype(np.float32), np.append(postings, len(by_term)), piece[by_term].astype(np.int32),
        weight[by_term].astype(np.float32), rest, light_max, forward, term.astype(np.int32), weight.astype(np.float32), np.array([i for i, _ in pieces], np.int64),
    )


def _ranges(first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """All places of the ranges from ``first`` up to ``after``."""
    size = after - first
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


def promising(index: Lists, passage: np.ndarray, terms: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Which of ``n`` passages hold a block whose maxima, with its light words, reach the threshold; their distinct ``terms`` (numbers), each with its ``passage``."""
    first, after = index.lists[terms], index.lists[terms + 1]
    entries = _ranges(first, after)
    key = np.repeat(passage, after - first) * len(index.light_max) + index.block[entries]
    sums = np.bincount(key, weights=index.block_max[entries], minlength=n * len(index.light_max)).reshape(n, -1)
    return (sums + index.light_max >= threshold - 1e-5).any(axis=1)


def search(index: Lists, terms: np.ndarray, held: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, scores) of all pieces whose score for the distinct ``terms`` (numbers) reaches the threshold, by block-max WAND; ``held`` is true at these terms."""
    none, threshold = (np.zeros(0, np.int64), np.zeros(0)), threshold - 1e-5
    entries = _ranges(index.lists[terms], index.lists[terms + 1])
    if not len(entries):
        return none
    blocks, place = np.unique(index.block[entries], return_inverse=True)
    keep = np.bincount(place, weights=index.block_max[entries], minlength=len(blocks)) + index.light_max[blocks] >= threshold
    if not keep.any():
        return none
    entries = entries[keep[place]]
    read = _ranges(index.postings[entries], index.postings[entries + 1])
    pieces, place = np.unique(index.piece[read], return_inverse=True)
    pieces = pieces[np.bincount(place, weights=index.weight[read]) + index.light[pieces] >= threshold]
    if not len(pieces):
        return none
    size = index.forward[pieces + 1] - index.forward[pieces]
    own = _ranges(index.forward[pieces], index.forward[pieces + 1])
    scores = np.bincount(np.repeat(np.arange(len(pieces)), size), weights=index.term_weight[own] * held[index.term[own]], minlength=len(pieces))
    keep = scores >= threshold
    return pieces[keep], scores[keep]


def retrieve(index: Index, docs: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, int, float]]:
    """(document, passage, item, its best piece's score) of all passages at or above the threshold in ``docs``, lists of word hashes."""
    if not len(index.terms):
        return
    lengths = np.array([len(d) for d in docs])
    words = np.concatenate(docs) if len(docs) else np.zeros(0, np.uint64)
    term = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    hit = index.terms[term] == words
    starts = np.cumsum(lengths) - lengths
    doc = np.repeat(np.arange(len(docs)), lengths)[hit]
    segments = -(-lengths // STRIDE)
    base = np.cumsum(segments + 1) - segments - 1  # one empty segment between documents
    segment = base[doc] + (np.flatnonzero(hit) - starts[doc]) // STRIDE
    n_segments = int((segments + 1).sum())
    v = len(index.terms)
    own = np.unique(segment * v + term[hit])
    seg, t = own // v, own % v
    first = np.searchsorted(seg, np.arange(n_segments + 2))
    doc_of = np.repeat(np.arange(len(docs)), segments + 1)
    inside = np.arange(n_segments) - base[doc_of] < segments[doc_of]
    held = np.zeros(v, bool)
    # terms that a segment shares with the next count once in the passage of both
    again = np.minimum(np.searchsorted(own, own + v), len(own) - 1) if len(own) else own
    twin = own[again] == own + v
    both = np.flatnonzero(twin)
    for lists in index.classes:
        bound = np.bincount(seg, weights=lists.list_max[t], minlength=n_segments + 1)
        twice = np.bincount(seg[both], weights=lists.list_max[t[both]], minlength=n_segments + 1)
        hopeful = np.flatnonzero((bound[:-1] + bound[1:] - twice[:-1] >= threshold - 1e-6)[:n_segments] & inside)
        # the blocks of many passages at once, at most BOUNDS sums
        some = max(1, BOUNDS // len(lists.light_max))
        for k in range(0, len(hopeful), some):
            part = hopeful[k : k + some]
            middle, after = first[part + 1], first[np.minimum(part + 2, n_segments)]
            at = _ranges(first[part], middle)
            passage = np.repeat(np.arange(len(part)), middle - first[part])[~twin[at]]
            rest = np.repeat(np.arange(len(part)), after - middle)
            hopeful[k : k + some][~promising(lists, np.concatenate((passage, rest)), t[np.concatenate((at[~twin[at]], _ranges(middle, after)))], len(part), threshold)] = -1
        for p in hopeful[hopeful >= 0].tolist():
            lo, hi = first[p], first[min(p + 2, n_segments)] if p + 1 < n_segments else first[p + 1]
            best: dict[int, float] = {}
            terms = np.unique(t[lo:hi])
            held[terms] = True
            pieces, scores = search(lists, terms, held, threshold)
            held[terms] = False
            for i, score in zip(lists.owner[pieces].tolist(), scores.tolist(), strict=True):
                best[i] = max(best.get(i, 0.0), score)
            for i, score in best.items():
                yield int(doc_of[p]), int(p - base[doc_of[p]]), i, score


def _share(needle: np.ndarray, hay: np.ndarray) -> float:
    """The share of the distinct shingles of ``needle`` (word hashes) that ``hay`` has; 1 for no words."""
    if not len(needle):
        return 1.0
    width = min(WIDTH, len(needle))
    if len(hay) < width:
        return 0.0
    return float(np.isin(np.unique(C.shingles(needle, width)), C.shingles(hay, width)).mean())


def _aligned(needle: np.ndarray, hay: np.ndarray) -> float:
    """One less the least number of word edits from ``needle`` to any stretch of ``hay``, as a share of its words."""
    steps = np.arange(len(hay) + 1)
    edits = np.zeros(len(hay) + 1, np.int64)
    for word in needle:
        below = edits + 1
        below[1:] = np.minimum(below[1:], edits[:-1] + (hay != word))
        edits = np.minimum.accumulate(below - steps) + steps
    return 1 - float(edits.min()) / len(needle)


def _part_share(needle: np.ndarray, hay: np.ndarray) -> float:
    share = _share(needle, hay)
    return max(share, _aligned(needle, hay)) if 2 < len(needle) <= STRIDE and share < 1 else share


def verify(item: Item, words: np.ndarray, passage: int, overlap: float) -> tuple[float, float | None, float | None]:
    """The share of the item's shingles around the passage and, if that reaches ``overlap``, those of its question and answer."""
    near = words[max(0, passage * STRIDE - len(item.words)) : (passage + 2) * STRIDE + len(item.words)]
    whole = _share(item.words, near)
    if whole < overlap or item.answer is None:
        return whole, None, None
    return whole, _part_share(item.question, near), _part_share(item.answer, near)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part: float = 0.5, max_index_bytes: int = 192 << 20) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap): documents of ``docs`` (doc_id, text) that hold items of ``benchmark`` (item_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], OUT)
    indexes = _Parts(benchmark, threshold, max_index_bytes)
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        found = texts.mapInArrow(C.tidy(_search(shared, threshold, overlap, part)), OUT)
        if indexes.n > 1:  # searched before the next part is built
            found, _ = C.materialise(found, "matches")
            shared.destroy()
        out = out.union(found)
    return out.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "overlap", "question_overlap", "answer_overlap")])


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, overlap: float = 0.8, part: float = 0.5, max_index_bytes: int = 192 << 20) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``benchmark``; columns unchanged, no shuffle."""
    spark = docs.sparkSession

    def keep(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {row for row, *_ in _matches(shared.value, batch.column(batch.schema.get_field_index("text")), threshold, overlap, part)}
                yield batch.filter(pa.array([k not in held for k in range(batch.num_rows)], pa.bool_()))

        return run

    indexes, before = _Parts(benchmark, threshold, max_index_bytes), None
    for index in indexes:
        shared = spark.sparkContext.broadcast(index)
        docs = docs.mapInArrow(C.tidy(keep(shared)), docs.schema)
        if indexes.n > 1:
            docs, at = C.materialise(docs, "clean")
            shared.destroy()
            if before:
                C.delete(spark, before)
            before = at
    return docs


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, items, words, pieces): a row for each distinct term of each batch, and one without a term that has the batch's totals."""
    for batch in batches:
        seen: list[np.ndarray] = []
        n = words = pieces = 0
        for w in words_of(batch.column("text")):
            seen.append(np.unique(w))
            n, words, pieces = n + bool(len(w)), words + len(w), pieces + (len(w) and sum(min(len(w), STRIDE) for _ in piece_starts(len(w))))
        terms, count = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.uint64), return_counts=True)
        blank = [0] * len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*terms.view(np.int64).tolist(), None], pa.int64()), pa.array([*count.tolist(), n], pa.int64()), pa.array([*blank, words], pa.int64()), pa.array([*blank, pieces], pa.int64())],
            names=["term", "items", "words", "postings"],
        )


class _Parts:
    """The benchmark's indexes, of about ``max_bytes`` each, built one at a time; ``n`` is their number."""

    def __init__(self, benchmark: DataFrame, threshold: float, max_bytes: int) -> None:
        self.threshold = threshold
        items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
        self.items, self.at = C.materialise(items, "items")
        self.terms, self.terms_at = C.materialise(self.items.mapInArrow(_item_terms, "term long, items long, words long, postings long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("items", "words", "postings")]), "item-terms")
        self.totals = self.terms.filter("term is null").first()
        # at most 24 bytes a posting with its share of a block entry, 8 a place of the forward lists, 16 a word for the check
        size = 32 * self.totals.postings + 16 * self.totals.words if self.totals else 0
        self.n = -(-size // max_bytes) if self.totals and self.totals.items else 0

    def __iter__(self) -> Iterator[Index]:
        key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, self.n)))
        for k in range(self.n):
            own = self.items.filter(key == k)
            mine = own.mapInArrow(_item_terms, "term long, items long, words long, postings long").filter("term is not null").select("term").distinct() if self.n > 1 else None
            counts = (self.terms.join(mine, "term") if mine is not None else self.terms.filter("term is not null")).select("term", "items").toArrow()
            terms, n = counts["term"].to_numpy().view(np.uint64), counts["items"].to_numpy()
            order = np.argsort(terms)
            rows = own.toArrow().to_pylist()
            yield build_index([(r["item_id"], r["text"]) for r in rows], self.totals.items, (terms[order], n[order]), self.totals.words / self.totals["items"], self.threshold)
        for at in (self.at, self.terms_at):
            C.delete(self.items.sparkSession, at)


def _matches(index: Index, texts: pa.Array, threshold: float, overlap: float, part: float) -> Iterator[tuple]:
    """(row, item_id, score, overlap, question overlap, answer overlap) of the verified matches."""
    block: list[np.ndarray] = []
    size = at = 0

    def matched() -> Iterator[tuple]:
        for d, p, k, score in retrieve(index, block, threshold):
            item = index.items[k]
            whole, question, answer = verify(item, block[d], p, overlap)
            if whole >= overlap and (answer is None or question >= part and answer >= part):
                yield at + d, item.item_id, score, whole, question, answer

    for words in words_of(texts):
        block.append(words)
        size += len(words)
        if size >= 200_000:
            yield from matched()
            at, block, size = at + len(block), [], 0
    yield from matched()


def _search(shared, threshold: float, overlap: float, part: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            found = [(ids[row], *rest) for row, *rest in _matches(shared.value, batch.column("text"), threshold, overlap, part)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 6
            kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return run
