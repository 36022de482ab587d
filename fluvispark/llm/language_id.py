"""Language identification by word-first backoff.

A known word scores by its smoothed log frequency in each language. An unseen word falls back
to its character 4-grams; if the model knows none of them to its 3-grams, 2-grams and at last
single letters. A text's language is the one of the greatest mean score over its words.

Fitting counts words and n-grams with ordinary group-bys over about ``max_docs_per_language`` labelled documents of
each language (all of a language that has fewer; else those whose hash of the id is below the language's share; whole texts), so that it costs the
same at any corpus size and no language is left out for being rare. Words and n-grams seen fewer than ``min_count`` times in all
are not learned; nothing is ranked or cut off. The model is sparse: a row for each (entry, language) seen, 8 bytes, and 12 an entry, whatever the number of
languages; its size is bounded by that of the sample. Scoring is one vectorised pass with no shuffle.

Words are runs of letters and combining marks (Unicode categories L and M, all planes, lower-cased) with at least one letter.
Defined results: a null text, or one with no letter, is ``und`` with score 0. Training rows with
a null lang, text or id are left out. With no training rows at all every text is ``und``. Ties go
to the first language in code-point order. The score is the winner's share, 0 to 1, of the
softmax of the languages' mean scores, sharpened by ``sharpness``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

ORDERS = (4, 3, 2, 1)
UNDETERMINED = "und"
CHUNK_CHARS = 1 << 18
#: Cells of a matrix of distinct words by languages at a time.
CELLS = 1 << 21


@dataclass
class Order:
    """Sorted 64-bit keys; the languages and gains over ``floor`` of each, from ``first[k]`` to ``first[k + 1]``."""

    keys: np.ndarray
    first: np.ndarray
    lang: np.ndarray
    gain: np.ndarray
    floor: np.ndarray


@dataclass
class Model:
    """An ``Order`` for whole words (0) and for each length of n-gram; ``floor`` is the log frequency of an entry never seen in a language."""

    languages: list[str]
    orders: dict[int, Order]


def _letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to words, and whether it is a letter; no letters are assigned above plane 3."""
    word, letter = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x40000)]
    letter[:0x40000] = [k == "L" for k in kinds]
    word[:0x40000] = [k in "LM" for k in kinds]
    return word, letter


_LETTERS: list[tuple[np.ndarray, np.ndarray]] = []


def _symbols(points: np.ndarray) -> np.ndarray:
    return C.mix(points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbol values of all lower-cased code points, then starts, ends and text numbers of the words."""
    if not _LETTERS:
        _LETTERS.append(_letter_tables())
    word, letter = _LETTERS[0]
    lowered = [(t or "").lower() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lowered])))
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, ends, row = C.word_spans(~word[points], offsets)
    letters = np.concatenate(([0], np.cumsum(letter[points])))
    some = letters[ends] > letters[starts]
    return _symbols(points), starts[some], ends[some], row[some]


def gram_spans(starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all ``order``-grams within the words, and the words they belong to."""
    counts = np.maximum(ends - starts - order + 1, 0)
    word = np.repeat(np.arange(len(starts)), counts)
    within = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    return starts[word] + within, word


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, key, lang, n): words and n-grams of each batch, counted before the shuffle."""
    for batch in (part for whole in batches for part in C.pieces_of(whole, 1024)):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for part in _parts(own):
                values, s, e, _ = words_of(part)
                for order in (0, *ORDERS):
                    at, _ = (s, None) if not order else gram_spans(s, e, order)
                    keys, n = np.unique(C.span_hashes(values, at, e if not order else at + order), return_counts=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(keys), order, np.int32)), pa.array(keys.view(np.int64)), pa.array([lang] * len(keys)), pa.array(n.astype(np.int64))],
                            names=["order", "key", "lang", "n"],
                        )


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(training: DataFrame, max_docs_per_language: int = 3_000, min_count: int = 2) -> Model:
    """A model from rows (doc_id, text, lang); see the module's docstring for the bounds."""
    rows = training.filter("lang is not null and text is not null and doc_id is not null").select("doc_id", "text", "lang")
    docs = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    languages = sorted(docs)
    if not languages:
        return Model([], {})
    # of a large language the documents with a hash below its share
    steps = 1 << 20
    share = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in languages]), F.array(*[F.lit(-(-max_docs_per_language * steps // docs[x])) for x in languages])), F.col("lang"))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share).select("text", "lang")
    number = F.element_at(F.map_from_arrays(F.array(*[F.lit(x) for x in languages]), F.array(*[F.lit(k) for k in range(len(languages))])), F.col("lang"))
    counts = sample.mapInArrow(C.tidy(_count_units), "order int, key long, lang string, n long").groupBy("order", "key", "lang").agg(F.sum("n").alias("n"))
    counts, at = C.materialise(counts.select(F.col("order").cast("byte").alias("order"), "key", number.cast("int").alias("lang"), F.col("n").cast("int").alias("n")), "language-counts")
    totals = {(r.order, r.lang): r.n for r in counts.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()}
    often = F.sum("n").over(Window.partitionBy("order", "key"))  # a window holds at most one row a language
    table = counts.withColumn("often", often).filter(F.col("often") >= min_count).drop("often").toArrow()
    C.delete(training.sparkSession, at)
    order_of, keys, langs, n = (table[c].to_numpy() for c in ("order", "key", "lang", "n"))
    keys = keys.view(np.uint64)
    orders = {}
    for order in (0, *ORDERS):
        own = np.flatnonzero(order_of == order)
        own = own[np.lexsort((langs[own], keys[own]))]
        distinct, first = np.unique(keys[own], return_index=True)
        total = np.array([totals.get((order, x), 0) for x in range(len(languages))], float) + 0.1 * max(1, len(distinct))
        gain = np.log((n[own] + 0.1) / 0.1)
        orders[order] = Order(distinct, np.append(first, len(own)).astype(np.int64), langs[own], gain.astype(np.float32), np.log(0.1 / total))
    return Model(languages, orders)


def _units(model: Model, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Scores of distinct words (rows) by language, each by the first order that knows something of it; 0 if none does."""
    languages = len(model.languages)
    unit, open_ = np.zeros((len(hashes), languages)), np.ones(len(hashes), bool)
    for order in (0, *ORDERS):
        todo, own = np.flatnonzero(open_), model.orders[order]
        if not len(todo) or not len(own.keys):
            continue
        at, word = (starts[todo], np.arange(len(todo))) if not order else gram_spans(starts[todo], ends[todo], order)
        grams = hashes[todo] if not order else C.span_hashes(values, at, at + order)
        k = np.minimum(np.searchsorted(own.keys, grams), len(own.keys) - 1)
        hit = own.keys[k] == grams
        word, k = word[hit], k[hit]
        n = np.bincount(word, minlength=len(todo))
        got = n > 0
        # the languages of every hit
        size = own.first[k + 1] - own.first[k]
        place = np.repeat(own.first[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
        cell = np.repeat(word, size) * languages + own.lang[place]
        gains = np.bincount(cell, weights=own.gain[place], minlength=len(todo) * languages).reshape(-1, languages)
        unit[todo[got]] = own.floor + gains[got] / n[got][:, None]
        open_[todo[got]] = False
    return unit


def score_texts(model: Model, texts: list[str | None], sharpness: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(index of the language or -1, score) of each text."""
    best, share = np.full(len(texts), -1), np.zeros(len(texts))
    values, s, e, row = words_of(texts)
    languages = len(model.languages)
    if not len(s) or not languages:
        return best, share
    hashes, first, where = np.unique(C.span_hashes(values, s, e), return_index=True, return_inverse=True)
    total = np.zeros((len(texts), languages))
    step = max(1, CELLS // languages)
    for lo in range(0, len(hashes), step):
        part = first[lo : lo + step]
        unit = _units(model, values, s[part], e[part], hashes[lo : lo + step])
        seen = np.flatnonzero((where >= lo) & (where < lo + step)) if len(hashes) > step else np.arange(len(where))
        for x in range(languages):
            total[:, x] += np.bincount(row[seen], weights=unit[where[seen] - lo, x], minlength=len(texts))
    n = np.bincount(row, minlength=len(texts))
    mean = total / np.maximum(n, 1)[:, None]
    p = np.exp(sharpness * (mean - mean.max(axis=1, keepdims=True)))
    p /= p.sum(axis=1, keepdims=True)
    some = n > 0
    best[some] = mean.argmax(axis=1)[some]
    share[some] = p.max(axis=1)[some]
    return best, share


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) per row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.languages, UNDETERMINED], object)
        for batch in (part for whole in batches for part in C.pieces_of(whole)):
            texts = batch.column("text")
            best, share, i = np.full(batch.num_rows, -1), np.zeros(batch.num_rows), 0
            for part in _parts(texts.to_pylist()):
                best[i : i + len(part)], share[i : i + len(part)] = score_texts(m, part)
                i += len(part)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(C.tidy(run), "doc_id long, lang_pred string, score double")


def accept(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language, by a score of at least ``min_score``; columns unchanged, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in C.pieces_of(whole)):
            keep = []
            for part in _parts(batch.column(batch.schema.get_field_index("text")).to_pylist()):
                best, share = score_texts(shared.value, part)
                keep += ((best >= 0) & (share >= min_score)).tolist()
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(C.tidy(run), docs.schema)


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return C.crc_of_id() % 4 == 2
