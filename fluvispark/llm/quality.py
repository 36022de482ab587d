"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good, bad or abstain. Expectation-maximisation
(Dawid and Skene, 1979) estimates, without any hand label, how often each labeller says what for
good and for bad documents, and the share of good ones. It runs over the counts of vote patterns: at
most 3**8 rows whatever the corpus, counted over all documents. The posterior of a document's
pattern is its training label; a logistic scorer over hashed words, word shapes and shares of repetition is trained on a
bounded sample (``max_training_docs`` documents of the least hash of their id, whole texts; at most
``2 * BUCKETS`` weights are broadcast) and scores every document, in two scans and no wide shuffle.

Defined results: a null or wordless text has posterior and score 0 and is not kept; with no
documents, or only wordless ones, there is no model and every score is 0; repeated rows each get a row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BUCKETS = 1 << 16
#: Buckets at the end that are for shapes of words and shares of repetition.
SHAPES = 512
LABELLERS = ("symbols", "capitals", "length", "word_length", "variety", "line_ends", "line_repeats", "function_words")
GOOD, BAD, ABSTAIN = 1, 0, 2
# fixed values: common function words of the languages expected
FUNCTION_WORDS = """
the of and to in a is that for it was on with as by this be are at from
de la le et les des en un une que est pour dans du au sur par qui
der die das und ist nicht mit den von zu im auf ein eine sich als
el los las y por con para se no su del al
""".split()


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[[ord(c) for c in chars]] = 1
    return t


SYMBOL = _class("#$%&*+/<=>@[\\]^_`{|}~!")
UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = _class("abcdefghijklmnopqrstuvwxyz")
STOP = _class(".!?:;\"'")


def _known() -> np.ndarray:
    out = []
    for w in FUNCTION_WORDS:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(C.span_hashes(C.BYTES[b], np.array([0]), np.array([len(b)]))[0])
    return np.unique(np.array(out, np.uint64))


def _vote(x: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a column: the votes (texts x labellers), then (row, bucket, weight) of the scorer's features."""
    known = _known()
    for first, end, buf, offsets in C.slices(texts):
        n = end - first
        sums = lambda t: np.add.reduceat(np.append(t[buf], 0), np.minimum(offsets[:-1], len(buf))) * (np.diff(offsets) > 0)  # noqa: B023, E731
        s, e, row = C.word_spans(C.WHITE[buf], offsets)
        words = np.bincount(row, minlength=n)
        some = np.maximum(words, 1)
        hashes = C.span_hashes(C.BYTES[buf], s, e)
        symbol, upper, lower = sums(SYMBOL), sums(UPPER), sums(LOWER)
        letters = np.maximum(upper + lower, 1)
        # distinct words of each text, and how often each occurs
        order = np.lexsort((hashes, row))
        r, h = row[order], hashes[order]
        new = np.ones(len(h), bool)
        new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        distinct = np.bincount(r[at], minlength=n)
        common = np.bincount(row, weights=np.isin(hashes, known), minlength=n)
        ls, le, lrow = C.word_spans(buf == 10, offsets)
        lines = np.bincount(lrow, minlength=n)
        ends = np.bincount(lrow, weights=STOP[buf[le - 1]] if len(le) else None, minlength=n)
        lh = C.span_hashes(C.BYTES[buf], ls, le)
        lkey = np.unique(np.stack((lrow.astype(np.uint64), lh)), axis=1)[0].astype(np.int64)
        line_kinds = np.bincount(lkey, minlength=n)
        lines1 = np.maximum(lines, 1)
        mean = np.bincount(row, weights=e - s, minlength=n) / some
        variety = distinct / some
        votes = np.stack(
            [
                _vote(words, symbol > 0.3 * some, symbol < 0.05 * some),
                _vote(words, upper > 0.4 * letters, upper < 0.15 * letters),
                _vote(words, words < 10, words > 40),
                _vote(words, (mean < 2.5) | (mean > 12), (mean > 3.5) & (mean < 9)),
                _vote(words, (words >= 30) & (variety < 0.25), (words >= 30) & (variety > 0.4)),
                _vote(words, ends < 0.25 * lines1, ends >= 0.75 * lines1),
                _vote(words, (lines > 3) & (line_kinds < 0.7 * lines), (lines > 3) & (line_kinds == lines)),
                _vote(words, (words >= 10) & (common < 0.04 * words), common > 0.12 * words),
            ],
            axis=1,
        )
        votes[words == 0] = BAD
        # shapes: share of words with symbols, all capitals, digits; length class
        wsym = np.concatenate(([0], np.cumsum(SYMBOL[buf])))
        wup = np.concatenate(([0], np.cumsum(UPPER[buf])))
        shape = np.minimum(e - s, 15) + 16 * np.minimum(wsym[e] - wsym[s], 3) + 64 * np.minimum(wup[e] - wup[s], 3)
        skey = np.unique(row * 256 + shape, return_counts=True)
        # how much of the text repeats itself or is no plain prose, each in ten steps
        again = np.zeros(len(row), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
        most = np.zeros(n)
        np.maximum.at(most, r[at], tf)
        shares = [variety, most / some, np.bincount(row, weights=again, minlength=n) / some, symbol / some, upper / letters, common / some, ends / lines1, line_kinds / lines1]
        steps = np.stack([10 * k + np.minimum(10 * x, 9).astype(np.int64) for k, x in enumerate(shares)], axis=1) + 80 * (words >= 30)[:, None]
        held = np.flatnonzero(words > 0)
        rows = np.concatenate((r[at], skey[0] // 256, np.repeat(held, len(shares))))
        buckets = np.concatenate(((h[at] % np.uint64(BUCKETS - SHAPES)).astype(np.int64), BUCKETS - SHAPES + skey[0] % 256, (BUCKETS - SHAPES + 256 + steps[held]).ravel()))
        unit = lambda w, of: w / np.maximum(np.sqrt(np.bincount(of, weights=w * w, minlength=n)), 1e-9)[of]  # noqa: B023, E731
        weights = np.concatenate((unit(np.log1p(tf), r[at]), unit(np.log1p(skey[1]), skey[0] // 256), np.full(len(held) * len(shares), 0.5)))
        yield votes, rows, buckets, weights.astype(np.float32)


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ 3 ** np.arange(votes.shape[1])


def expectation_maximisation(patterns: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """(P(vote | class) as labellers x classes x 3, share of good, posterior of good by pattern) from pattern counts."""
    keys = sorted(patterns)
    k = np.array([[p // 3**j % 3 for j in range(len(LABELLERS))] for p in keys], np.int64).reshape(-1, len(LABELLERS))
    n = np.array([patterns[p] for p in keys], float)
    good, bad = (k == GOOD).sum(axis=1), (k == BAD).sum(axis=1)
    post = (good + 1.0) / (good + bad + 1.5) if len(keys) else np.zeros(0)
    post = np.where(bad > good, 0.2, np.clip(post, 0.05, 0.95))
    share, table = 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3)
    for _ in range(rounds if len(keys) else 0):
        share = float((n * post).sum() / n.sum())
        for j, v in itertools.product(range(len(LABELLERS)), range(3)):
            hit = k[:, j] == v
            table[j, GOOD, v] = ((n * post)[hit].sum() + 1) / ((n * post).sum() + 3)
            table[j, BAD, v] = ((n * (1 - post))[hit].sum() + 1) / ((n * (1 - post)).sum() + 3)
        logit = np.log(share + 1e-9) - np.log(1 - share + 1e-9) + sum(np.log(table[j, GOOD, k[:, j]] / table[j, BAD, k[:, j]]) for j in range(len(LABELLERS)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        done, post = np.abs(new - post).max() < 1e-6, new
        if done:
            break
    return table, share, dict(zip(keys, post.tolist(), strict=True))


def train(rows: np.ndarray, buckets: np.ndarray, weights: np.ndarray, labels: np.ndarray, rounds: int = 150, rate: float = 4.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full-batch Adagrad: (weights, bias)."""
    w, b = np.zeros(BUCKETS), 0.0
    gw, gb = np.full(BUCKETS, 1e-3), 1e-3
    for _ in range(rounds):
        z = np.bincount(rows, weights=weights * w[buckets], minlength=len(labels)) + b
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        g = np.bincount(buckets, weights=weights * d[rows], minlength=BUCKETS) + decay * w
        gw += g * g
        gb += float(d.sum()) ** 2
        w -= rate * 0.1 * g / np.sqrt(gw)
        b -= rate * 0.1 * float(d.sum()) / gb**0.5
    return w, b


def classify(docs: DataFrame, threshold: float = 0.5, max_training_docs: int = 5_000) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes = [v for v, *_ in features(batch.column("text"))]
            p, n = np.unique(_pattern(np.concatenate(votes)), return_counts=True) if votes else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    counts = docs.mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    _, _, posterior = expectation_maximisation({r.pattern: r.n for r in counts.collect()})  # at most 3**8 rows

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for votes, rows, buckets, weights in features(batch.column("text")):
                p, cut = _pattern(votes), np.argsort(rows, kind="stable")
                at = np.searchsorted(rows[cut], np.arange(len(p) + 1))
                parts = [cut[at[i] : at[i + 1]] for i in range(len(p))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p), pa.array([buckets[x].astype(np.int32) for x in parts], pa.list_(pa.int32())), pa.array([weights[x] for x in parts], pa.list_(pa.float32()))],
                    names=["pattern", "buckets", "weights"],
                )

    # rows equal in id and text count once; of the rest those of the least hash
    keyed = docs.filter("doc_id is not null").withColumn("h", F.xxhash64("text"))
    chosen = keyed.select("doc_id", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_training_docs).distinct()
    sample = keyed.join(chosen, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"]).select("text").mapInArrow(example, "pattern long, buckets array<int>, weights array<float>").toArrow()
    model = (np.zeros(BUCKETS), 0.0)
    if sample.num_rows:
        lists = sample["buckets"].combine_chunks()
        rows = np.repeat(np.arange(sample.num_rows), np.diff(lists.offsets.to_numpy()))
        labels = np.array([posterior[p] for p in sample["pattern"].to_pylist()])
        model = train(rows, lists.flatten().to_numpy(), sample["weights"].combine_chunks().flatten().to_numpy(), labels)
    shared = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1], posterior))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, post = shared.value
        for batch in batches:
            at = 0
            for votes, rows, buckets, weights in features(batch.column("text")):
                n = len(votes)
                words = np.bincount(rows, minlength=n) > 0
                z = np.bincount(rows, weights=weights * w[buckets], minlength=n) + b
                p = np.where(words, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
                q = np.where(words, [post.get(x, 0.0) for x in _pattern(votes).tolist()], 0.0)
                said = ["".join("01-"[v] for v in row) for row in votes.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n), pa.array(said), pa.array(q), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "votes", "posterior", "score", "kept"])
                at += n

    return docs.mapInArrow(score, "doc_id long, votes string, posterior double, score double, kept boolean")
