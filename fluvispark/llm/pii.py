"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds.

Base spans (fixed patterns with validators, see ``BASE``) are always redacted. Generators propose
further, overlapping candidates of the same kinds: addresses written with ``[at]``, phone numbers
without a plus or a country code, card numbers with other separators, dotted quads inside longer runs; and of one more kind, ``secret``: long runs of letters and digits such
as keys and tokens. Within a run of
digits and separators every span from one group of digits to another that has a number of digits (parts,
for addresses) its kind allows is a candidate, so that numbers side by side are told apart. Gradient-boosted
trees score every candidate by its format (digits, separators, grouping) and context (neighbouring
characters, a key word before it); a candidate is added when its score reaches its kind's threshold, it
overlaps no base span and passes its kind's validator (cards and ip addresses have one); of overlapping ones the best scored, then the longest, is added.

Training needs no hand labels. Positive are candidates equal to an accepted base span of their kind (overlapping, for e-mail), and, in the place and context of every accepted span,
its rewritten forms (``VARIANTS``), so that the trees learn what base patterns miss. Negative are candidates that
reach beyond an accepted span or (phones) are a part of one, that overlap a base span of another kind, that are refused by the
validator of their kind, or that are of another make (``UNLIKE``: bare runs of digits, dates and years for phones, sentence ends for e-mail) without a key word of
their kind before them. All others are unlabelled and only scored. A secret is positive after an assignment to a telling name
(``password=``) or with a known prefix, else negative. Features are small categories that leave out
what the validators test. Examples are summed by (features, label, fold) over all documents; the trees are
fitted on the ``max_cells`` most frequent of these sums (200,000, the bound of the fit). Thresholds are calibrated on the scores of all examples, each
scored by trees that have not seen its fold (of four): a kind's lies below the least score from which its precision, with a few
examples lent at the precision of all kinds (``fit``), reaches ``precision``, half-way to the next score seen, and is 0.5 at least. So a kind
with few examples leans on the others; if even so no score passes, nothing of it is added.

Everything on the way of the rows is DataFrame functions; the trees become one expression. Patterns are
possessive or anchored at the beginnings of runs, so that long runs neither overflow the matcher's
stack nor take quadratic time. Positions are code points. Defined results: a null text is empty and has no spans;
repeated rows each get a row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kind, pattern. The lookbehinds and possessive forms match what the plain patterns match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": [r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\)|\{at\})\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\})\x20?[A-Za-z0-9-]++)++"],
    "ip": [r"(?:\G|(?<![0-9.]))[0-9]++(?:\.[0-9]++)++"],
    "card": [r"[0-9]++(?:[\x20._/-]?[0-9]++)*+"],
    "phone": [r"[+(]?[0-9](?:[\x20().-]{0,2}[0-9])++"],
    "secret": [r"(?:\G|(?<![A-Za-z0-9_+/-]))(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+"],
}
#: Least and most digits of a candidate, and groups of digits it may span; other kinds are taken as matched.
WITHIN = {"ip": (4, 12, 4, 4), "card": (13, 19, 1, 19), "phone": (7, 15, 1, 15)}
# fixed values: words that announce each kind
CONTEXT = {
    "email": "mail|e-mail|correo|courriel|contact",
    "ip": "ip|host|server|address|addr",
    "card": "card|visa|mastercard|amex|karte|carte|tarjeta",
    "phone": "tel|phone|call|fax|mobile|telefon|teléfono|téléphone",
}
# fixed values: names that secrets are assigned to, and prefixes that keys of common services begin with
ASSIGNED = r"(?:passw(?:or)?d|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?\x20?[:=]\x20?[\"']?$"
PREFIXES = "^(?:AKIA|ASIA|ghp_|gho_|ghs_|ghu_|github_pat_|glpat-|xox[abps]-|sk-|sk_live_|sk_test_|rk_live_|AIza|hf_|npm_|pypi-)"
#: Makes of candidates that are no e-mail address or phone number.
UNLIKE = {
    "email": r"\x20\.|\.\x20|[0-9]$",
    "phone": r"^[0-9]+$|^[0-9]{4}[.-][0-9]{1,2}[.-][0-9]{1,2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{2,4}$|^(?:1[0-9]|20)[0-9]{2}\x20?-\x20?(?:1[0-9]|20)[0-9]{2}$",
}
#: Other ways to write an accepted span, as functions of its text.
VARIANTS = {
    "email": [
        lambda m: F.regexp_replace(m, "@", " [at] "),
        lambda m: F.regexp_replace(m, "@", "(at)"),
        lambda m: F.regexp_replace(F.regexp_replace(m, "@", " [at] "), r"\.([A-Za-z0-9-]+)$", " [dot] $1"),
    ],
    "ip": [lambda m: m],
    "card": [lambda m, c=c: F.regexp_replace(_digits(m), "([0-9]{4})(?=[0-9])", f"$1{c}") for c in "./_"],
    "phone": [
        lambda m: F.regexp_replace(m, r"^\+", ""),
        lambda m: F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]", ""),
        lambda m: F.regexp_replace(F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]", ""), r"\)?[\x20.-]|[()]", "-"),
        lambda m: F.regexp_replace(F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]", ""), r"\)?[\x20.-]|[()]", "."),
    ],
}
FEATURES = ("digits", "separators", "groups", "longest", "bracket", "context", "before", "after")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda s, i: s
        + F.when(i % 2 == 1, F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int")).otherwise(
            F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") * 2 - F.when(F.substr(digits, F.length(digits) + 1 - i, F.lit(1)).cast("int") > 4, 9).otherwise(0)
        ),
    )
    return total % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.when(F.length(F.ltrim(x, F.lit("0"))) <= 3, F.ltrim(x, F.lit("0"))).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>> of the leftmost non-overlapping matches, in code points.

    Starts come from the lengths of the pieces between matches, summed in steps of 256 matches.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # an expression used within a lambda runs for every element, so values are bound first
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    steps = let(found, lambda ms: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(ms)), ms, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))))
    pieces = lambda n: F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 256).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = let(steps, lambda st: F.transform(pieces(F.size(st)), lambda k: F.slice(st, k * 256 + 1, 256)))
    span = "array<struct<start:int,end:int,m:string>>"
    grow = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("m")))).alias("out"),
    )
    local = F.transform(parts, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out")), grow))
    return F.flatten(F.aggregate(
        local,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["at"]).alias("at"),
            F.concat(acc["out"], F.array(F.transform(p["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["m"].alias("m"))))).alias("out"),
        ),
        lambda acc: acc["out"],
    ))


EMPTY = "array<struct<start:int,end:int,m:string>>"


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base_<kind>`` (accepted) and ``refused_<kind>``: arrays of spans."""
    may = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+"), "ip": F.col("has_digit"), "card": F.col("has_digit")}
    out = docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("has_digit", F.col("text").rlike("[0-9]"))
    out = out.withColumns({f"all_{k}": F.when(may[k], matches(F.col("text"), BASE[k])).otherwise(F.array().cast(EMPTY)) for k in BASE})
    judged = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"), valid(k, s["m"]).alias("ok"))
    out = out.withColumns({f"all_{k}": F.transform(f"all_{k}", judged(k)) for k in BASE})
    for k in BASE:
        out = out.withColumn(f"base_{k}", F.filter(f"all_{k}", lambda s: s["ok"])).withColumn(f"refused_{k}", F.filter(f"all_{k}", lambda s: ~s["ok"]))
    return out.drop(*[f"all_{k}" for k in BASE])


def _overlaps(spans: Column, c: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))


def _sub_spans(kind: str, found: Column) -> Column:
    """Of each matched run, the spans between its groups of digits that ``WITHIN`` allows; an opening + or ( belongs to its group."""
    if kind not in WITHIN:
        return found
    least, most, fewest, longest = WITHIN[kind]
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def spans(c: Column) -> Column:
        def start(g: Column) -> Column:
            return g["start"] - F.when(g["start"] > 0, F.substr(c["m"], g["start"], F.lit(1)).isin("+", "(").cast("int")).otherwise(0)

        def span(first: Column, last: Column) -> Column:
            return F.struct((c["start"] + first).alias("start"), (c["start"] + last["end"]).alias("end"), F.substr(c["m"], first + 1, last["end"] - first).alias("m"))

        def starting(groups: Column):
            return lambda g, i: let(start(g), lambda first: F.transform(F.slice(groups, i + fewest, longest - fewest + 1), lambda last: span(first, last)))

        every = lambda groups: F.flatten(F.transform(groups, starting(groups)))
        return F.filter(let(matches(c["m"], "[0-9]++"), every), lambda x: F.length(_digits(x["m"])).between(least, most))

    return F.flatten(F.transform(F.filter(found, lambda c: F.length(c["m"]) >= least), spans))


def _features(kind: str, text: Column, c: Column) -> dict[str, Column]:
    """Small categories of a candidate (start, end, m)."""
    m = c["m"]
    core = F.regexp_replace(m, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", "")
    groups = F.split(core, "[^0-9A-Za-z]+")
    lead = F.lower(F.substr(text, F.greatest(F.lit(1), c["start"] - 23), F.least(c["start"], F.lit(24))))
    char = lambda at: F.when(at >= 1, F.substr(text, at, F.lit(1))).otherwise("")

    shape = lambda x: F.when(x == "", 0).when(x.rlike(r"[\p{L}]"), 1).when(x.rlike("[0-9]"), 2).when(x.rlike(r"\s"), 3).otherwise(4)
    before, after = shape(char(c["start"])), shape(char(c["end"] + 1))
    # a number goes on before a space
    before = F.when((before == 3) & char(c["start"] - 1).rlike("[0-9]"), 5).otherwise(before)
    key = lead.rlike(ASSIGNED) if kind == "secret" else lead.rlike(rf"(?:{CONTEXT[kind]})[^\p{{L}}]*$")
    return {
        "digits": F.least(F.length(_digits(m)), F.lit(20)),
        "separators": F.least(F.length(F.regexp_replace(core, "[0-9A-Za-z]", "")), F.lit(6)),
        "groups": F.least(F.size(groups), F.lit(6)),
        "longest": F.least(F.array_max(F.transform(groups, F.length)), F.lit(12)),
        "bracket": m.rlike(PREFIXES if kind == "secret" else r"[()\[\]{}]").cast("int"),
        "context": key.cast("int"),
        "before": before,
        "after": after,
    }


def candidates(docs: DataFrame) -> DataFrame:
    """Adds ``candidates``: array<struct<kind (number), start, end, free, label, features...>>, label 1, 0 or null; and ``planted``: the same of the rewritten base spans, label 1."""
    out = docs
    names = []
    for n, kind in enumerate(KINDS):
        may = (F.col("text").contains("@") | F.lower("text").contains("at]") | F.lower("text").contains("at)") | F.lower("text").contains("at}")) if kind == "email" else F.col("has_digit")
        for j, pattern in enumerate(GENERATORS[kind]):
            name = f"gen_{kind}_{j}"
            names.append((n, kind, name))
            out = out.withColumn(name, F.when(may, matches(F.col("text"), pattern)).otherwise(F.array().cast(EMPTY)))

    def bare(kinds) -> Column:
        return F.concat(*[F.transform(f"base_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in kinds])

    def struct(n: int, kind: str, c: Column, free: Column, label: Column, **instead: Column) -> Column:
        features = _features(kind, F.col("text"), c) | instead
        return F.struct(F.lit(n).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), free.alias("free"), label.cast("int").alias("label"), *[x.cast("int").alias(f) for f, x in features.items()])

    def build(n: int, kind: str):
        others, every = bare([k for k in BASE if k != kind]), bare(BASE)

        def candidate(c: Column) -> Column:
            features = _features(kind, F.col("text"), c)
            passes = valid(kind, c["m"]) if kind in ("ip", "card") else F.lit(True)
            if kind == "secret":
                label = F.when(_overlaps(every, c), 0).otherwise(((features["context"] == 1) | (features["bracket"] == 1)).cast("int"))
            else:
                own = F.col(f"base_{kind}")
                if kind == "email":
                    label = F.when(_overlaps(own, c), 1)
                else:
                    label = F.when(F.exists(own, lambda s: (s["start"] == c["start"]) & (s["end"] == c["end"])), 1)
                    label = label.when(F.exists(own, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]) & ((c["start"] < s["start"]) | (s["end"] < c["end"]))), 0)
                    label = label.when(_overlaps(own, c), F.lit(0 if kind == "phone" else None))
                unlike = ~passes if kind in ("ip", "card") else c["m"].rlike(UNLIKE[kind])
                if kind == "phone":
                    unlike = unlike | features["before"].isin(1, 2) | features["after"].isin(1, 2)
                label = label.when(_overlaps(others, c), 0).when(unlike & (features["context"] == 0), 0)
            return struct(n, kind, c, passes & ~_overlaps(every, c), label)

        return candidate

    def rewritten(n: int, kind: str) -> Column:
        forms = F.flatten(F.transform(f"base_{kind}", lambda s: F.array(*[F.struct(s["start"].alias("start"), s["end"].alias("end"), v(s["m"]).alias("m")) for v in VARIANTS[kind]])))
        # a quad inside a longer run has a point before it
        instead = {"before": F.lit(4)} if kind == "ip" else {}
        return F.transform(forms, lambda c: struct(n, kind, c, F.lit(False), F.lit(1), **instead))

    out = out.withColumns({name: _sub_spans(kind, F.col(name)) for _, kind, name in names})
    parts = [F.transform(name, build(n, kind)) for n, kind, name in names]
    planted = [rewritten(n, kind) for n, kind in enumerate(KINDS) if kind in VARIANTS]
    return out.withColumn("candidates", F.concat(*parts)).withColumn("planted", F.concat(*planted)).drop(*[x for *_, x in names])


# --- the trees ------------------------------------------------------------------------------


@dataclass
class Model:
    """Boosted trees (nested (feature, cut, below, above) or leaf values), and a threshold for each kind."""

    start: float
    trees: list
    thresholds: dict[int, float]

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of (kind, features...), before the logistic function."""
        total = np.full(len(x), self.start)
        for t in self.trees:
            total += _leaves(t, x)
        return total

    def expression(self, field) -> Column:
        def leaf(t) -> Column:
            return F.when(field(t[0]) <= t[1], leaf(t[2])).otherwise(leaf(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(float(self.start))
        for t in self.trees:
            total = total + leaf(t)
        return 1 / (1 + F.exp(-total))


COLUMNS = ("kind", *FEATURES)


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    below = x[:, COLUMNS.index(tree[0])] <= tree[1]
    out = np.zeros(len(x))
    out[below], out[~below] = _leaves(tree[2], x[below]), _leaves(tree[3], x[~below])
    return out


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float, shrink: float):
    """A regression tree on (features, gradient, hessian) sums, split by exact search over the categories' values."""
    g, h = float(gradient.sum()), float(hessian.sum())
    leaf = shrink * g / (h + 1.0)
    if not depth or h < 2 * least:
        return leaf
    best = (1e-6, None, None)
    for f in range(len(COLUMNS)):
        values, code = np.unique(x[:, f], return_inverse=True)
        gl, hl = (np.cumsum(np.bincount(code, weights=w))[:-1] for w in (gradient, hessian))
        gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
        gain[np.minimum(hl, h - hl) < least] = -1
        if len(gain) and gain.max() > best[0]:
            best = (float(gain.max()), f, int(values[gain.argmax()]))
    if best[1] is None:
        return leaf
    below = x[:, best[1]] <= best[2]
    return (COLUMNS[best[1]], best[2], *(_grow(x[m], gradient[m], hessian[m], depth - 1, least, shrink) for m in (below, ~below)))


def _boosted(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, rounds: int, depth: int, shrink: float) -> Model:
    model = Model(math.log((positive.sum() + 1) / (negative.sum() + 1)), [], {})
    z = np.full(len(x), model.start)
    for _ in range(rounds if positive.any() and negative.any() else 0):
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        model.trees.append(_grow(x, positive - (positive + negative) * q, np.maximum((positive + negative) * q * (1 - q), 1e-9), depth, 1.0, shrink))
        z = z + _leaves(model.trees[-1], x)
    return model


def fit(table: list[dict], rounds: int = 40, depth: int = 4, shrink: float = 0.3, precision: float = 0.95, lent: float = 10.0) -> Model:
    """Boosting on rows {kind, features..., fold, positive, negative} (counts), then a threshold for each kind from scores that every fold gets of trees fitted on the others.

    A kind's precision from a score upwards is that of its own examples and ``lent`` more at the precision of all kinds from there: kinds with many examples stand for themselves, rare ones lean on the rest.
    """
    x = np.array([[r[c] for c in COLUMNS] for r in table], np.int64).reshape(-1, len(COLUMNS))
    positive, negative = (np.array([r[c] for r in table], float) for c in ("positive", "negative"))
    fold = np.array([r["fold"] for r in table], int)
    scores = np.zeros(len(x))
    for f in np.unique(fold):
        own = fold == f
        scores[own] = 1 / (1 + np.exp(-np.clip(_boosted(x[~own], positive[~own], negative[~own], rounds, depth, shrink).raw(x[own]), -30, 30)))
    model = _boosted(x, positive, negative, rounds, depth, shrink)
    level, code = np.unique(-scores, return_inverse=True)
    upto = lambda w, mine: np.cumsum(np.bincount(code[mine], weights=w[mine], minlength=len(level)))
    everything = np.ones(len(x), bool)
    whole = upto(positive, everything) / np.maximum(upto(positive, everything) + upto(negative, everything), 1)
    for k in range(len(KINDS)):
        mine = x[:, 0] == k
        good, bad = upto(positive, mine), upto(negative, mine)
        passing = np.flatnonzero((good + lent * whole) / (good + bad + lent) >= precision)
        model.thresholds[k] = 2.0
        if len(passing):
            # half-way, in log odds, to the next lower score seen
            odds = [math.log(s / (1 - s)) if 1e-9 < s < 1 - 1e-9 else 20.0 * (1 if s > 0.5 else -1) for s in (-level[passing[-1] : passing[-1] + 2]).tolist()]
            model.thresholds[k] = max(0.5, 1 / (1 + math.exp(-(odds[0] + odds[1]) / 2))) if len(odds) > 1 else 0.5
    return model


def examples(found: DataFrame) -> DataFrame:
    """Counts of labelled candidates by kind, features and fold."""
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4).cast("int").alias("fold")
    every = F.filter(F.concat("candidates", "planted"), lambda c: c["label"].isNotNull())
    rows = found.filter("size(candidates) > 0 or size(planted) > 0").select(fold, F.explode(every).alias("c")).select("fold", "c.*")
    return rows.groupBy("fold", "kind", *FEATURES).agg(F.sum("label").alias("positive"), F.sum(1 - F.col("label")).alias("negative"))


def find(docs: DataFrame, precision: float = 0.95, max_cells: int = 200_000, keep_text: bool = False) -> DataFrame:
    """``doc_id``, ``base`` and ``added``: arrays of struct<kind (number), start, end>, in order, per row of ``docs`` (doc_id, text).

    Texts are read once: spans and candidates are written, and the trees are fitted on and applied to those.
    """
    found = candidates(base_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))
    bare = lambda n: lambda s: F.struct(F.lit(n).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(f"base_{k}", bare(n)) for n, k in enumerate(BASE)]))
    found, _ = C.materialise(found.select("doc_id", *(["text"] if keep_text else []), base.alias("base"), "candidates", "planted"), "spans")
    cells = examples(found).orderBy(F.desc(F.col("positive") + F.col("negative")), "fold", "kind", *FEATURES).limit(max_cells)
    model = fit([r.asDict() for r in cells.collect()], precision=precision)
    threshold = lambda c: F.get(F.array(*[F.lit(float(model.thresholds[n])) for n in range(len(KINDS))]), c["kind"])
    free = F.filter("candidates", lambda c: c["free"])
    scored = F.transform(free, lambda c: F.struct((-model.expression(lambda f: c[f])).alias("last"), (c["start"] - c["end"]).alias("short"), threshold(c).alias("least"), c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    chosen = F.array_sort(F.filter(scored, lambda c: -c["last"] >= c["least"]))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    added = F.array_sort(F.aggregate(chosen, none, lambda acc, c: F.when(_overlaps(acc, c), acc).otherwise(F.concat(acc, F.array(span(c))))))
    return found.withColumn("added", added).drop("candidates", "planted")


def redact(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """(doc_id, text) with every found span replaced by ``<KIND>``; of overlapping spans the first covers the rest."""
    found = find(docs, precision, keep_text=True).withColumn("spans", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind")))))
    name = lambda k: F.get(F.array(*[F.lit(f"<{x.upper()}>") for x in KINDS]), k)
    out = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], -s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct((-s["end"]).alias("at"), F.concat(acc["out"], F.substr("text", acc["at"] + 1, s["start"] - acc["at"]), name(s["kind"])).alias("out"))
        ),
        lambda acc: F.concat(acc["out"], F.substr("text", acc["at"] + 1, F.length("text"))),
    )
    return found.select("doc_id", out.alias("text"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
