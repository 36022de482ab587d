"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source of token share p gets weight p**alpha, normalised over the sources. The exponent alpha in [0, 1]
is bisected until the mixture meets its target: an entropy (as a share of the greatest possible), or a
limit on how often the most repeated source is seen for each time the least repeated one is. Each
evaluation probes 15 exponents at once, four levels of bisection, over one row a source.

The budget is in tokens. By default it is the least that shows every document once: the least
repeated source gets one epoch, the others more. With ``budget_tokens`` sources may also fall below
one epoch, which is the budget's own doing.

Each source's documents are dealt by hash to blocks of about ``block_docs``. In each epoch the blocks
are visited in a new order (a hash of seed, epoch and block), the documents of a block in a fixed
order. A fractional last epoch takes documents in that order as long as they fit its tokens. A
document's ``place`` in [0, 1) is the share of its source's quota before it, so that ordering by
place mixes all sources at their weights in every prefix.

Scale. Text is read once, for its words. All running sums are two-level: within a block (about
``block_docs`` rows) and over blocks within groups of about a thousand, then over groups; so a source
with a third of all rows is many small windows. DataFrame functions only.

``shown`` gives the documents themselves, each as often as it is shown.

Defined results: a token is a word between ASCII white space; a null text has none; a null source
is a source of its own; sources without tokens have weight 0 and their documents appear once, in
epoch 1; repeated rows each count; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

PROBES = 15


def token_count(text: str = "text") -> Column:
    words = F.size(F.split(F.btrim(F.col(text), F.lit(" \t\n\x0b\x0c\r")), r"\s+"))
    return F.when(F.col(text).isNull() | (~F.col(text).rlike(r"\S")), 0).otherwise(words).cast("long")


def find_exponent(sources: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, tolerance: float = 1e-7) -> float:
    """The alpha in [0, 1] at which the mixture of ``sources`` (tokens) just meets its target: the least flattening
    that reaches the entropy, or the most that keeps within the repetition limit."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")
    positive = sources.filter("tokens > 0")
    total = positive.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not total.t or total.n < 2:
        return 1.0
    share = F.col("tokens") / F.lit(float(total.t))

    def meets(alphas: list[float]) -> list[bool]:
        probes = positive.select(share.alias("p"), F.posexplode(F.array(*[F.lit(a) for a in alphas])).alias("k", "a"))
        raised = probes.select("k", "p", F.pow("p", "a").alias("x"))
        rows = raised.groupBy("k").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("x")).alias("zl"), F.max(F.col("x") / F.col("p")).alias("most"), F.min(F.col("x") / F.col("p")).alias("least"))
        entropy = (F.log("z") - F.col("zl") / F.col("z")) / F.log(F.lit(float(total.n)))
        good = entropy >= target_entropy if target_entropy is not None else F.col("most") <= F.lit(repetition_limit) * F.col("least")
        return [r.good for r in rows.select("k", good.alias("good")).orderBy("k").collect()]

    # entropy is met below some alpha, of which the largest is sought; the limit above some, of which the smallest
    below = target_entropy is not None
    if meets([1.0 if below else 0.0])[0]:
        return 1.0 if below else 0.0
    lo, hi = 0.0, 1.0
    while hi - lo > tolerance:
        alphas = [lo + (hi - lo) * (k + 1) / (PROBES + 1) for k in range(PROBES)]
        n = sum(g == below for g in meets(alphas))  # the probes on the lower side
        lo, hi = [lo, *alphas][n], [*alphas, hi][n]
    return lo if below else hi


def plan(sources: DataFrame, alpha: float, budget_tokens: float | None = None) -> DataFrame:
    """``sources`` (src, docs, tokens) with weight, epochs and quota (tokens to show)."""
    every = Window.partitionBy()  # one row a source
    raised = sources.withColumn("x", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(alpha))).otherwise(0.0))
    weighed = raised.withColumn("weight", F.when(F.col("tokens") > 0, F.col("x") / F.sum("x").over(every)).otherwise(0.0)).drop("x")
    least = F.max(F.when(F.col("tokens") > 0, F.col("tokens") / F.col("weight"))).over(every)
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else least
    quota = F.greatest(F.round(budget * F.col("weight")), F.lit(0 if budget_tokens is not None else 1) * F.col("tokens"))
    return weighed.withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(0).cast("long")).withColumn("epochs", F.when(F.col("tokens") > 0, F.col("quota") / F.col("tokens")).otherwise(1.0))


def row_key() -> Column:
    """Tells rows apart by id, source and text, in 128 bits."""
    parts = [F.col("doc_id").cast("long"), F.col("source"), F.col("text")]
    missing = [F.col(c).isNull() for c in ("doc_id", "source", "text")]
    return F.struct(F.xxhash64(*parts, *missing).alias("a"), F.xxhash64(F.lit(1), *missing, *parts[::-1]).alias("b"))


def mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: float | None = None, block_docs: int = 1000, seed: int = 17) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, place, weight): one row for each time a row of ``docs`` (doc_id, text, source) is shown."""
    return _mix(docs, target_entropy, repetition_limit, budget_tokens, block_docs, seed).drop("row")


def shown(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``mix`` (same parameters) shows it; rows equal in id, source and text are shown alike."""
    key, epoch = C.fresh(docs.columns, "_row", "_epoch")
    rows = _mix(docs, **how).select(F.col("row").alias(key), F.col("epoch").alias(epoch)).distinct()
    return docs.join(rows, row_key() == F.col(key)).drop(key, epoch)


def _mix(docs: DataFrame, target_entropy: float | None = None, repetition_limit: float | None = None, budget_tokens: float | None = None, block_docs: int = 1000, seed: int = 17) -> DataFrame:
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    counted, _ = C.materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", key.alias("src"), token_count().alias("n_tokens"), row_key().alias("row")), "tokens")
    sources, _ = C.materialise(counted.groupBy("src").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "sources")
    planned = plan(sources, find_exponent(sources, target_entropy, repetition_limit), budget_tokens).withColumn("blocks", F.ceil(F.col("docs") / block_docs))

    placed = counted.join(planned.select("src", "blocks"), "src").withColumn("h", F.xxhash64(F.lit(seed), "row.a")).withColumn("block", F.pmod("h", "blocks"))
    inside = Window.partitionBy("src", "block").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("before_in_block", F.sum("n_tokens").over(inside) - F.col("n_tokens"))

    blocks = counted.join(planned.select("src", "blocks"), "src").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "row.a"), "blocks")).groupBy("src", "block").agg(F.sum("n_tokens").alias("block_tokens"))
    visits = blocks.join(planned, "src").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil("epochs").cast("int")))))
    visits = visits.withColumn("r", F.xxhash64(F.lit(seed + 1), "epoch", "block")).withColumn("group", F.pmod(F.shiftright("r", 20), F.greatest(F.lit(1), F.ceil(F.col("blocks") / 1000))))
    in_group = Window.partitionBy("src", "epoch", "group").orderBy("r", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    visits = visits.withColumn("in_group", F.sum("block_tokens").over(in_group) - F.col("block_tokens"))
    groups = visits.groupBy("src", "epoch", "group").agg(F.sum("block_tokens").alias("t"))
    over_groups = Window.partitionBy("src", "epoch").orderBy("group").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("before_group", F.sum("t").over(over_groups) - F.col("t")).drop("t")
    visits = visits.join(groups, ["src", "epoch", "group"]).select("src", "block", "epoch", "weight", "quota", "tokens", (F.col("before_group") + F.col("in_group")).alias("before_block"))

    shown = placed.join(visits, ["src", "block"])
    before = (F.col("epoch") - 1) * F.col("tokens") + F.col("before_block") + F.col("before_in_block")
    shown = shown.withColumn("before", before).filter((F.col("before") + F.col("n_tokens") <= F.col("quota")) | (F.col("tokens") == 0))
    return shown.select("row", "doc_id", "source", "n_tokens", "epoch", "block", F.when(F.col("quota") > 0, F.col("before") / F.col("quota")).otherwise(0.0).alias("place"), "weight")
