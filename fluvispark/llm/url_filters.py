"""URL filters by a sort-merge range join over reversed-host canonical keys.

A rule names a host and the beginning of a path; it fits that host and all its subdomains. A
key is the host's labels in reverse order, each followed by ``.``, then the path. A url has one
key for each of its host's suffixes (``www.example.org`` gives those of ``org``, ``example.org``
and itself), so that "the rule fits" becomes "the rule's key is a prefix of one of the url's
keys", and a rule becomes an interval of the sorted order of keys.

The sweep runs over the sorted union of rule keys and url keys. Intervals of prefixes are nested
or disjoint, so the stack of active rules after a rule's key is that rule and those of its own
prefixes that are rules (``chain``, at most as long as the key); the rule in force at a url's key is
the longest member of the last stack that is a prefix of the key. Keys are range-partitioned; the
sweep within a partition is a window, and the stack open at its start is carried over from the
last rule before it, one row a partition. Neither table is broadcast and urls are made distinct
before anything is shuffled, so a hot host or page costs one row; in the last join, back to the pages, a hot url
is split by adaptive execution, since the other side has one row a url. DataFrame functions only.

Defined results: host and path are empty for a null url or one without ``://``; the longest rule
wins (host and path together; at equal length the longer host, then block before allow); a url
without a fitting rule gets ``default``. Repeated rules count once, repeated pages each get a row;
rules with null parts are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _common as C

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str = "url") -> Column:
    after = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.col(url).contains("://"), F.translate(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)).otherwise("")


def path_of(url: str = "url") -> Column:
    after = F.expr(f"substring({url}, locate('://', {url}) + 3)")
    return F.when(F.col(url).contains("://"), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def reversed_host(host: str) -> Column:
    """Labels in reverse, each closed by a dot: ``www.a.org`` becomes ``org.a.www.``."""
    return F.when(F.col(host) == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(F.col(host), r"\.")), "."), F.lit(".")))


def _suffix_keys() -> Column:
    """The keys of all suffixes of the host in labels, from its last label to all of it."""
    labels = F.reverse(F.split(F.col("host"), r"\."))
    ends = F.sequence(F.lit(1), F.size(labels))
    return F.when(F.col("host") != "", F.transform(ends, lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit("."), F.col("path")))).otherwise(F.array().cast("array<string>"))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """(key, chain): each rule's key and the stack of rules active from it on, itself included."""
    clean = rules.filter("host is not null and path is not null and verdict is not null and host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
    keyed = clean.select(
        F.concat(reversed_host("host"), F.col("path")).alias("key"),
        F.struct(F.length(F.concat("host", "path")).alias("length"), F.length("host").alias("host_length"), F.col("verdict"), F.concat("host", "path").alias("rule"), F.concat(reversed_host("host"), F.col("path")).alias("key")).alias("r"),
    )
    keyed = keyed.groupBy("key").agg(F.max("r").alias("r"))
    # a prefix of a rule's key is found by equality: a key has as many prefixes as characters
    prefixes = keyed.select("key", F.explode(F.expr("transform(sequence(1, length(key)), n -> substring(key, 1, n))")).alias("prefix"))
    held = prefixes.join(keyed.select(F.col("key").alias("prefix"), "r"), "prefix")
    return held.groupBy("key").agg(F.collect_set("r").alias("chain"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", partitions: int | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url); rules are (host, path, verdict)."""
    parsed = pages.select("page_id", host_of().alias("host"), path_of().alias("path"))
    keys = parsed.select("host", "path").filter("host <> ''").distinct().select("host", "path", F.explode(_suffix_keys()).alias("key"))
    chains = prepare_rules(rules)
    empty = F.array().cast(chains.schema["chain"].dataType)
    events = keys.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast(chains.schema["chain"].dataType).alias("chain")).union(
        chains.select("key", F.lit(0), F.lit(""), F.lit(""), "chain")
    )
    n = partitions or C.pieces(pages)
    # the partition's number must not change between the sweep and what is carried, so it is written
    ordered, _ = C.materialise(events.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "url-keys")
    last = ordered.filter("kind = 0").groupBy("part").agg(F.max_by("chain", "key").alias("chain"))
    parts = ordered.select("part").distinct().join(last, "part", "left")  # one row a partition
    carried = parts.select("part", F.last("chain", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = ordered.withColumn("stack", F.last("chain", ignorenulls=True).over(sweep)).filter("kind = 1")
    swept = swept.join(carried, "part").withColumn("stack", F.coalesce("stack", "carried", empty))
    best = swept.select("host", "path", F.array_max(F.filter("stack", lambda r: F.col("key").startswith(r["key"]))).alias("r")).groupBy("host", "path").agg(F.max("r").alias("r"))
    best = best.filter("r is not null").select("host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))
    # pages without a host match nothing and are dealt out by their number
    nowhere = F.when(F.col("host") == "", F.pmod(F.xxhash64("page_id"), F.lit(1 << 20)))
    parsed = parsed.withColumn("spread", F.coalesce(nowhere, F.lit(0)))
    return parsed.join(best.withColumn("spread", F.lit(0).cast("long")), ["host", "path", "spread"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
