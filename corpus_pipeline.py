"""A corpus pipeline over ``documents``: each stage is one operator of ``fluvispark.llm``.

Every stage takes all rows that its predecessor kept, with any extra columns, and tolerates nulls in
all of them. Language ID drops texts without a recognised language; near-dedup keeps the document
of the least id of each group; decontamination drops documents that hold a benchmark item; mixing
shows every document at least once and those of rarer sources more often, as repeated rows; the
last stage writes token ids and returns what reading the files back gives.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvispark.deploy import ship
from fluvispark.llm import _common as C
from fluvispark.llm import decontamination, language_id, mixing, near_dedup, queries, token_planes


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language; the model is fitted on the labelled documents that are not held out."""
    return language_id.accept(docs, language_id.fit(docs.filter(~language_id.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word near-duplicates. Rows of one id are one document: those of an id that is kept all stay, but for repetitions of the same text; rows without id all stay."""
    own_id, rows, whole = C.fresh(docs.columns, "_kept", "_rows", "_row")
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text")).filter("kept").groupBy(F.col("doc_id").alias(own_id)).agg(F.count("*").alias(rows))
    same = F.col("doc_id").eqNullSafe(F.col(own_id))
    once = docs.join(kept.filter((F.col(rows) == 1) | F.col(own_id).isNull()), same, "left_semi")
    repeated = docs.join(kept.filter((F.col(rows) > 1) & F.col(own_id).isNotNull()), same, "left_semi")
    row = F.struct(*docs.columns)
    first = repeated.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias(whole)).select(f"{whole}.*")
    return once.unionByName(first)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, C.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document once for every epoch of its source; at most twice as often for one source as for another."""
    return mixing.shown(docs, repetition_limit=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = f"{C.shared_dir(spark)}/token-planes-{uuid.uuid4().hex}"
    token_planes.write(docs, path, queries.tokenizer_path())
    return token_planes.read(spark, path)


#: Bytes of a batch that goes to a Python worker, where the session has Spark's default of 64 MB: executors live through all stages, and keep what their largest batches took.
BATCH_BYTES = "8388608b"


def _in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(key) in ("67108864", "67108864b", "64m", "64MB"):
            spark.conf.set(key, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    (name, _in_small_batches(stage))
    for name, stage in (
        ("language_id", language),
        ("near_dedup", near_duplicates),
        ("decontamination", decontaminate),
        ("mixing", mix_sources),
        ("token_ids", token_ids),
    )
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = C.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = C.materialise(docs, f"stage-{name}")
    return docs
