"""From raw documents to mixed, sharded training text, one operator a stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it back for the next one.
All but the last return the columns of ``documents``.

Edge cases: null and empty texts fail the base rules and go at the first stage,
so later stages see them only when run on their own; null and repeated ids and
repeated rows are judged row by row; extra columns are carried whatever their
names; an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import common, decontam, mixing, rules, sharding, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the likelihood ratio."""
    return rules.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with a similarity of 0.8 or more on five-word shingles."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # Whether a row leaks depends on its text alone, so the text's hash names it: ids may be null or repeated.
    found = decontam.leaks(docs.select(F.xxhash64("text").alias("h"), "text"), bench, key="h")
    leaking = common.stage(found.select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(leaking, F.xxhash64("text") == F.col("__leak"), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.materialize(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the shard that holds them."""
    return sharding.shard(docs, common.shared_dir(spark, "corpus"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: Hashed ratios, fingerprints and a truncated SVD have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.n_staged()
    for name, stage in STAGES:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        common.discard(spark, begun)  # the steps inside the stage and the stage before are not read again
    return docs
