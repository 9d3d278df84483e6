"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import lm, mixing


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    docs = C.documents(spark, sf_dir)
    placed = sharding.shard(docs, C.shared_dir(spark, "shards"))
    return placed.select("doc_id", "source", "shard", "generation", "shard_docs", "shard_bytes")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(C.documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rules.judge(C.documents(spark, sf_dir), labels)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.groups(C.documents(spark, sf_dir), shingle=3, words64=1, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.expr("fp[0]")), 16, "0")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.leaks(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumns({c: F.round(c, 4) for c in ("cosine", "lcs_ratio", "answer_share")})


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classifier

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.classify(C.documents(spark, sf_dir), labels)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(C.documents(spark, sf_dir))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log", 6).alias("mean_log"))


def op7_token_records(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from . import tokens

    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    folder = C.shared_dir(spark, "records")
    shards = tokens.write(C.documents(spark, sf_dir), folder, tokenizer)
    return tokens.read(shards, folder)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    folder = C.shared_dir(spark, "warc")
    files = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = warc.read(spark, folder, files=files)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.deduplicate(C.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_mixing": op2_mixing,
    "op3_quality_rules": op3_quality_rules,
    "op4_decontamination": op4_decontamination,
    "op5_classifier": op5_classifier,
    "op6_lm_scores": op6_lm_scores,
    "op7_token_records": op7_token_records,
    "op8_warc": op8_warc,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash": op10_simhash,
}
ORACLE_SQL: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op6_lm_scores": lm.ORACLE}
