"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm import bpe, fingerprints, lattice_dedup, line_dedup, mixing, quality, secrets, sharding, simhash_dedup, toxicity
from lexispark.llm.common import in_training
from lexispark.sources.shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    store = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24, store=store)


def op3_raked_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    mixed = mixing.mix(docs)
    cell = [F.col(f"cell_{d}").alias(d) for d in mixing.DIMENSIONS]
    rounded = [F.round(c, 6).alias(c) for c in ("p", "weight")]
    return mixed.select("doc_id", *cell, mixing.token_count(F.col("text")).alias("n_tokens"), *rounded, "kept")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, finish=bpe.digests(path), schema=bpe.DIGEST)


def op6_lcp_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op7_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup.near_groups(table(spark, sf_dir, "embeddings"), least=0.93)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_groups(table(spark, sf_dir, "documents"), width=4, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def _predicted(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", F.coalesce(~in_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _predicted(toxicity.with_toxicity(docs, model), 0.7)


def op10_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = quality.train(docs, table(spark, sf_dir, "labels"))
    return _predicted(quality.with_quality(docs, chain), 0.5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fuzzy_line_dedup": op1_fuzzy_line_dedup,
    "op2_sharding": op2_sharding,
    "op3_raked_mixing": op3_raked_mixing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_toxicity_fm": op5_toxicity_fm,
    "op6_lcp_fingerprints": op6_lcp_fingerprints,
    "op7_lattice_near_dedup": op7_lattice_near_dedup,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_secret_scan": op9_secret_scan,
    "op10_line_crf_quality": op10_line_crf_quality,
}


def oracles() -> dict[str, str]:
    return {"op3_raked_mixing": mixing.oracle(), "op7_lattice_near_dedup": lattice_dedup.oracle(), "op9_secret_scan": secrets.oracle()}
