"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontaminate, divergence, language_id, lm_score, packing, pii, seed_extend, simhash, suffix_dedup, topk, url_filter, warc, zone_map
from cairn.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "ts")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.length_buckets(table(spark, sf_dir, "documents"))


def op11_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = seed_extend.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", seed_extend.digest(F.col("kept_text")).alias("kept_sha256"))


def op12_zone_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_map.clustered_layout(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_lm_score, op3_language_id, op4_topk, op5_suffix_dedup, op6_decontaminate, op7_simhash, op8_pii, op9_warc, op10_packing, op11_seed_extend, op12_zone_map, op13_divergence)} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op1_url_filter": url_filter.ORACLE_SQL, "op4_topk": topk.ORACLE_SQL, "op5_suffix_dedup": suffix_dedup.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op10_packing": packing.ORACLE_SQL, "op11_seed_extend": seed_extend.ORACLE_SQL, "op12_zone_map": zone_map.ORACLE_SQL, "op13_divergence": divergence.ORACLE_SQL}
