"""The registered queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafworks.llm import ann, hmm, mixing, packing, quality, simhash, substring, tokencount, topk, urls
from leafworks.llm._base import table
from leafworks.llm.oracle import ORACLE_SQL as ORACLE_SQL


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.lm_scores(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), size=1024, end=2)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.quantised_top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), byte_fallback=True)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents"), window=20, texts=False)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, budget=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template", "score")


QUERIES = {
    "op1_hmm": op1_hmm,
    "op2_mix": op2_mix,
    "op3_pack": op3_pack,
    "op4_ann": op4_ann,
    "op5_topk": op5_topk,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_simhash": op9_simhash,
    "op10_url_filter": op10_url_filter,
}
