"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import table

#: Target weights of the mixing query, in whole parts; other sources have one part.
MIX_PARTS = {"src0": 4, "src1": 2, "src2": 2}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def url_rules():
    from corvane.llm.url_filter import ALLOW, BLOCK, HostRule

    return [HostRule(BLOCK, "com", "/en/"), HostRule(ALLOW, "example.com", "/en/7"), HostRule(ALLOW, "net", "/de/"), HostRule(BLOCK, "example.net", "/de/8"), HostRule(BLOCK, "org", "/es/")]


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.url_filter import judge

    return judge(table(spark, sf_dir, "pages"), url_rules())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.simhash import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.suffixes import KEEP_NONE, dedup

    return dedup(table(spark, sf_dir, "documents"), window=200, keep=KEEP_NONE).drop("kept")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.phrases import dedup

    return dedup(table(spark, sf_dir, "documents"), window=20).drop("kept")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.pivots import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), MIX_PARTS)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.llm.token_store import read_documents, write_store

    root, keys = write_store(table(spark, sf_dir, "documents"))
    return read_documents(spark, root, keys).select("doc_id", "start", "n_tokens", F.col("ids_crc32").cast("long").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_url_filters, op3_simhash, op4_suffix_array_dedup, op5_nearest_neighbours, op6_quality, op7_substring_dedup, op8_embedding_near_dedup, op9_mixing, op10_token_output)}
