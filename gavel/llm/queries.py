"""The operators' named queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gavel.llm.centroid_clustering import cluster_report
from gavel.llm.common import read_documents
from gavel.llm.decontaminate import decontaminate
from gavel.llm.exact_dedup import exact_copies
from gavel.llm.importance import resample
from gavel.llm.jaccard_join import near_duplicates
from gavel.llm.line_dedup import line_report
from gavel.llm.packing import pack
from gavel.llm.quality_rules import quality_rules
from gavel.llm.shards import shard_documents
from gavel.llm.suffix_dedup import remove_repeats
from gavel.llm.token_store import store_round_trip
from gavel.llm.toxicity import toxicity
from gavel.llm.vector_codes import code_report
from gavel.llm.word_tokens import default_vocabulary


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(read_documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_documents(spark, sf_dir), default_vocabulary())


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_round_trip(read_documents(spark, sf_dir), default_vocabulary())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_ranges")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_documents(spark, sf_dir))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_documents(spark, sf_dir)).drop("text_key", "root")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_documents(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies(read_documents(spark, sf_dir))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_token_store": op6_token_store,
    "op7_decontamination": op7_decontamination,
    "op8_sharding": op8_sharding,
    "op9_ngram_jaccard": op9_ngram_jaccard,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_vector_codes": op13_vector_codes,
}
