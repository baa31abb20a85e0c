"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, prefixes, suffix_dedup, yinyang
from .common import table
from .golay_simhash import simhash_groups
from .histogram_sort import histogram_shards
from .lattice_dedup import lattice_dedup
from .onebit_search import onebit_search
from .packing import pack_documents
from .pieces import piece_digests
from .quality import quality_scores
from .suffix_dedup import repeated_spans
from .tokens import token_counts
from .toxicity import toxicity_scores


def op1_lattice_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_dedup(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op2_onebit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit_search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0, k=20)


def op3_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return histogram_shards(docs.withColumn("text_crc32", crc), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op6_sparse_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"), length=50)
    return spans.select("doc_id", "start", "stop", "first_doc_id", "removed")


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex(F.col("prints")[0])), 16, "0").alias("fingerprint"),
        "component_id",
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), limit=1024)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), size=2048, end_id=0)


def op10_mix_by_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return mixing.mixing_probabilities(docs).select(
        "doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"),
        F.round("__probability", 6).alias("probability"), F.col("__sampled").alias("sampled"),
    )


def op11_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed=3)


def op12_sentencepiece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


ALL = (
    op1_lattice_dedup, op2_onebit_search, op3_histogram_sort, op4_quality_ftrl, op5_toxicity_nnpu, op6_sparse_suffix_dedup, op7_golay_simhash,
    op8_token_counts, op9_best_fit_packing, op10_mix_by_raking, op11_yinyang_clusters, op12_sentencepiece_rounds, op13_prefix_trie,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_sparse_suffix_dedup": suffix_dedup.oracle_sql(50), "op10_mix_by_raking": mixing.oracle_sql(), "op11_yinyang_clusters": yinyang.oracle_sql(), "op13_prefix_trie": prefixes.oracle_sql(),
    }
