"""Registered queries of this subpackage, with production parameters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import align, licenses, mixing, pii, pq, routed, secrets, sharding, simhash, toxicity, turns, unigram, urltree
from staffline.llm.oracle import ORACLE as ORACLE
from staffline.llm.store import table


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op5_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op9_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=24)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("spans")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                   table(spark, sf_dir, "labels"))


#: A SentencePiece model every worker can read.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_and_check(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: A byte-level tokenizer every worker can read.
BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_tokenizers(table(spark, sf_dir, "documents").select("doc_id", "text"), BYTE_LEVEL, PIECES)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_damaged(table(spark, sf_dir, "conversations"))


def op13_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source stands for an owner, its documents of one language for a repository."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return secrets.scan_secrets(docs, F.col("source"), F.struct("source", "lang"))


def op3_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op7_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 20 == 0)


QUERIES = {
    "op12_conversation_repair": op12_conversation_repair,
    "op13_secret_ownership": op13_secret_ownership,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op3_pq_near_dedup": op3_pq_near_dedup,
    "op7_learned_partitions": op7_learned_partitions,
    "op4_sentencepiece": op4_sentencepiece,
    "op6_pii": op6_pii,
    "op10_toxicity": op10_toxicity,
    "op1_license_scan": op1_license_scan,
    "op2_url_filter": op2_url_filter,
    "op5_entropy_balancing": op5_entropy_balancing,
    "op9_histogram_sort": op9_histogram_sort,
    "op8_simhash": op8_simhash,
}
