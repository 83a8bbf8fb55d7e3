"""Training-data pipeline over ``documents``: toxicity, near-duplicates, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. ``run`` writes each stage's rows as Parquet in the cluster's shared folder and reads them
again as the next one's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staffline.llm import mixing, pii, simhash, toxicity, unigram
from staffline.llm.queries import PIECES
from staffline.llm.store import table
from staffline.scratch import scope
from staffline.session import shared_dir
from staffline.sources import files


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: 3-word shingles, at most 2 differing bits."""
    return simhash.keep_one(docs, shingle=3, max_bits=2)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found becomes its kind; n_chars follows the new text."""
    out = pii.mask_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it (0 to 3 times); copies are equal rows."""
    return mixing.apply_mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its id, source and whether decoding them gives the text back."""
    return unigram.encode_texts(docs.select("doc_id", "source", "text"), PIECES, check=True).select(
        "doc_id", "source", "n_tokens", "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("sentencepiece", to_tokens),
]

#: No SQL: the classifier, the CRF and the tokenizer are no SQL functions. tests/llm compares the
#: stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scope(spark):  # what the stage writes for itself goes once its rows are stored
            rows = stage(spark, docs, sf_dir)
            path = shared_dir(spark, "llm", f"pipeline-{name}-{uuid.uuid4().hex}")
            rows.write.parquet(path)
        if kept:  # the former stage's rows have been read
            files.remove(spark, kept)
        docs, kept = spark.read.schema(rows.schema).parquet(path), path
    return docs
