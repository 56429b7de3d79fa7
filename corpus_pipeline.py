"""Cleaning of a training corpus: from documents to packed sequences of tokens, in five stages.

Every stage takes ``(spark, docs, sf_dir)`` with all that its predecessor kept and returns a DataFrame; it is
written as Parquet and reread before the next one. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightwatch.llm import decontamination, jaccard, language, packing, pii
from flightwatch.llm.tables import settled, shared_root, table


#: Numbers (8 bytes each) up to which they are broadcast; beyond, texts move to them.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language is recognised go: null or empty ones and those without a letter. Mixed texts and
    texts in another language than their ``lang`` says stay. Without a labelled row nothing can be recognised, and
    every row stays."""
    net = language.train_on(docs)
    return language.recognised(docs, net) if net.languages else docs


def _few(ids: DataFrame) -> DataFrame:
    """Numbers, written first and broadcast if they are few: then the texts need not move to meet them."""
    ids = settled(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; of rows with the same id one stays.
    Rows without an id are in no group and stay."""
    found = jaccard.near_duplicates(docs.select("doc_id", "text"))
    losers = _few(found.filter("component_id <> doc_id").select(F.col("doc_id").alias("_loser")).distinct())
    kept = docs.join(losers, F.col("doc_id") == F.col("_loser"), "left_anti")
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if not repeated.take(1):
        return kept
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least one word in twenty lies in a passage of the test sets go. The verdict depends on
    the text alone, so texts are looked up by their hash, and rows without an id are judged as well."""
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontamination.contamination(texts, table(spark, sf_dir, "benchmark"))
    dirty = _few(found.filter("contaminated").select(F.col("doc_id").alias("_dirty")).distinct())
    return docs.join(dirty, F.xxhash64("text") == F.col("_dirty"), "left_anti")


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in its text is replaced by its kind, and ``n_chars`` follows the text."""
    return pii.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", decontaminate),
          ("pii", redact_pii), ("packing", pack_sequences)]

#: The first stage is a trained network: SQL has no form of it. tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
