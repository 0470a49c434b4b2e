"""From raw documents to packed sequences; each stage calls one operator of folio.llm.

Every stage but the last gives the columns of documents; each is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import exact, jaccard, packing, quality, queries, secret_scan, toxicity
from folio.tables import pinned


def ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5: documents that the models hold toxic go. Learns from the labelled documents among `docs`, those held out in op 5 left out; null texts are scored as empty."""
    labels = queries.table(spark, sf_dir, "labels")
    score = "_toxicity"
    return quality.with_score(docs, toxicity.train(docs, labels, learn=queries.fold(5) != 0), score).filter(F.col(score) < 0.5).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6: of texts equal but for white space the longest stays, then the smallest doc_id."""
    return exact.without_copies(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 7: of each class of near copies the smallest doc_id stays."""
    return jaccard.representatives(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 10: secrets become a mark; every document stays, its n_chars renewed."""
    return secret_scan.redact(docs, queries.BYTE_BPE, queries.public_tokenizers.PATTERN)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2: every document in token sequences of at most 2048."""
    return packing.packed(docs, queries.WORD_BPE)


STAGES = [
    ("toxicity", ordinary),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", different),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: Language models, chosen paths and tokens can't be said in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = pinned(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
