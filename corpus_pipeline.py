"""A training corpus from ``documents``: good, distinct, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is the next one's ``docs``; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefscale.llm import exact_dedup, mixing, ngram_join, pieces, quality
from prefscale.session import cut, table

#: Near copies: shingles of five words, a similarity of 0.8 or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.near_dedup(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of each source up to its share of words, repeated where the share is larger than the source."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text, and those of the next best segmentation."""
    return pieces.encode_texts(docs).select("doc_id", "lang", "source", "pieces", "n_pieces", "piece_score", "runner_up", "alternatives")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]
#: SQL can express neither the classifier nor the lattice search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
