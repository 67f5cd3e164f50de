"""The corpus pipeline: documents from raw to tokenised, one stage an operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that ``run``
writes as Parquet in the shared checkpoint folder and reads again as the
next stage's documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from communitylens.llm import byte_bpe, exact_dedup, mixing, ngram_join, quality_model
from communitylens.llm.common import table
from communitylens.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_model.accept(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each different text stays."""
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text encoded to token ids, with the proof that they decode."""
    ranks = byte_bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near),
          ("mixing sources to target weights", mix), ("byte-level BPE", tokenise)]

#: A trained classifier is not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``; the last one's rows."""
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex[:12]}")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        out = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
