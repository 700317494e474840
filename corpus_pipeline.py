"""Training corpus from ``documents``: filter, deduplicate, mix and encode, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which
is written as Parquet and read again. All stages but the last return the columns of ``documents``.

Null and empty texts have no words, so the quality rules reject them. A repeated id keeps all its rows through the
near-duplicate stage if its component keeps that id; mixing may repeat or leave out each of them. Further columns
of ``documents`` stay as they are up to the last stage; the operators' docstrings state ties, nulls in other columns and
empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import mixing, ngram_join, pieces, quality_rules, toxicity
from reelframe.session import ship_package, written_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules of their language and source."""
    return quality_rules.keep_good(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model trained on the labels among them doesn't call toxic."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id in each group linked by 80 % of five-word shingles."""
    ship_package(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target words."""
    return mixing.repeat_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each row's text."""
    ship_package(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Trained scores, components and piece searches are beyond SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
