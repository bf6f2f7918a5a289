"""A corpus pipeline of four stages: quality, near duplicates, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from verdigris import ship
from verdigris.llm import bpe, mixing, ngram_join, quality
from verdigris.llm._shared import materialize, table
from verdigris.llm.bpe import tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by the Jaccard similarity of their 5-word shingles one stays."""
    ship(spark)
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions of their targets: documents are taken whole, in part, or twice."""
    ship(spark)
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document of the mix, with digests of them and of what they decode to."""
    ship(spark)
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("mixing", mixed_sources), ("encoding", encoded)]
#: The learned classifier and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
