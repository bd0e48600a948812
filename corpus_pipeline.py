"""A corpus pipeline of five stages over documents, each a call of one operator of quillon.llm.

A stage gets what its predecessor kept and returns the columns of documents, but for the last one.

Defined cases, of all stages: an empty table gives an empty one; other columns go along, whatever their names. Null, empty
and blank texts fail the quality rules, and where a stage gets them by itself are not toxic, no duplicates, taken 0 times
and without tokens. Null sources and languages are groups of their own. Rows that repeat an id are judged one by one by
the first two stages; of those one stays as near duplicates; rows without an id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, mixing, near, quality, toxicity
from quillon.llm.common import read_table, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filtered(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model is fitted on labelled documents of the input
    folder, not on what is left of them: what quality rules reject may still be labelled."""
    model = toxicity.train(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return toxicity.filtered(docs, model)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near.filtered(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emitted(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts, one row per document of the mix."""
    return bpe.encode_decode(docs)


STAGES = [("quality rules", quality_stage), ("toxicity", toxicity_stage), ("near duplicates", near_stage), ("mixing", mix_stage), ("bpe", encode_stage)]

#: SQL has no trained classifiers and no subword encoding; tests/llm/test_pipeline.py holds each stage, on what its
#: predecessor kept, against a plain one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage returns is written to shared storage and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
