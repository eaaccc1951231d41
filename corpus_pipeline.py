"""The training-data pipeline: quality rules, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of `documents`.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from proofdesk.llm import chunks, jaccard, mixture, quality, toxicity
from proofdesk.llm.base import written
from proofdesk.llm.queries import WORD_BPE, table
from proofdesk.llm.tokens import tokenizer_file
from proofdesk.session import ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return jaccard.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return chunks.drop_spans(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixture.pack(docs, tokenizer_file(WORD_BPE))


STAGES = [("quality rules", quality_rules), ("toxicity", toxic_documents), ("n-gram Jaccard join", near_duplicates),
          ("substring dedup", repeated_passages), ("packing", packed)]

#: A fitted classifier and tokenized packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
