"""The corpus pipeline: quality rules, exact dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.

Defined results, by stage. Extra columns ride along to the last stage, whatever their names; very long texts are worked whole; empty tables give empty tables.
Quality rules: null and empty texts go, repeated rows are judged each. Exact dedup: one row of each text stays, the smallest doc_id's; a null doc_id is larger than any other, and of rows
that tie one stays. Near-dedup: one row of each group stays; unlike texts under one doc_id, or under none, all stay. Mixing: rows without a word are never drawn, a null source is a source,
a document may be drawn twice; ties go by hash, doc_id and size. Packing: every row's ids are packed, those of a null text as the end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import exact_dedup, mixing, neardup, packing, quality_rules
from rillstone.llm.common import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mix sources", mixed), ("best-fit packing", packed)]

#: Near-duplicate components and learned thresholds are beyond SQL; tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
