"""A corpus pipeline of five stages over ``documents``; each works on what its predecessor kept.

Stages: language identification (texts that follow no learnt language, and those without letters, go), near duplicates (of
each group of linked documents the one with the smallest doc_id stays, row by row, so rows may repeat a doc_id or lack one), benchmark decontamination (documents that leak an
item go), secrets (spans are replaced by a mark), packing into sequences of 2,048 tokens.

Nulls, empty and very long texts, repeated rows and empty tables are treated as each operator defines. Rows that repeat both
doc_id and text are one document to the near-duplicate stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aclweave.llm import decontaminate, jaccard, langid, packing, secretscan
from aclweave.llm.base import is_held_out, saved, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = langid.fit(docs.filter(~is_held_out(F.col("doc_id"))))
    return langid.identify(docs, models).filter(~F.col("rejected")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language identification", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("best-fit packing", sequences),
]

#: The stages' models and statistics can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage{k}")
    return docs
