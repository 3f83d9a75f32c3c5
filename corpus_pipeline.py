"""The training corpus, from documents: quality, language, near duplicates, packing.

Every stage is written as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriloom.llm import langid, packing, quality, simhash
from veriloom.llm.common import shared_dir, written
from veriloom.llm.queries import TOKENIZER


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of good quality that aren't toxic, with all columns, judged by their whole texts.

    Null, empty and wordless texts go. Equal rows fare alike; null and repeated ids are no matter. An empty table gives an
    empty one; without labels every text with a word stays.
    """
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with at least half their words in one language that the table's lang column names, with all columns.

    Texts without a word go. If lang is null throughout, every text with a word stays.
    """
    return langid.kept(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the documents of the least id, with all columns.

    Rows that repeat that id stay as often as they are there; rows with a null id stay. Short and very long texts are
    compared like all others.
    """
    return simhash.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids with the documents in them. Every row with a text is in them once for each time it is there."""
    return packing.packed(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("best-fit packing", packing_stage),
]

#: Nearest neighbours, the random field, near duplicates and the reduction have no SQL form; tests hold them to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to shared storage and read again. Extra columns go through all but the last."""
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{at}/stage{k}")
    return docs
