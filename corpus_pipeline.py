"""Corpus cleaning: language ID, near-dedup, substring dedup, decontamination, packing.

Every stage takes what its predecessor kept as Parquet, and returns the columns of ``documents``;
the last one returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, nearcopies, packing, substring
from millrace.llm.common import drop_staged, staged, table
from millrace.llm.queries import language_model


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that are rejected go."""
    return langid.accepted(docs, language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies (five-word Jaccard similarity of 0.8 or more),
    that with the smallest doc_id."""
    return nearcopies.first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds.

    A text that loses words is what is left, joined by single spaces, and its n_chars are counted
    anew; a document that loses all its words goes. Others stay as they are.
    """
    left = substring.remove_repeats(docs).where("n_removed = 0 OR n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("whole_text"))

    def column(name: str):
        if name == "text":
            return text.alias(name)
        old = F.col(f"record.`{name}`")
        if name == "n_chars":
            return F.when(F.col("n_removed") > 0, F.length("kept").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return left.select(*[column(name) for name in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

# SQL can express none of the first, second, fourth and last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, earlier = table(spark, sf_dir, "documents"), []
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{number}")
        drop_staged(*earlier)
        earlier = [docs]
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
