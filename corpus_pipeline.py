"""From raw documents to packed bins: five stages, each written as Parquet and read again by the next.

Defined results: null and empty texts go in the first stage, as they have fewer than 20 words; repeated rows and near
duplicates leave one row a group, rows with one doc_id and different texts all stay; empty tables give no bins; further
columns, whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.llm import decontaminate, near_dedup, packing, pii, quality_rules
from braidwork.llm.common import shared_dir, table

#: Of the registered pipeline, whose results are compared; a real run has a key of its own.
KEY = "registered-query-key"


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn on the labelled among the given documents; those that the base rules or a learned rule reject go."""
    return quality_rules.keep(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in at least a twentieth of their words go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets keyed pseudonyms; n_chars follows the new text."""
    done = pii.pseudonymised(docs, KEY).select(*[F.col(f"`{c}`") for c in docs.columns])
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in bins of 2,048 words, one document of a source to a bin."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", reject_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("pseudonyms", pseudonymise),
    ("packing", pack),
]

#: The rules are learned, so SQL can't express the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{root}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
