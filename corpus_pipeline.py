"""Stages that turn the table of documents into packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import decontamination, packing, repeats, simhash, toxicity
from beaconry.llm.common import materialise, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, does not find toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints differ in 2 bits at most; most copies with edits stay (see README)."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that stand elsewhere too."""
    return repeats.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in sequences of 1024."""
    return packing.pack(docs).drop("ids")


STAGES = [
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The classifier, the fuzzy alignment and the tokenizer cannot be written in SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
