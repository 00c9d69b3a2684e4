"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from beaconry.llm import (
    articles, codebooks, decontamination, divergence, language, licenses, neighbours, packing, quality, records,
    repeats, simhash, toxicity,
)
from beaconry.llm.common import scratch_path, table
from beaconry.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


@query
def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-records")
    records.write_token_files(table(spark, sf_dir, "documents"), path)
    return records.read_token_files(spark, path, with_ids=False).drop("file_no", "ids")


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(table(spark, sf_dir, "documents"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op4_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles.articles(table(spark, sf_dir, "pages"))


@query
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


@query
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@query
def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(table(spark, sf_dir, "documents")).drop("lang", "source", "n_lines")


@query
def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.encode(table(spark, sf_dir, "embeddings")).drop("label")


@query
def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
