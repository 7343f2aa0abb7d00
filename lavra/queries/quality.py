"""Queries of the general data-quality operators (problems 3 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lavra.operators import amounts, instants
from lavra.sources.tables import table


def document_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: language, time zone and source of its first delivery that has them."""
    return (
        table(spark, sf_dir, "processed_documents")
        .groupBy(F.col("sha256").alias("document_id"))
        .agg(F.min("lang").alias("lang"), F.min("source_tz").alias("source_tz"), F.min("source_name").alias("source_name"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every readable amount in hundredths of BRL."""
    return amounts.convert_amounts(
        table(spark, sf_dir, "policy_extraction"), document_settings(spark, sf_dir).select("document_id", "lang"), table(spark, sf_dir, "exchange_rates")
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stated existing date as a UTC instant: the most probable reading among those that the language's convention admits."""
    found = instants.normalise_instants(table(spark, sf_dir, "policy_extraction"), document_settings(spark, sf_dir))
    return found.where("rank = 1").select("extraction_id", "field_name", "utc_seconds").distinct()


def p7_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notations of each source as learned without the language's convention, and values left ambiguous."""
    found = instants.normalise_instants(table(spark, sf_dir, "policy_extraction"), document_settings(spark, sf_dir), convention="learned")
    return (
        found.where("rank = 1")
        .groupBy("source_name", "notation")
        .agg(F.count("*").alias("n_values"), F.count_if("ambiguous").alias("n_ambiguous"))
    )


QUERIES = {f.__name__: f for f in (p3_found, p7_found, p7_formats)}
ORACLES: dict[str, str] = {}
