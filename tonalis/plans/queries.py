"""Registered queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonalis.plans import gram_queries, score_queries, synth_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**gram_queries.Q, **score_queries.Q, **synth_queries.Q, **table_queries.Q}
ORACLE: dict[str, str] = {**gram_queries.SQL, **score_queries.SQL, **synth_queries.SQL, **table_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, and find the peaks."""
    return gram_queries.w4_peaks_2d(spark, sf_dir)
