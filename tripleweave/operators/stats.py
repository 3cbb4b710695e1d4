"""Counts over a triple table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_properties(triples: DataFrame) -> DataFrame:
    return triples.select("prop").distinct()


def vp_stats(triples: DataFrame) -> DataFrame:
    """``prop, rows, ratio``: rows per property and their share of all triples, one pass."""
    counts = triples.groupBy("prop").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))  # one row, joined back as such
    return counts.crossJoin(F.broadcast(total)).select("prop", "rows", (F.col("rows") / F.col("total")).alias("ratio"))


def db_stats(stats: DataFrame, reduced_tables: int = 0) -> DataFrame:
    """One row about the whole store, from its :func:`vp_stats`.

    A reduced table takes the place of its property's own table in the count.
    """
    return stats.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("num_triples"),
        F.count(F.lit(1)).alias("num_properties"),
        (F.count(F.lit(1)) - reduced_tables).alias("num_vp_tables"),
        F.lit(reduced_tables).cast("bigint").alias("num_reduced_tables"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("num_tuples"),
    )
