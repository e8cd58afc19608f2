"""Readable summaries of encode runs, pair results and ceilings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebasis.functions.text import short_name, slug
from rebasis.functions.vectors import ratio


def encode_summary(runs: DataFrame) -> DataFrame:
    """Rows, dimension and throughput by model and split."""
    return runs.groupBy(slug("model").alias("model"), "split").agg(
        F.sum("n_rows").alias("n_rows"),
        F.max("dim").alias("dim"),
        F.round(ratio(F.sum("n_rows"), F.sum("seconds")), 1).alias("rows_per_sec"),
    )


def pair_summary(results: DataFrame) -> DataFrame:
    five = lambda c: F.format_string("%.5f", F.col(c))
    return results.select(
        short_name("source").alias("source"),
        short_name("target").alias("target"),
        five("recall_at_10_translated").alias("translated"),
        five("recall_at_10_native_target").alias("native"),
        five("ratio").alias("ratio"),
    )


def ceiling_lines(ceilings: DataFrame) -> DataFrame:
    return ceilings.select(
        "model",
        F.concat(F.lit("recall@10 = "), F.format_string("%.5f", F.col("recall_at_10"))).alias("line"),
    )
