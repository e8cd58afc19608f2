"""Order-sensitive fingerprints of an id column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.functions.hashing import sha16
from rebasis.registry import SHARD_ROWS


def _joined(parts: Column) -> Column:
    """Each part followed by a NUL, so that ["ab", "c"] and ["a", "bc"] differ."""
    nul = F.lit("\x00")
    return F.concat(F.array_join(parts, "\x00"), F.when(F.size(parts) > 0, nul).otherwise(""))


def _in_order(order: str, value: str) -> Column:
    return F.transform(
        F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value]
    )


def flat_fingerprint(df: DataFrame, ident: str, index: str = "row_idx") -> DataFrame:
    """One row (fingerprint, n): the hash of all ids in index order.

    One running hash over all ids, so one task sees them all. For comparison
    with hashes made elsewhere, where asked for; guards use :func:`tree_fingerprint`.
    """
    ids = df.select(F.col(index).alias("o"), F.col(ident).cast("string").alias("v"))
    return ids.agg(
        sha16(_joined(_in_order("o", "v"))).alias("fingerprint"), F.count("*").alias("n")
    )


def tree_fingerprint(df: DataFrame, ident: str, index: str = "row_idx",
                     chunk: int = SHARD_ROWS) -> DataFrame:
    """One row (fingerprint, n): the hash of hashes of fixed index ranges.

    Three levels of at most ``chunk`` parts each, so no group grows with the
    table (up to ``chunk ** 3`` rows).
    """
    level = df.select(
        F.col(index).alias("o"), F.col(ident).cast("string").alias("v"), F.lit(1).alias("n")
    )
    for _ in range(2):
        level = level.groupBy(F.floor(F.col("o") / chunk).alias("c")).agg(
            F.sha2(_joined(_in_order("o", "v")), 256).alias("v"), F.sum("n").alias("n")
        ).select(F.col("c").alias("o"), "v", "n")
    return level.agg(
        sha16(_joined(_in_order("o", "v"))).alias("fingerprint"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
    )
