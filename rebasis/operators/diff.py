"""Compare two versions of an indexed table row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHOWN_ROWS = 5
SHOWN_CHARS = 120


def row_differences(left: DataFrame, right: DataFrame, key: str = "row_idx",
                    ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of either side that differ, with what differs; one-sided rows included."""
    a, b = (
        df.select(key, F.col(ident).alias(f"{side}_id"), F.col(text).alias(f"{side}_text"), F.lit(True).alias(f"in_{side}"))
        for df, side in ((left, "left"), (right, "right"))
    )
    both = a.join(b, key, "full_outer")
    kind = (
        F.when(F.col("in_left").isNull(), "added")
        .when(F.col("in_right").isNull(), "removed")
        .when(~F.col("left_id").eqNullSafe(F.col("right_id")), "id")
        .when(~F.col("left_text").eqNullSafe(F.col("right_text")), "text")
    )
    return both.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        key, "kind", "left_id", "right_id", "left_text", "right_text"
    )


def snapshot_diff(left: DataFrame, right: DataFrame, key: str = "row_idx",
                  ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row: counts of both sides, whether ids and texts agree, rows that differ."""
    a = left.select(key, F.col(ident).alias("a_id"), F.col(text).alias("a_text"), F.lit(1).alias("a"))
    b = right.select(key, F.col(ident).alias("b_id"), F.col(text).alias("b_text"), F.lit(1).alias("b"))
    both = a.join(b, key, "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()
    same_id = paired & F.col("a_id").eqNullSafe(F.col("b_id"))
    same_text = paired & F.col("a_text").eqNullSafe(F.col("b_text"))
    return both.agg(
        F.count("a").alias("n_left"),
        F.count("b").alias("n_right"),
        F.coalesce(F.bool_and(same_id), F.lit(True)).alias("ids_equal"),
        F.coalesce(F.bool_and(same_text), F.lit(True)).alias("texts_equal"),
        F.count_if(~(same_id & same_text)).alias("n_different"),
    )


def examples(differences: DataFrame, n: int = SHOWN_ROWS, chars: int = SHOWN_CHARS,
             key: str = "row_idx") -> DataFrame:
    """The first differences, cut to a readable length."""
    return differences.orderBy(key).limit(n).select(
        key, "kind",
        F.substring("left_text", 1, chars).alias("left_text"),
        F.substring("right_text", 1, chars).alias("right_text"),
    )


def alignment_gaps(source: DataFrame, target: DataFrame, key: str = "row_idx") -> DataFrame:
    """Keys present on one side only; no vectors are read."""
    a = source.select(key, F.lit(1).alias("a"))
    b = target.select(key, F.lit(1).alias("b"))
    return a.join(b, key, "full_outer").where(F.col("a").isNull() | F.col("b").isNull()).select(
        key, F.when(F.col("a").isNull(), "target").otherwise("source").alias("only_in")
    )
