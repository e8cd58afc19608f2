"""Retrieval metrics over (query, document) judgments and ranked results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebasis.functions.vectors import ratio
from rebasis.registry import TOP_K


def hits(judged: DataFrame, ranked: DataFrame, query: list[str] | str = "query_row",
         doc: str = "corpus_row", k: int = TOP_K) -> DataFrame:
    """Every judged pair once, with ``hit``: is the document among the query's top k?"""
    keys = [query] if isinstance(query, str) else list(query)
    top = ranked.where(F.col("rank") <= k).select(*keys, doc, F.lit(True).alias("_hit"))
    pairs = judged.select(*keys, doc).distinct()
    return pairs.join(top, [*keys, doc], "left").select(
        *keys, doc, F.coalesce("_hit", F.lit(False)).alias("hit")
    )


def recall_by_query(judged: DataFrame, ranked: DataFrame, query: str = "query_row",
                    doc: str = "corpus_row", k: int = TOP_K) -> DataFrame:
    """Hits over all relevant documents, not over ``min(k, relevant)``."""
    return (
        hits(judged, ranked, query, doc, k)
        .groupBy(query)
        .agg(F.count("*").alias("n_relevant"), F.count_if("hit").alias("n_hits"))
        .withColumn("recall", F.col("n_hits") / F.col("n_relevant"))
    )


def macro_recall(judged: DataFrame, ranked: DataFrame, query: str = "query_row",
                 doc: str = "corpus_row", k: int = TOP_K) -> DataFrame:
    """Mean recall over judged queries; one row."""
    return recall_by_query(judged, ranked, query, doc, k).agg(
        F.avg("recall").alias("recall"), F.count("*").alias("n_queries")
    )


def micro_recall(judged: DataFrame, ranked: DataFrame, query: str = "query_row",
                 doc: str = "corpus_row", k: int = TOP_K, by: list[str] | None = None) -> DataFrame:
    """Hits over all judged pairs; one row, or one per value of ``by``."""
    by = by or []
    return (
        hits(judged, ranked, [*by, query], doc, k)
        .groupBy(*by)
        .agg(F.count("*").alias("n_pairs"), F.count_if("hit").alias("n_hits"))
        .withColumn("recall", ratio("n_hits", "n_pairs"))
    )


def ndcg_by_query(graded: DataFrame, ranked: DataFrame, query: str = "query_id",
                  doc: str = "doc_id", rel: str = "rel", k: int = TOP_K) -> DataFrame:
    """Linear gains over log2(rank + 1), against the best order of the k top grades.

    Every judged query counts; 0 where nothing was found or no grade is positive.
    """
    best = Window.partitionBy(query).orderBy(F.desc(rel))
    ideal = (
        graded.select(query, rel, F.row_number().over(best).alias("rank"))
        .where(F.col("rank") <= k)
        .groupBy(query)
        .agg(F.sum(F.col(rel) / F.log2(F.col("rank") + 1.0)).alias("idcg"))
    )
    # one row per searched query, with or without a judged document in its results
    gained = (
        ranked.where(F.col("rank") <= k)
        .join(graded.select(query, doc, rel), [query, doc], "left")
        .groupBy(query)
        .agg(F.coalesce(F.sum(F.col(rel) / F.log2(F.col("rank") + 1.0)), F.lit(0.0)).alias("dcg"))
    )
    return ideal.join(gained, query, "left").select(
        query, ratio(F.coalesce("dcg", F.lit(0.0)), "idcg").alias("ndcg")
    )


def ndcg(graded: DataFrame, ranked: DataFrame, query: str = "query_id", doc: str = "doc_id",
         rel: str = "rel", k: int = TOP_K) -> DataFrame:
    return ndcg_by_query(graded, ranked, query, doc, rel, k).agg(
        F.avg("ndcg").alias("ndcg"), F.count("*").alias("n_queries")
    )
