"""Each model's own recall on a frozen corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebasis.operators.metrics import macro_recall
from rebasis.operators.retrieve import top_k
from rebasis.registry import TOP_K


def native_ranking(vectors: DataFrame, model: str, k: int = TOP_K) -> DataFrame:
    """A model's queries against its own documents: (query_row, rank, corpus_row, score)."""
    mine = vectors.where(F.col("model") == model)
    docs = mine.where(F.col("split") == "corpus").select(
        F.col("row_idx").alias("corpus_row"), "embedding"
    )
    queries = mine.where(F.col("split") == "queries").select(
        F.col("row_idx").alias("query_row"), "embedding"
    )
    return top_k(docs, queries, k, doc_id="corpus_row")


def ceilings(vectors: DataFrame, qrels: DataFrame, models: list[str], k: int = TOP_K) -> DataFrame:
    """Macro recall by model."""
    rows = [
        macro_recall(qrels, native_ranking(vectors, m, k), k=k).select(
            F.lit(m).alias("model"), F.col("recall").alias("recall_at_10")
        )
        for m in models
    ]
    return reduce(DataFrame.unionByName, rows)
