"""Judgments: filtering, index space, restriction to a document split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rebasis.operators.ordering import Cut, shuffled_index
from rebasis.session import small


def positive(qrels: DataFrame) -> DataFrame:
    """Judgments with a positive score, with ids as strings."""
    return qrels.where(F.col("score") > 0).select(
        F.col("query_id").cast("string").alias("query_id"),
        F.col("corpus_id").cast("string").alias("corpus_id"),
    )


def missing_documents(judged: DataFrame, corpus: DataFrame,
                      n_judged: int | None = None) -> DataFrame:
    """Judged document ids that the corpus lacks.

    The corpus ids are first cut down to judged ones, a scan where the
    judgments are few enough to broadcast.
    """
    wanted = judged.select("corpus_id").distinct()
    n = judged.count() if n_judged is None else n_judged
    present = corpus.select(F.col("doc_id").alias("corpus_id")).join(
        small(wanted, n), "corpus_id", "left_semi"
    )
    return wanted.join(present, "corpus_id", "left_anti")


def to_rows(judged: DataFrame, queries: DataFrame, corpus: DataFrame,
            n_judged: int | None = None) -> DataFrame:
    """Id pairs as distinct (query_row, corpus_row); pairs without a row drop out.

    With a known small number of judgments these are broadcast to the corpus ids.
    """
    q = queries.select("query_id", F.col("row_idx").alias("query_row"))
    d = corpus.select(F.col("doc_id").alias("corpus_id"), F.col("row_idx").alias("corpus_row"))
    pairs = judged.join(q, "query_id").select("query_row", "corpus_id")
    if n_judged is not None:
        pairs = small(pairs, n_judged)
    return d.join(pairs, "corpus_id").select("query_row", "corpus_row").distinct()


def in_split(qrels: DataFrame, train: Cut) -> DataFrame:
    """Judgments of documents outside the training cut. No join: the cut is a predicate."""
    return qrels.where(~train.keeps("corpus_row"))


def renumbered(test_qrels: DataFrame, test_docs: DataFrame, index: str = "row_idx",
               seed: int = 42, stream: str = "split") -> DataFrame:
    """Judgments with the document's dense position within the test split."""
    places = shuffled_index(test_docs.select(index), index, seed, stream, "test_row")
    return test_qrels.join(
        places.withColumnRenamed(index, "corpus_row"), "corpus_row"
    ).select("query_row", "corpus_row", "test_row")


def judged_texts(qrels: DataFrame, queries: DataFrame, corpus: DataFrame,
                 n_pairs: int | None = None) -> DataFrame:
    """The texts of judged pairs: (query_row, corpus_row, query_text, doc_text).

    A known small number of pairs is broadcast, so that no document text moves.
    """
    if n_pairs is not None:
        qrels = small(qrels, n_pairs)
    q = queries.select(F.col("row_idx").alias("query_row"), F.col("text").alias("query_text"))
    d = corpus.select(F.col("row_idx").alias("corpus_row"), F.col("text").alias("doc_text"))
    texts = d.join(qrels, "corpus_row")
    return q.join(texts, "query_row").select("query_row", "corpus_row", "query_text", "doc_text")
