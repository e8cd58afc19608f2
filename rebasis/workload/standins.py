"""The studied tables, derived from the given test tables.

Text: ``documents`` is the raw corpus, ``benchmark`` the raw queries, and a
document is relevant to a passage it contains. Vectors: ``embeddings`` is the
first model; two more follow from it by fixed linear maps; queries are blends
of a vector and its successor, which are also the judged documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis.functions.vectors import let, unit
from rebasis.operators.linmap import planted_extension, planted_rotation
from rebasis.operators.judgments import to_rows
from rebasis.plans.corpus import Frozen, FreezeSpec, frozen_frames
from rebasis.session import spread, stored

MODELS = {"studio/base": 64, "studio/rotated": 64, "studio/extended": 96}
BLEND = 0.35


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The documents for work that is heavy per row; their one file is one split."""
    return spread(table(spark, sf, "documents"), "doc_id")


def raw_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(
        F.col("doc_id").cast("string").alias("_id"),
        F.concat(F.lit("  "), "source", F.lit(" ")).alias("title"),
        "text",
    )


def raw_queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("_id"), "text")


def contained(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, doc_id) where the document contains the passage.

    A contained passage brings its second to fourth words along as whole words,
    so documents and passages meet on hashed word triples before they are compared.
    """
    docs, items = texts(spark, sf), table(spark, sf, "benchmark")

    def triples(words):
        return F.transform(
            F.sequence(F.lit(1), F.size(words) - 2),
            lambda i: F.xxhash64(*(F.get(words, i - 1 + n) for n in range(3))),
        )

    words = let(
        F.split("text", " "),
        lambda w: F.when(F.size(w) > 2, F.array_distinct(triples(w))).otherwise(F.array()),
    )
    if short := items.where(F.size(F.split("text", " ")) < 5).count():
        raise ValueError(f"{short} passages have fewer than five words and would not be found")
    anchors = items.select("item_id", F.xxhash64(*(F.get(F.split("text", " "), n) for n in (1, 2, 3))).alias("g"))
    met = docs.select("doc_id", F.explode(words).alias("g")).join(anchors, "g")
    return (
        met.select("item_id", "doc_id")
        .join(docs.select("doc_id", F.col("text").alias("hay")), "doc_id")
        .join(items.select("item_id", F.col("text").alias("needle")), "item_id")
        .where(F.contains("hay", "needle"))
        .select("item_id", "doc_id")
    )


def raw_qrels(spark: SparkSession, sf: str) -> DataFrame:
    """Scores are 0 for documents labelled toxic, else 1; grades follow the quality label."""
    labels = table(spark, sf, "labels")
    judged = contained(spark, sf).join(labels, "doc_id", "left").select(
        F.col("item_id").cast("string").alias("query_id"),
        F.col("doc_id").cast("string").alias("corpus_id"),
        F.when(F.col("toxic") == 1, 0).otherwise(1).alias("score"),
        (F.coalesce("quality", F.lit(0)) + 1).alias("rel"),
    )
    # judgments are a table that several steps read
    return stored(judged, "qrels")


@dataclass
class Corpus:
    frozen: object
    chosen: object
    spec: FreezeSpec


def corpus(spark: SparkSession, sf: str, written: bool = False) -> Corpus:
    """Freeze half of the documents around half of the judged passages.

    ``written`` stores the tables first, for work that reads them several times.
    """
    qrels = raw_qrels(spark, sf)
    n_judged = qrels.where(F.col("score") > 0).select("query_id").distinct().count()
    spec = FreezeSpec(
        n_queries=max(1, n_judged // 2),
        n_docs=table(spark, sf, "documents").count() // 2,
        source="documents",
        flat_hash=True,
    )
    frozen, chosen = frozen_frames(raw_corpus(spark, sf), raw_queries(spark, sf), qrels, spec)
    if written:
        docs, asked = stored(frozen.corpus, "corpus"), stored(frozen.queries, "queries")
        qrels = stored(to_rows(chosen.judged, asked, docs, chosen.n_judged), "qrels-rows")
        frozen = Frozen(docs, asked, qrels)
    return Corpus(frozen, chosen, spec)


def base_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx"), "embedding")


def blended_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector blended with its successor: (row_idx, embedding)."""
    base = base_vectors(spark, sf)
    after = base.select((F.col("row_idx") - 1).alias("row_idx"), F.col("embedding").alias("after"))
    wide = F.col("embedding").cast("array<double>")
    mixed = F.zip_with(
        wide, F.col("after").cast("array<double>"),
        lambda x, y: x + F.lit(BLEND) * F.coalesce(y, F.lit(0.0)),
    )
    return (
        base.join(after, "row_idx", "left")
        .select("row_idx", unit(F.coalesce(mixed, wide)).cast("array<float>").alias("embedding"))
    )


def graded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(query_row, corpus_row, rel): the blended vector has grade 2, its successor 1."""
    base = base_vectors(spark, sf).select("row_idx")
    judged = base.select(
        F.col("row_idx").alias("query_row"),
        F.explode(F.array(
            F.struct(F.col("row_idx").alias("corpus_row"), F.lit(2).alias("rel")),
            F.struct((F.col("row_idx") + 1).alias("corpus_row"), F.lit(1).alias("rel")),
        )).alias("j"),
    ).select("query_row", "j.*")
    return judged.join(base.select(F.col("row_idx").alias("corpus_row")), "corpus_row", "left_semi")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Both splits of all three models, stored by directory: (model, split, row_idx, embedding)."""
    maps = {
        "studio/base": F.col("embedding"),
        "studio/rotated": planted_rotation("embedding"),
        "studio/extended": planted_extension("embedding"),
    }
    splits = {"corpus": base_vectors(spark, sf), "queries": blended_queries(spark, sf)}
    out = None
    for model, image in maps.items():
        for split, rows in splits.items():
            part = rows.select(
                F.lit(model).alias("model"), F.lit(split).alias("split"), "row_idx",
                image.cast("array<float>").alias("embedding"),
            )
            out = part if out is None else out.unionByName(part)
    return stored(out, "vectors", ("model", "split"))
