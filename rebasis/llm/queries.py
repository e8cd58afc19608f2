"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis.llm import (
    attribution, decontaminate, licenses, mixing, quality_model, quality_rules, simhash, sql, token_files, toxicity,
    url_filters, va_clusters, pii, variants,
)
from rebasis.llm.common import fold, query, table

# The rules of the url query.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


@query(sql.MIXING)
def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(mixing.doc_sizes(table(spark, sf_dir, "documents"))))


@query(sql.QUALITY_RULES)
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@query()
def op3_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query()
def op4_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_shards(token_files.write_shards(table(spark, sf_dir, "documents")))


@query()
def op5_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"))


@query(sql.LICENSES)
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def scored(docs: DataFrame, parts: int, out: int, model) -> DataFrame:
    held = fold(F.col("doc_id"), parts) == out
    return model.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op7_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return scored(docs, 5, 0, toxicity.score(docs, model))


@query(sql.DECONTAMINATION)
def op8_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judged(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


@query()
def op10_quality_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return scored(docs, 3, 1, quality_model.score(docs, model))


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query(sql.VA_CLUSTERS)
def op13_va_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = va_clusters.cluster(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query()
def op12_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query(sql.VARIANTS)
def op11_vgram_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))
