"""Readers for raw and frozen tables, JSON sidecars and the three-file benchmark layout."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebasis import schemas
from rebasis.session import exists


def _is(path: str, *endings: str) -> bool:
    return path.rstrip("/").removesuffix(".gz").endswith(endings)


def _scan(spark: SparkSession, path: str, json_schema: T.StructType) -> DataFrame:
    """Parquet brings its schema; JSON gets one, so that no text is read to infer it."""
    if _is(path, ".json", ".jsonl"):
        return spark.read.schema(json_schema).json(path)
    return spark.read.parquet(path)


def raw_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(_id, text) and title; parquet files may lack the title."""
    return _scan(spark, path, schemas.RAW_CORPUS)


def raw_queries(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.RAW_QUERIES)


# Judgment files name their columns with hyphens or with underscores.
HYPHENED = {"query-id": "query_id", "corpus-id": "corpus_id"}
TSV_QRELS = schemas.struct("query-id STRING, corpus-id STRING, score INT")
JSON_QRELS = schemas.struct(
    "query-id STRING, corpus-id STRING, query_id STRING, corpus_id STRING, score INT"
)


def raw_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgments as (query_id, corpus_id, score), from parquet, JSON lines or TSV."""
    if _is(path, ".tsv"):
        found = spark.read.schema(TSV_QRELS).csv(path, sep="\t", header=True)
    else:
        found = _scan(spark, path, JSON_QRELS)
    names = [
        F.coalesce(*(F.col(f"`{c}`") for c in (old, new) if c in found.columns)).alias(new)
        for old, new in HYPHENED.items()
    ]
    return found.select(*names, "score")


def frozen(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of a frozen corpus: corpus, queries or qrels."""
    schema = {"corpus": schemas.CORPUS, "queries": schemas.QUERIES, "qrels": schemas.QRELS}[name]
    return spark.read.schema(schema).parquet(f"{root}/{name}")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).json(f"{root}/manifest")


def sidecars(spark: SparkSession, pattern: str, pretty: bool = False) -> DataFrame:
    """All encode sidecars that match a path or glob, with the file each came from.

    ``pretty``: files hold one indented object each instead of one object per line.
    """
    return (
        spark.read.schema(schemas.ENCODE_RUNS)
        .option("multiLine", pretty)
        .json(pattern)
        .withColumn("sidecar", F.col("_metadata.file_name"))
    )


def encode_runs(spark: SparkSession, root: str) -> DataFrame:
    """The sidecars of all encoded models and splits under ``root``."""
    return sidecars(spark, f"{root}/runs/*")


def benchmark_layout(spark: SparkSession, root: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus and queries as JSON lines, judgments as ``qrels/<split>.tsv``."""
    corpus = spark.read.schema(schemas.RAW_CORPUS).json(f"{root}/corpus.jsonl")
    queries = spark.read.schema(schemas.RAW_QUERIES).json(f"{root}/queries.jsonl")
    judged = raw_qrels(spark, f"{root}/qrels/{split}.tsv")
    graded = judged.select(
        "query_id", F.col("corpus_id").alias("doc_id"), F.col("score").cast("int").alias("rel")
    )
    return corpus, queries, graded


def id_column(df: DataFrame) -> str:
    """``doc_id`` where the table has one, else ``query_id``."""
    return "doc_id" if "doc_id" in df.columns else "query_id"


EXPECTED_JSON = T.MapType(T.StringType(), T.StringType())
EXPECTED_ENTRY = schemas.struct("ndcg_at_10 DOUBLE, source STRING")


def expected_metrics(spark: SparkSession, path: str | None) -> DataFrame:
    """Expected metrics by model from one JSON object.

    Keys that start with an underscore describe the file: its scale and its
    tolerance. Without a file the table is empty, with a warning if one was named.
    """
    if path is not None and not exists(spark, path):
        warnings.warn(f"{path} not found; metrics are reported without comparison", stacklevel=2)
        path = None
    if path is None:
        return spark.createDataFrame([], schemas.EXPECTED_METRICS)
    return parse_expected(spark.read.text(path, wholetext=True))


def parse_expected(texts: DataFrame) -> DataFrame:
    entries = texts.select(F.from_json("value", EXPECTED_JSON).alias("m"))
    named = entries.select("m", F.explode("m").alias("model", "entry")).where(
        ~F.col("model").startswith("_")
    )
    entry = F.from_json("entry", EXPECTED_ENTRY)
    return named.select(
        "model",
        entry["ndcg_at_10"].alias("ndcg_at_10"),
        entry["source"].alias("source"),
        F.try_element_at("m", F.lit("_scale")).alias("scale"),
        F.try_element_at("m", F.lit("_tolerance_points")).cast("double").alias("tolerance"),
    )


def expected_json(entries: dict[str, float], scale: str = "0-1", tolerance: float = 0.02) -> str:
    """The JSON text that :func:`parse_expected` reads."""
    head = {"_scale": scale, "_tolerance_points": tolerance}
    return json.dumps(head | {m: {"ndcg_at_10": v, "source": ""} for m, v in entries.items()})
