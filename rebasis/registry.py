"""The model registry: dimension, prefixes and batch sizes by model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import schemas

# Defaults of the studied jobs.
SEED = 42
N_QUERIES = 500
N_DOCS = 10_000
TOP_K = 10
TRAIN_DOCS = 5_000
SHARD_ROWS = 50_000
MAX_TOKENS = 512
BATCH_SIZE = 256
DETERMINISM_COSINE = 0.9999
PREFIX_GAP = 0.005
METRIC_TOLERANCE = 0.02
SPLITS = ("corpus", "queries")

# The query instruction of one model family.
INSTRUCT_PROMPT = (
    "Instruct: Given a web search query, retrieve relevant passages "
    "that answer the query\nQuery: "
)

# Public model names, dimensions, prefixes, batch sizes at the
# small and the large scale, and whether the prefix audit applies. An empty
# prefix means "checked: none needed"; a model that is not listed is an error.
MODELS = [
    ("intfloat/e5-base-v2", 768, {"query": "query: ", "doc": "passage: "}, 256, 512, True),
    (
        "BAAI/bge-base-en-v1.5", 768,
        {"query": "Represent this sentence for searching relevant passages: ", "doc": ""},
        256, 512, True,
    ),
    ("Alibaba-NLP/gte-base-en-v1.5", 768, {"query": "", "doc": ""}, 256, 512, False),
    (
        "nomic-ai/nomic-embed-text-v1.5", 768,
        {"query": "search_query: ", "doc": "search_document: "},
        256, 512, True,
    ),
    ("Qwen/Qwen3-Embedding-0.6B", 1024, {"query": INSTRUCT_PROMPT, "doc": ""}, 128, 256, False),
    ("Qwen/Qwen3-Embedding-4B", 2560, {"query": INSTRUCT_PROMPT, "doc": ""}, 32, 64, False),
]

# Fixed value: models of this family carry their own query prompt.
OWN_PROMPT_FAMILY = "Qwen/Qwen3-Embedding"


def models(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """The registry as a table, with further models appended."""
    return spark.createDataFrame([*MODELS, *(extra or [])], schemas.MODELS)


def prefix_for(registry: DataFrame, model: str, side: str) -> str:
    """The literal prefix of a model on one side; raises when nobody has set it."""
    row = (
        registry.where(F.col("model") == model)
        .select(F.try_element_at("prefix", F.lit(side)).alias("prefix"))
        .first()
    )
    if row is None or row.prefix is None:
        raise KeyError(f"no {side} prefix registered for {model}; add the model first")
    return row.prefix


def dim_for(registry: DataFrame, model: str) -> int | None:
    """The registered dimension of a model, None if it is not registered."""
    row = registry.where(F.col("model") == model).select("dim").first()
    return None if row is None else row.dim


def batch_size_for(registry: DataFrame, model: str, large: bool = False) -> int | None:
    """The registered batch size of a model at the small or the large scale, None if it is not registered."""
    row = registry.where(F.col("model") == model).select("large_batch_size" if large else "batch_size").first()
    return None if row is None else row[0]


def prefix_testable(registry: DataFrame, model: str) -> bool:
    """Does the prefix audit apply to the model? Not to one that is unregistered or marked otherwise."""
    row = registry.where(F.col("model") == model).select("prefix_testable").first()
    return bool(row is not None and row[0])


def prefix_of(registry: DataFrame, encoder: object, side: str, model: str | None = None) -> str:
    """The prefix an encoder is used with: its own ``query_prompt`` where that overrides, else the registered one."""
    model = model or encoder.name
    own = getattr(encoder, "query_prompt", None)
    if own is not None and side == "query" and model.startswith(OWN_PROMPT_FAMILY):
        return own
    return prefix_for(registry, model, side)


def effective_prefix(own_prompt: Column, model: Column | str = "model",
                     side: Column | str = "side", prefix: Column | str = "prefix") -> Column:
    """The registry prefix, or the model's own query prompt where it brings one."""
    model, side, prefix = (
        F.col(c) if isinstance(c, str) else c for c in (model, side, prefix)
    )
    overrides = model.startswith(OWN_PROMPT_FAMILY) & (side == "query") & own_prompt.isNotNull()
    return F.when(overrides, own_prompt).otherwise(F.try_element_at(prefix, side))


def attach_prefix(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``prefix`` to rows of (model, side, ...).

    Call :func:`unregistered` first: rows without a registry entry drop out here.
    """
    looked_up = df.join(registry.select("model", F.col("prefix").alias("_prefixes")), "model")
    return (
        looked_up.withColumn("prefix", F.try_element_at("_prefixes", F.col("side")))
        .where(F.col("prefix").isNotNull())
        .drop("_prefixes")
    )


def unregistered(df: DataFrame, registry: DataFrame) -> DataFrame:
    """The (model, side) pairs of ``df`` that have no prefix in the registry."""
    known = registry.select("model", F.explode("prefix").alias("side", "_")).drop("_")
    return df.select("model", "side").distinct().join(known, ["model", "side"], "left_anti")


def model_pairs(names: DataFrame) -> DataFrame:
    """Ordered pairs of distinct models from a table with a ``model`` column.

    The number of models is that of the registry, not of any row-sized table.
    """
    listed = names.select("model").distinct().agg(F.sort_array(F.collect_list("model")).alias("m"))
    return (
        listed.select(F.explode("m").alias("source"), "m")
        .select("source", F.explode("m").alias("target"))
        .where(F.col("source") != F.col("target"))
    )
