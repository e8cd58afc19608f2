"""Reader for the vector table: (model, split, shard_id) directories of parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import schemas


def vectors(spark: SparkSession, root: str, model: str | None = None,
            split: str | None = None, must_exist: bool = True) -> DataFrame:
    """Vectors of a model and split; only their directories are read.

    Raises where nothing is stored, unless ``must_exist`` is off.
    """
    found = spark.read.schema(schemas.VECTORS).parquet(root)
    for column, value in (("model", model), ("split", split)):
        if value is not None:
            found = found.where(F.col(column) == value)
    if must_exist and found.isEmpty():
        raise FileNotFoundError(f"no vectors for {model}/{split} under {root}")
    return found


def stored_shapes(found: DataFrame) -> DataFrame:
    """Rows and vector lengths by model and split, with zero and NaN vectors counted."""
    square = F.aggregate(
        F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x
    )
    measured = found.select("model", "split", F.size("embedding").alias("dim"), square.alias("sq"))
    return measured.groupBy("model", "split").agg(
        F.count("*").alias("n_rows"),
        F.min("dim").alias("min_dim"),
        F.max("dim").alias("max_dim"),
        F.count_if(F.col("sq") == 0.0).alias("n_zero"),
        F.count_if(F.isnan("sq")).alias("n_nan"),
    )


def shard_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("model", "split").agg(
        F.count_distinct("shard_id").alias("n_shards"), F.count("*").alias("n_rows")
    )
