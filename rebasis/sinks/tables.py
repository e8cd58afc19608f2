"""Writers. A frozen corpus is written once; its manifest comes last, as the commit mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis.operators.encode import shard_of
from rebasis.registry import SHARD_ROWS
from rebasis.session import exists


def refuse_if_frozen(spark: SparkSession, root: str) -> None:
    if exists(spark, f"{root}/manifest"):
        raise FileExistsError(
            f"{root} holds a frozen corpus; vectors already made from it would be orphaned"
        )


def write_table(df: DataFrame, path: str) -> None:
    """Parquet; whatever an aborted earlier run left without a manifest is replaced."""
    df.write.mode("overwrite").parquet(path)


def write_manifest(row: DataFrame, root: str) -> None:
    row.coalesce(1).write.mode("errorifexists").json(f"{root}/manifest")


def write_vectors(df: DataFrame, root: str, shard_rows: int = SHARD_ROWS) -> None:
    """Store (model, split, row_idx, embedding, ...) by shard of ``shard_rows`` rows.

    Shards present in ``df`` replace their stored versions whole; others stay.
    """
    placed = df if "shard_id" in df.columns else df.withColumn("shard_id", shard_of("row_idx", shard_rows))
    (
        placed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("model", "split", "shard_id")
        .parquet(root)
    )


def write_run(run: DataFrame, root: str, model: str, split: str) -> None:
    """Store the sidecar of one model and split; encoding again replaces it."""
    run.coalesce(1).write.mode("overwrite").json(f"{root}/runs/{model.replace('/', '_')}__{split}")


def write_pair_results(results: DataFrame, path: str, fmt: str = "json") -> None:
    results.coalesce(1).write.mode("overwrite").format(fmt).save(path)


def refuse_if_encoded(runs: DataFrame, model: str, split: str, force: bool = False) -> None:
    """Raise where a finished run of this model and split is on record."""
    done = runs.where((F.col("model") == model) & (F.col("split") == split))
    if not force and not done.isEmpty():
        raise FileExistsError(f"{model}/{split} is encoded; pass force to encode it again")
