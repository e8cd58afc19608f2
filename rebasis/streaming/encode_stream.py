"""Encode new rows as files arrive: the resumable encode as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebasis.operators.encode import Encoder, encode, shard_of
from rebasis.registry import BATCH_SIZE, SHARD_ROWS
from rebasis.session import exists
from rebasis.sources.vectors import vectors


def encode_new_files(spark: SparkSession, source: str, schema: T.StructType, output: str,
                     checkpoint: str, encoder: Encoder, prefix: str = "", ident: str = "doc_id",
                     text: str = "text", batch_size: int = BATCH_SIZE,
                     files_per_batch: int | None = None, split: str = "corpus",
                     model: str | None = None, shard_rows: int = SHARD_ROWS,
                     max_tokens: int | None = None) -> None:
    """Encode every file under ``source`` not yet seen into the vector table ``output``, then return.

    ``ident`` is the row number of a text. The stream's checkpoint records which files are
    done, and a batch leaves out the rows of this model and split that its shards hold
    already, so a batch that was interrupted and runs again stores nothing twice.
    """
    model = model or encoder.name
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(ident).cast("bigint").alias("row_idx"), F.col(text).alias("text"))
        rows = rows.withColumn("shard_id", shard_of("row_idx", shard_rows).cast("bigint"))
        if exists(spark, output):
            held = vectors(spark, output, model, split, must_exist=False).select("shard_id", "row_idx")
            rows = rows.join(held, ["shard_id", "row_idx"], "left_anti")
        made = encode(rows, encoder, prefix, batch_size=batch_size, half=True, max_tokens=max_tokens)
        made.select(
            "row_idx", "embedding", F.lit(prefix).alias("prefix"), F.lit(None).cast("string").alias("input_hash"),
            F.lit(encoder.revision).alias("revision"), F.lit(max_tokens).cast("int").alias("max_tokens"),
            F.lit(model).alias("model"), F.lit(split).alias("split"), "shard_id",
        ).write.mode("append").partitionBy("model", "split", "shard_id").parquet(output)

    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
