"""Encode a frozen split into the vector table, resumable by shard."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import schemas
from rebasis.operators.encode import Encoder, encode, expected_shards, resume_plan, shard_of
from rebasis.operators.fingerprint import flat_fingerprint, tree_fingerprint
from rebasis.plans.audits import stored_type_ok
from rebasis.registry import BATCH_SIZE, SHARD_ROWS
from rebasis.session import exists, small
from rebasis.sinks.tables import refuse_if_encoded, write_run, write_vectors
from rebasis.sources.tables import encode_runs, frozen, id_column, manifest
from rebasis.sources.vectors import vectors

# At most this many tasks write shards, each one shard after another. Shards are
# spread by hash, so several tasks per shard keep most of them apart.
WRITE_TASKS = 40_000
TASKS_PER_SHARD = 4
# Small shards share tasks of about this many rows: a task per shard would cost more than its work.
TASK_ROWS = SHARD_ROWS // TASKS_PER_SHARD


def verify_input(df: DataFrame, recorded: DataFrame) -> tuple[str, str]:
    """Recompute the fingerprint of a frozen table; raises if the manifest has another.

    The tree fingerprint, or the flat one of a manifest that has no other. Returns the
    manifest column and the value that agreed.
    """
    ident = id_column(df)
    side = "corpus" if ident == "doc_id" else "queries"
    held = recorded.first()
    if held is None:
        raise FileNotFoundError("the corpus has no manifest; freeze it first")
    held = held.asDict()
    if held.get(f"{side}_tree_hash") is not None:
        key, seen = f"{side}_tree_hash", tree_fingerprint(df, ident).first().fingerprint
    elif held.get(f"{side}_hash") is not None:
        key, seen = f"{side}_hash", flat_fingerprint(df, ident).first().fingerprint
    else:
        raise ValueError(f"the manifest has no fingerprint of the {side} table")
    if seen != held[key]:
        raise ValueError(f"{key} mismatch: {seen} != {held[key]}; the {side} table has drifted")
    return key, seen


def encode_pending(rows: DataFrame, pending: DataFrame, encoder: Encoder, model: str, split: str,
                   prefix: str, input_hash: str, root: str, batch_size: int = BATCH_SIZE,
                   max_tokens: int | None = None, shard_rows: int = SHARD_ROWS,
                   n_pending: int | None = None) -> None:
    """Encode the rows of pending shards and store them, each shard whole in one task.

    Text is moved to its shard's task before encoding, so vectors are not shuffled.
    """
    waiting = rows.select("row_idx", "text", shard_of("row_idx", shard_rows).alias("shard_id"))
    if n_pending is None:
        n_pending = pending.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    useful = max(4 * cores, -(-n_pending * shard_rows // TASK_ROWS))
    tasks = max(1, min(TASKS_PER_SHARD * n_pending, WRITE_TASKS, useful))
    waiting = waiting.join(small(pending.select("shard_id"), n_pending), "shard_id").repartition(
        tasks, "shard_id"
    )
    made = encode(waiting, encoder, prefix, batch_size=batch_size, half=True, max_tokens=max_tokens)
    write_vectors(
        made.select(
            "row_idx", "embedding", F.lit(prefix).alias("prefix"),
            F.lit(input_hash).alias("input_hash"), F.lit(encoder.revision).alias("revision"),
            F.lit(max_tokens).cast("int").alias("max_tokens"), F.lit(model).alias("model"),
            F.lit(split).alias("split"), "shard_id",
        ),
        root, shard_rows,
    )


def encode_split(spark: SparkSession, corpus_root: str, root: str, split: str, encoder: Encoder,
                 prefix_type: str, prefix: str, model: str | None = None,
                 batch_size: int = BATCH_SIZE, max_tokens: int | None = None,
                 shard_rows: int = SHARD_ROWS, force: bool = False,
                 registered_dim: int | None = None) -> DataFrame:
    """Verify, resume, encode, check totals, write the sidecar; returns the sidecar row.

    ``root`` holds ``vectors`` and ``runs``. Shards made with another prefix, input, revision
    or token cap count as missing; ``force`` encodes every shard again. An encoder whose
    dimension is not the ``registered_dim`` is refused.
    """
    if registered_dim is not None and registered_dim != encoder.dim:
        raise ValueError(f"{encoder.name} has {encoder.dim} dimensions, {registered_dim} are registered")
    model = model or encoder.name
    table = f"{root}/vectors"
    if exists(spark, f"{root}/runs"):
        refuse_if_encoded(encode_runs(spark, root), model, split, force)
    rows = frozen(spark, corpus_root, split)
    held = manifest(spark, corpus_root)
    key, input_hash = verify_input(rows, held)

    started = time.monotonic()
    expected = expected_shards(rows, shard_rows)
    pending = expected
    if not force and exists(spark, table):
        stored = vectors(spark, table, model, split, must_exist=False)
        pending = resume_plan(expected, stored, model, split, prefix, input_hash, encoder.revision, max_tokens)
    n_pending = pending.count()
    if n_pending:
        encode_pending(rows, pending, encoder, model, split, prefix, input_hash, table,
                       batch_size, max_tokens, shard_rows, n_pending)
    seconds = time.monotonic() - started

    wanted = expected.agg(F.sum("n_rows").alias("n"), F.count("*").alias("s")).first()
    made = vectors(spark, table, model, split)
    if not stored_type_ok(made):
        raise TypeError(f"{table} does not hold 32-bit vectors")
    written = made.count()
    if written != wanted.n:
        raise ValueError(f"{written} vectors stored for {wanted.n} rows of {model}/{split}")
    flat, tree = (held.first()[f"{split}_{k}"] for k in ("hash", "tree_hash"))
    corpus_side = split == "corpus"
    run = spark.createDataFrame([(
        model, encoder.revision, split, encoder.dim, True, "float16", prefix_type, prefix,
        written, wanted.s, max_tokens, batch_size,
        flat if corpus_side else None, None if corpus_side else flat,
        tree if corpus_side else None, None if corpus_side else tree,
        round(seconds, 1), round(written / max(seconds, 1e-3), 1),
    )], schemas.ENCODE_RUNS)
    write_run(run, root, model, split)
    return run


def encode_grid(spark: SparkSession, corpus_root: str, root: str,
                jobs: list[dict]) -> DataFrame:
    """Run :func:`encode_split` for each job; a failure becomes a row, not silence.

    Each job is the keyword arguments of ``encode_split`` without the roots.
    """
    outcome = []
    for job in jobs:
        subject = f"{job.get('model') or job['encoder'].name}/{job['split']}"
        try:
            done = encode_split(spark, corpus_root, root, **job).first()
            outcome.append(("encode", subject, "OK", True, f"{done.n_rows} rows"))
        except Exception as e:  # noqa: BLE001 - reported as a failed check
            outcome.append(("encode", subject, "FAIL", False, str(e)))
    return spark.createDataFrame(outcome, schemas.CHECKS)
