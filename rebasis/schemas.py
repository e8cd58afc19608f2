"""Declared schemas of every table this package reads or writes."""

from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "ARRAY<FLOAT>": T.ArrayType(T.FloatType()),
    "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType()),
    "MAP<STRING,STRING>": T.MapType(T.StringType(), T.StringType()),
}


def struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..." without a running session."""
    pairs = (c.rsplit(" ", 1) for c in columns.split(", "))
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


RAW_CORPUS = struct("_id STRING, title STRING, text STRING")
RAW_QUERIES = struct("_id STRING, text STRING")
RAW_QRELS = struct("query_id STRING, corpus_id STRING, score INT")

CORPUS = struct("row_idx BIGINT, doc_id STRING, text STRING")
QUERIES = struct("row_idx BIGINT, query_id STRING, text STRING")
QRELS = struct("query_row BIGINT, corpus_row BIGINT")

MANIFEST = struct(
    "seed INT, source STRING, corpus_hash STRING, queries_hash STRING, "
    "corpus_tree_hash STRING, queries_tree_hash STRING, "
    "n_corpus BIGINT, n_queries BIGINT, n_qrels BIGINT, ftfy_cleaned BOOLEAN"
)

# model, split and shard_id are directories of the stored table.
VECTORS = struct(
    "row_idx BIGINT, embedding ARRAY<FLOAT>, prefix STRING, input_hash STRING, "
    "revision STRING, max_tokens INT, "
    "model STRING, split STRING, shard_id BIGINT"
)

ENCODE_RUNS = struct(
    "model STRING, revision STRING, split STRING, dim INT, normalized BOOLEAN, "
    "dtype STRING, prefix_type STRING, prefix STRING, n_rows BIGINT, n_shards INT, "
    "max_seq_length INT, batch_size INT, corpus_hash STRING, queries_hash STRING, "
    "corpus_tree_hash STRING, queries_tree_hash STRING, "
    "seconds DOUBLE, rows_per_sec DOUBLE"
)

MODELS = struct(
    "model STRING, dim INT, prefix MAP<STRING,STRING>, batch_size INT, "
    "large_batch_size INT, prefix_testable BOOLEAN"
)

EXPECTED_METRICS = struct(
    "model STRING, ndcg_at_10 DOUBLE, source STRING, scale STRING, tolerance DOUBLE"
)

PAIR_RESULTS = struct(
    "source STRING, target STRING, method STRING, src_dim INT, tgt_dim INT, "
    "train_docs BIGINT, test_docs BIGINT, test_qrels BIGINT, test_queries BIGINT, "
    "recall_at_10_translated DOUBLE, recall_at_10_native_target DOUBLE, ratio DOUBLE, "
    "train_seconds DOUBLE, seed INT, train_queries STRING, map_rank INT, "
    "solve_seconds DOUBLE, aggregate_seconds DOUBLE"
)

CEILINGS = struct("model STRING, recall_at_10 DOUBLE")

CHECKS = struct("check_name STRING, subject STRING, status STRING, passed BOOLEAN, detail STRING")
