"""Queries over encoding, audits and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebasis import registry, schemas
from rebasis.operators import encode as E
from rebasis.operators import metrics as M
from rebasis.operators.retrieve import top_k
from rebasis.plans import audits as A
from rebasis.plans.corpus import Frozen, FreezeSpec, freeze, load, manifest_row
from rebasis.plans.encoding import encode_grid
from rebasis.plans.reports import encode_summary
from rebasis.session import fresh_path, stored
from rebasis.sources import tables as src
from rebasis.sources.vectors import stored_shapes, vectors
from rebasis.streaming.encode_stream import encode_new_files
from rebasis.workload import sql as S
from rebasis.workload import standins as st
from rebasis.workload.base import query

ENCODER = E.HashedTermEncoder(256)


def _sparse(df: DataFrame, ident: str, digits: int = 6) -> DataFrame:
    return df.select(ident, F.posexplode("embedding").alias("bucket", "w")).where("w <> 0").select(
        ident, "bucket", F.round(F.col("w").cast("double"), digits).alias("w")
    )


@query(
    S.with_(S.terms("documents", "doc_id", "text", "t"))
    + "SELECT doc_id, bucket, round(w, 6) AS w FROM t"
)
def encode_hashed_tf(spark: SparkSession, sf: str) -> DataFrame:
    return _sparse(E.encode(st.texts(spark, sf), ENCODER), "doc_id")


_TEXT_RANKED = (
    S.terms("documents", "doc_id", "text", "dt") + ","
    + S.terms("benchmark", "item_id", "text", "qt") + """,
ranked AS (
  SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT item_id, doc_id, round(sum(q.w * d.w), 6) AS score FROM qt q JOIN dt d USING (bucket) GROUP BY ALL))
  WHERE rank <= 10),
graded AS (
  SELECT b.item_id, d.doc_id, 1 + coalesce(l.quality, 0) AS rel
  FROM documents d JOIN benchmark b ON contains(d.text, b.text) LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
)


def _text_ranked(spark: SparkSession, sf: str, encoder: E.Encoder = ENCODER) -> DataFrame:
    docs = E.encode(st.texts(spark, sf).select("doc_id", "text"), encoder)
    asked = E.encode(st.table(spark, sf, "benchmark"), encoder)
    return top_k(docs, asked, doc_id="doc_id", query_id="item_id")


def _text_graded(spark: SparkSession, sf: str) -> DataFrame:
    labels = st.table(spark, sf, "labels").select("doc_id", "quality")
    graded = st.contained(spark, sf).join(labels, "doc_id", "left").select(
        "item_id", "doc_id", (F.coalesce("quality", F.lit(0)) + 1).alias("rel")
    )
    # as raw_qrels: ideal and gained sums would each search the texts again
    return stored(graded, "graded")


@query(S.with_(_TEXT_RANKED) + "SELECT item_id, rank, doc_id, score FROM ranked")
def text_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return _text_ranked(spark, sf)


@query(
    S.with_(_TEXT_RANKED)
    + """SELECT round(avg(r), 6) AS recall, count(*) AS n_queries FROM (
  SELECT count(r.rank) / count(*) AS r FROM graded g
  LEFT JOIN ranked r ON r.item_id = g.item_id AND r.doc_id = g.doc_id GROUP BY g.item_id)"""
)
def text_retrieval_recall(spark: SparkSession, sf: str) -> DataFrame:
    return M.macro_recall(
        _text_graded(spark, sf), _text_ranked(spark, sf), "item_id", "doc_id"
    ).withColumn("recall", F.round("recall", 6))


# Shards of 100 rows, so that small tables have several.
ROWS = 100

_STORED = f"""
stored AS (SELECT vec_id AS row_idx, vec_id // {ROWS} AS shard_id FROM embeddings)"""


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    rows = st.base_vectors(spark, sf).select(
        F.lit("studio/base").alias("model"), F.lit("corpus").alias("split"), "row_idx", "embedding",
        E.shard_of("row_idx", ROWS).alias("shard_id"),
    )
    return stored(rows, "vectors", ("model", "split"))


@query(
    f"""SELECT vec_id // {ROWS} AS shard_id, count(*) AS n_rows, min(vec_id) AS first_row, max(vec_id) AS last_row
FROM embeddings GROUP BY 1"""
)
def shard_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stored by shard directory and read back."""
    from rebasis.sinks.tables import write_vectors

    root = fresh_path(spark, "vectors")
    kept = _stored(spark, sf).withColumn("prefix", F.lit("")).withColumn("input_hash", F.lit("h"))
    write_vectors(kept, root, ROWS)
    return vectors(spark, root, "studio/base", "corpus").groupBy("shard_id").agg(
        F.count("*").alias("n_rows"), F.min("row_idx").alias("first_row"), F.max("row_idx").alias("last_row")
    )


@query(
    f"""SELECT shard_id, count(*) AS n_rows FROM (SELECT vec_id // {ROWS} AS shard_id FROM embeddings)
WHERE shard_id IN (1, 2, 3, 4) GROUP BY shard_id"""
)
def resume_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Shard 1 is missing, shard 2 lacks its first row, shard 3 has another prefix, shard 4 another revision."""
    rows = st.base_vectors(spark, sf)
    shard = F.col("shard_id")
    held = (
        _stored(spark, sf)
        .where((shard != 1) & (F.col("row_idx") != 2 * ROWS))
        .withColumn("prefix", F.when(shard == 3, "query: ").otherwise("passage: "))
        .withColumn("input_hash", F.lit("h"))
        .withColumn("revision", F.when(shard == 4, "0").otherwise("1"))
        .withColumn("max_tokens", F.lit(None).cast("int"))
    )
    return E.resume_plan(
        E.expected_shards(rows, ROWS), held, "studio/base", "corpus", "passage: ", "h", "1"
    )


@query(
    S.with_(_STORED)
    + """SELECT 'studio/base' AS model, 'corpus' AS split, count(DISTINCT shard_id) AS n_shards, count(*) AS n_rows,
  (SELECT count(*) FROM embeddings) AS expected_rows, 'OK' AS status FROM stored"""
)
def totals_audit(spark: SparkSession, sf: str) -> DataFrame:
    expected = st.base_vectors(spark, sf).agg(
        F.lit("corpus").alias("split"), F.count("*").alias("expected_rows")
    )
    return A.totals_audit(_stored(spark, sf), expected)


def _audited(spark: SparkSession, sf: str) -> DataFrame:
    """The stand-in vectors; one rotated vector is cut short and label-0 base vectors are zero."""
    found = st.vectors(spark, sf)
    labels = st.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_idx"), "label")
    zero = (F.col("model") == "studio/base") & (F.col("split") == "corpus") & (F.col("label") == 0)
    short = (F.col("model") == "studio/rotated") & (F.col("split") == "corpus") & (F.col("row_idx") == 0)
    changed = (
        F.when(zero, F.transform("embedding", lambda x: F.lit(0.0).cast("float")))
        .when(short, F.slice("embedding", 1, 63))
        .otherwise(F.col("embedding"))
    )
    return found.join(labels, "row_idx").withColumn("embedding", changed).drop("label")


def _registered(spark: SparkSession) -> DataFrame:
    rows = [(m, d, {"query": "", "doc": ""}, 256, 512, False) for m, d in st.MODELS.items()]
    absent = ("studio/absent", 64, {"query": "", "doc": ""}, 256, 512, False)
    return spark.createDataFrame([*rows, absent], schemas.MODELS)


@query(
    S.with_(S._ASKED)
    + """SELECT model, split, expected,
  CASE WHEN model = 'studio/absent' THEN NULL WHEN model = 'studio/rotated' AND split = 'corpus' THEN 63 ELSE expected END AS min_dim,
  CASE WHEN model = 'studio/absent' THEN NULL ELSE expected END AS max_dim,
  CASE WHEN model = 'studio/absent' THEN 0 WHEN split = 'corpus' THEN (SELECT count(*) FROM embeddings)
       ELSE (SELECT count(*) FROM asked) END AS n_rows,
  CASE WHEN model = 'studio/base' AND split = 'corpus' THEN (SELECT count(*) FROM embeddings WHERE label = 0) ELSE 0 END AS n_zero,
  CAST(0 AS BIGINT) AS n_nan,
  CASE WHEN model = 'studio/absent' THEN 'SKIP' WHEN model = 'studio/rotated' AND split = 'corpus' THEN 'FAIL' ELSE 'OK' END AS status
FROM (VALUES ('studio/base', 64), ('studio/rotated', 64), ('studio/extended', 96), ('studio/absent', 64)) m(model, expected),
     (VALUES ('corpus'), ('queries')) s(split)"""
)
def dim_audit(spark: SparkSession, sf: str) -> DataFrame:
    return A.dim_audit(_audited(spark, sf), _registered(spark))


@query(
    S.with_(S._ASKED)
    + """SELECT model, split, CASE split WHEN 'corpus' THEN (SELECT count(*) FROM embeddings) ELSE (SELECT count(*) FROM asked) END AS n_rows,
  dim AS min_dim, dim AS max_dim, CAST(0 AS BIGINT) AS n_zero, CAST(0 AS BIGINT) AS n_nan
FROM (VALUES ('studio/base', 64), ('studio/rotated', 64), ('studio/extended', 96)) m(model, dim),
     (VALUES ('corpus'), ('queries')) s(split)"""
)
def vector_shapes(spark: SparkSession, sf: str) -> DataFrame:
    return stored_shapes(st.vectors(spark, sf))


@query("SELECT 'hashed-terms-256' AS model, count(*) AS n_texts, CAST(1 AS DOUBLE) AS min_cosine, CAST(1 AS DOUBLE) AS mean_cosine, 'OK' AS status FROM documents")
def determinism_audit(spark: SparkSession, sf: str) -> DataFrame:
    docs = st.texts(spark, sf)
    return A.determinism_audit(docs, ENCODER, "passage: ").withColumns(
        {c: F.round(c, 6) for c in ("min_cosine", "mean_cosine")}
    )


def _cosine_sql(q: str, d: str) -> str:
    return (
        f"SELECT p.item_id, sum({q}.w * {d}.w) AS c FROM pairs p JOIN {q} ON {q}.item_id = p.item_id "
        f"JOIN {d} ON {d}.doc_id = p.doc_id AND {d}.bucket = {q}.bucket GROUP BY p.item_id"
    )


@query(
    S.with_(
        "pairs AS (SELECT b.item_id, min(d.doc_id) AS doc_id FROM documents d "
        "JOIN benchmark b ON contains(d.text, b.text) GROUP BY b.item_id)",
        "docs AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM pairs))",
        S.terms("benchmark", "item_id", "concat('query: ', text)", "qw"),
        S.terms("docs", "doc_id", "concat('passage: ', text)", "dw"),
        S.terms("benchmark", "item_id", "text", "qr"),
        S.terms("docs", "doc_id", "text", "dr"),
        f"w AS ({_cosine_sql('qw', 'dw')})",
        f"r AS ({_cosine_sql('qr', 'dr')})",
    )
    + """SELECT 'hashed-terms-256' AS model, count(*) AS n_pairs, round(avg(w.c), 6) AS with_prefix,
  round(avg(r.c), 6) AS without_prefix, round(avg(w.c) - avg(r.c), 6) AS gap,
  CASE WHEN avg(w.c) - avg(r.c) > 0.005 THEN 'OK' ELSE 'WARN' END AS status FROM w JOIN r USING (item_id)"""
)
def prefix_gap(spark: SparkSession, sf: str) -> DataFrame:
    """Prefixes of one registered model, over every judged passage."""
    models = registry.models(spark)
    name = "intfloat/e5-base-v2"
    judged = st.contained(spark, sf).select(
        F.col("item_id").alias("query_row"), F.col("doc_id").alias("corpus_row")
    )
    qrels = stored(judged, "qrels")
    asked = st.table(spark, sf, "benchmark").withColumnRenamed("item_id", "row_idx")
    docs = st.table(spark, sf, "documents").withColumnRenamed("doc_id", "row_idx")
    return A.prefix_audit(
        qrels, asked, docs, ENCODER, registry.prefix_for(models, name, "query"),
        registry.prefix_for(models, name, "doc"), n_queries=None,
    ).withColumns({c: F.round(c, 6) for c in ("with_prefix", "without_prefix", "gap")})


_NDCG = S.with_(_TEXT_RANKED, S.ndcg("graded", "ranked", "item_id", "doc_id"))


@query(
    _NDCG
    + """, m AS (SELECT round(avg(ndcg), 6) AS ndcg FROM ndcgs)
SELECT model, ndcg, e AS expected, round(abs(ndcg - e), 6) AS diff,
  CASE WHEN e IS NULL THEN '??' WHEN abs(ndcg - e) < 0.02 THEN 'OK' ELSE 'FAIL' END AS status
FROM m, (VALUES ('terms/near', 1), ('terms/far', 2), ('terms/unlisted', 3)) t(model, n),
  LATERAL (SELECT CASE n WHEN 1 THEN ndcg + 0.01 WHEN 2 THEN ndcg + 0.5 END AS e)"""
)
def metric_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """One measured NDCG against expectations that are near, far (by slug) and missing."""
    value = M.ndcg(_text_graded(spark, sf), _text_ranked(spark, sf), "item_id", "doc_id").select(
        F.round("ndcg", 6).alias("ndcg")
    ).first().ndcg
    text = src.expected_json({"terms/near": value + 0.01, "terms_far": value + 0.5})
    path = fresh_path(spark, "expected")
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    measured = spark.createDataFrame(
        [(m, value) for m in ("terms/near", "terms/far", "terms/unlisted")], "model string, ndcg double"
    )
    return A.metric_audit(measured, src.expected_metrics(spark, path)).withColumn(
        "diff", F.round("diff", 6)
    )


_KEYED_RANKED = _TEXT_RANKED.replace("ORDER BY score DESC, doc_id", f"ORDER BY score DESC, {S.key('doc_id', 'shuffle')}")


@query(
    S.with_(_KEYED_RANKED, S.ndcg("graded", "ranked", "item_id", "doc_id"))
    + "SELECT 'hashed-terms-256' AS model, round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM ndcgs"
)
def benchmark_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    """NDCG from raw tables with string ids; equal scores rank in row order."""
    docs = st.raw_corpus(spark, sf).drop("title")
    graded = _text_graded(spark, sf).select(
        F.col("item_id").cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("doc_id"), "rel"
    )
    return A.benchmark_ndcg(docs, st.raw_queries(spark, sf), graded, ENCODER).withColumn(
        "ndcg", F.round("ndcg", 6)
    )


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Encode sidecars as if each document source were a model: sizes from the documents."""
    docs = st.table(spark, sf, "documents")
    made = docs.groupBy(F.concat_ws("/", "lang", "source").alias("model")).agg(
        F.count("*").alias("n_rows"), (F.sum("n_chars") / 1000.0).alias("seconds"),
        F.sha2(F.max("source"), 256).alias("h"),
    )
    known = {
        "model": F.col("model"), "split": F.lit("corpus"), "dim": F.lit(256), "n_rows": F.col("n_rows"),
        "seconds": F.col("seconds"), "corpus_hash": F.substring("h", 1, 16),
        "n_shards": F.lit(1), "prefix": F.lit(""),
    }
    return made.select(*(
        known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.ENCODE_RUNS
    ))


@query(
    """SELECT lang || '_' || source AS model, 'corpus' AS split, count(*) AS n_rows, 256 AS dim,
  round(count(*) / (sum(n_chars) / 1000.0), 1) AS rows_per_sec FROM documents GROUP BY lang, source"""
)
def encode_run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Sidecars written as JSON, found by glob, and summed up."""
    root = fresh_path(spark, "runs")
    _runs(spark, sf).write.json(root)
    return encode_summary(src.sidecars(spark, f"{root}/*.json").drop("sidecar"))


_HELD = S.tree("corpus", "doc_id", "row_idx", registry.SHARD_ROWS)
_CUT = S.tree(
    "(SELECT * FROM corpus WHERE row_idx < (SELECT max(row_idx) FROM corpus))", "doc_id", "row_idx", registry.SHARD_ROWS
)
_ASKED_TREE = S.tree("queries", "query_id", "row_idx", registry.SHARD_ROWS)


@query(
    S.with_(S.FREEZE)
    + f"""SELECT against, split, kind,
  CASE WHEN split || '_tree_hash' = kind THEN CASE split WHEN 'corpus' THEN {_HELD} ELSE {_ASKED_TREE} END END AS claimed,
  CASE kind WHEN 'queries_tree_hash' THEN {_ASKED_TREE} WHEN 'corpus_tree_hash' THEN
    CASE against WHEN 'same' THEN {_HELD} ELSE {_CUT} END END AS recorded,
  CASE WHEN split || '_tree_hash' <> kind THEN 'SKIP' WHEN against = 'other' AND split = 'corpus' THEN 'FAIL' ELSE 'OK' END AS status
FROM (SELECT unnest(['same', 'other']) AS against), (SELECT unnest(['corpus', 'queries']) AS split),
  (SELECT unnest(['corpus_hash', 'queries_hash', 'corpus_tree_hash', 'queries_tree_hash']) AS kind)"""
)
def hash_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Real sidecars against their own manifest, and that of a corpus without its last document."""
    root, store = _encoded(spark, sf)
    runs = src.encode_runs(spark, store).drop("sidecar")
    tables = load(spark, root)
    last = tables.corpus.agg(F.max("row_idx")).first()[0]
    other = manifest_row(Frozen(tables.corpus.where(F.col("row_idx") < last), tables.queries, tables.qrels), FreezeSpec())
    both = [A.hash_audit(runs, held).withColumn("against", F.lit(name))
            for name, held in (("same", src.manifest(spark, root)), ("other", other))]
    return both[0].unionByName(both[1]).select("against", "split", "kind", "claimed", "recorded", "status")


@query(
    """SELECT c AS check_name, n AS n_subjects, p AS n_passed, f AS n_failed, u AS n_unknown, p = n AS passed FROM (VALUES
  ('broken', 1, 0, 1, 0), ('determinism', 1, 1, 0, 0), ('dim', 8, 5, 1, 2), ('totals', 1, 1, 0, 0)) t(c, n, p, f, u)
WHERE (SELECT count(*) FROM embeddings) > 0"""
)
def check_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The check runner over three audits and one check that raises."""

    def broken() -> DataFrame:
        raise RuntimeError("no such model")

    model_split = F.concat_ws("/", "model", "split")
    rows = st.table(spark, sf, "embeddings").agg(
        F.lit("corpus").alias("split"), F.count("*").alias("expected_rows")
    )
    checks = {
        "dim": lambda: A.as_checks(
            "dim", A.dim_audit(_audited(spark, sf), _registered(spark)), model_split, F.col("min_dim")
        ),
        "totals": lambda: A.as_checks(
            "totals", A.totals_audit(_stored(spark, sf), rows), model_split, F.col("n_rows")
        ),
        "determinism": lambda: A.as_checks(
            "determinism", A.determinism_audit(st.texts(spark, sf), ENCODER),
            F.col("model"), F.col("min_cosine"),
        ),
        "broken": broken,
    }
    counts = ("n_subjects", "n_passed", "n_failed", "n_unknown")
    return A.summary(A.run_checks(spark, checks)).select(
        "check_name", *(F.col(c).cast("int").alias(c) for c in counts),
        F.coalesce("passed", F.lit(False)).alias("passed"),
    )


@query(
    S.with_(S.FREEZE)
    + """SELECT 'hashed-terms-256' AS model, split, 256 AS dim, n AS n_rows, prefix,
  CAST((n + 99) // 100 AS INT) AS n_shards, true AS normalized, 'float16' AS dtype
FROM (VALUES ('corpus', 'passage: '), ('queries', 'query: ')) t(split, prefix),
  LATERAL (SELECT CASE split WHEN 'corpus' THEN (SELECT count(*) FROM corpus) ELSE (SELECT count(*) FROM queries) END AS n)"""
)
def encode_job(spark: SparkSession, sf: str) -> DataFrame:
    """Freeze, verify, encode both splits in shards of 100 rows, and read the sidecars back."""
    return src.encode_runs(spark, _encoded(spark, sf)[1]).select(
        "model", "split", "dim", "n_rows", "prefix", "n_shards", "normalized", "dtype"
    )


def _encoded(spark: SparkSession, sf: str) -> tuple[str, str]:
    """The folders of a frozen corpus and of its encoded splits."""
    root, store = fresh_path(spark, "corpus"), fresh_path(spark, "encoded")
    qrels = st.raw_qrels(spark, sf)
    judged = qrels.where(F.col("score") > 0).select("query_id").distinct().count()
    spec = FreezeSpec(
        max(1, judged // 2), st.table(spark, sf, "documents").count() // 2, source="documents"
    )
    freeze(spark, st.raw_corpus(spark, sf), st.raw_queries(spark, sf), qrels, root, spec)
    jobs = [
        {"split": "corpus", "encoder": ENCODER, "prefix_type": "doc", "prefix": "passage: ", "shard_rows": ROWS},
        {"split": "queries", "encoder": ENCODER, "prefix_type": "query", "prefix": "query: ", "shard_rows": ROWS},
    ]
    failed = encode_grid(spark, root, store, jobs).where(~F.col("passed")).collect()
    if failed:
        raise RuntimeError(str(failed))
    return root, store


@query(
    S.with_(
        S.terms("documents", "doc_id", "text", "t"),
        f"h AS (SELECT doc_id, bucket, {S.half('w')} AS w FROM t)",
    )
    + "SELECT doc_id, count(*) AS n_buckets, round(sum(w), 4) AS total FROM h GROUP BY doc_id"
)
def stream_encode(spark: SparkSession, sf: str) -> DataFrame:
    """All documents through the streaming encode and back from the vector table; vectors are 16-bit values."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
    out, state = fresh_path(spark, "stream"), fresh_path(spark, "stream-state")
    encode_new_files(spark, f"{sf}/documents*.parquet", schema, out, state, ENCODER)
    values = F.col("embedding").cast("array<double>")
    return vectors(spark, out, ENCODER.name, "corpus").select(
        F.col("row_idx").alias("doc_id"),
        F.size(F.filter(values, lambda x: x != 0)).cast("bigint").alias("n_buckets"),
        F.round(F.aggregate(values, F.lit(0.0), lambda s, x: s + x), 4).alias("total"),
    )
