"""Queries over text: freezing, fingerprints, comparison, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import registry
from rebasis.functions.text import (
    cap_tokens,
    corrupt,
    repair,
    short_name,
    slug,
    strip,
    title_and_text,
    tokens,
    with_prefix,
)
from rebasis.operators import diff
from rebasis.operators.fingerprint import flat_fingerprint, tree_fingerprint
from rebasis.operators.judgments import missing_documents, positive
from rebasis.operators.ordering import sample, shuffled_index, sorted_index
from rebasis.plans.corpus import FreezeSpec, freeze, invariants, manifest_row
from rebasis.session import fresh_path
from rebasis.sources.tables import benchmark_layout, manifest
from rebasis.workload import sql as S
from rebasis.workload import standins as st
from rebasis.workload.base import query


@query(S.with_(S.RAW, S.SAMPLED) + "SELECT query_id FROM sampled")
def query_sample(spark: SparkSession, sf: str) -> DataFrame:
    ids = positive(st.raw_qrels(spark, sf)).select("query_id").distinct()
    return sample(ids, "query_id", max(1, ids.count() // 2), stream="queries")


@query(
    f"""SELECT doc_id, r <= n // 8 AS in_small FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {S.key('doc_id', 'nested')}) AS r, count(*) OVER () AS n FROM documents)
WHERE r <= n // 2"""
)
def nested_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the documents, and which of them a sample of an eighth has: all of the smaller one."""
    ids = st.table(spark, sf, "documents").select("doc_id")
    n = ids.count()
    small_one = sample(ids, "doc_id", n // 8, stream="nested").withColumn("in_small", F.lit(True))
    large = sample(ids, "doc_id", n // 2, stream="nested")
    return large.join(small_one, "doc_id", "full_outer").select("doc_id", F.coalesce("in_small", F.lit(False)).alias("in_small"))


@query(S.with_(S.FREEZE) + "SELECT row_idx, doc_id, md5(text) AS text_md5 FROM corpus")
def corpus_freeze(spark: SparkSession, sf: str) -> DataFrame:
    return st.corpus(spark, sf).frozen.corpus.select(
        "row_idx", "doc_id", F.md5("text").alias("text_md5")
    )


@query(S.with_(S.FREEZE) + "SELECT row_idx, query_id, text FROM queries")
def frozen_queries(spark: SparkSession, sf: str) -> DataFrame:
    return st.corpus(spark, sf).frozen.queries


@query(S.with_(S.FREEZE) + "SELECT query_row, corpus_row FROM qrels")
def qrels_index(spark: SparkSession, sf: str) -> DataFrame:
    return st.corpus(spark, sf).frozen.qrels


_INVARIANTS = [
    "corpus_text_null", "corpus_text_empty", "corpus_row_range", "corpus_doc_id_unique",
    "corpus_row_idx_unique", "queries_text_null", "queries_text_empty", "queries_row_range",
    "queries_query_id_unique", "queries_row_idx_unique", "qrels_empty", "qrels_corpus_row",
    "qrels_query_row", "query_without_positive", "corpus_size",
]


@query(
    S.with_(S.FREEZE)
    + f"""SELECT n.invariant, CAST(CASE n.invariant
  WHEN 'corpus_text_null' THEN (SELECT count(*) FROM corpus WHERE text IS NULL)
  WHEN 'corpus_text_empty' THEN (SELECT count(*) FROM corpus WHERE {S.strip('text')} = '')
  WHEN 'corpus_row_range' THEN (SELECT count(*) FROM corpus WHERE row_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM corpus))
  WHEN 'corpus_doc_id_unique' THEN (SELECT count(*) - count(DISTINCT doc_id) FROM corpus)
  WHEN 'corpus_row_idx_unique' THEN (SELECT count(*) - count(DISTINCT row_idx) FROM corpus)
  WHEN 'queries_text_null' THEN (SELECT count(*) FROM queries WHERE text IS NULL)
  WHEN 'queries_text_empty' THEN (SELECT count(*) FROM queries WHERE {S.strip('text')} = '')
  WHEN 'queries_row_range' THEN (SELECT count(*) FROM queries WHERE row_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM queries))
  WHEN 'queries_query_id_unique' THEN (SELECT count(*) - count(DISTINCT query_id) FROM queries)
  WHEN 'queries_row_idx_unique' THEN (SELECT count(*) - count(DISTINCT row_idx) FROM queries)
  WHEN 'qrels_empty' THEN (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM qrels)
  WHEN 'qrels_corpus_row' THEN (SELECT count(*) FROM qrels WHERE corpus_row NOT IN (SELECT row_idx FROM corpus))
  WHEN 'qrels_query_row' THEN (SELECT count(*) FROM qrels WHERE query_row NOT IN (SELECT row_idx FROM queries))
  WHEN 'query_without_positive' THEN (SELECT count(*) FROM queries WHERE row_idx NOT IN (SELECT query_row FROM qrels))
  WHEN 'corpus_size' THEN (SELECT abs(count(*) - (SELECT count(*) // 2 FROM documents)) FROM corpus)
END AS BIGINT) AS violations, true AS passed
FROM (SELECT unnest({_INVARIANTS}) AS invariant) n"""
)
def corpus_invariants(spark: SparkSession, sf: str) -> DataFrame:
    made = st.corpus(spark, sf, written=True)
    return invariants(made.frozen, made.spec.n_docs)


def _flat(table: str, ident: str, order: str) -> str:
    return (
        f"(SELECT substr(sha256(coalesce(string_agg(concat({ident}, chr(0)), '' ORDER BY {order}), '')), 1, 16)"
        f" FROM {table})"
    )


@query(
    S.with_(S.FREEZE)
    + f"""SELECT 42 AS seed, 'documents' AS source, {_flat('corpus', 'doc_id', 'row_idx')} AS corpus_hash,
  {_flat('queries', 'query_id', 'row_idx')} AS queries_hash,
  {S.tree('corpus', 'doc_id', 'row_idx', 50000)} AS corpus_tree_hash,
  {S.tree('queries', 'query_id', 'row_idx', 50000)} AS queries_tree_hash,
  (SELECT count(*) FROM corpus) AS n_corpus, (SELECT count(*) FROM queries) AS n_queries,
  (SELECT count(*) FROM qrels) AS n_qrels, true AS ftfy_cleaned"""
)
def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    made = st.corpus(spark, sf, written=True)
    return manifest_row(made.frozen, made.spec)


@query(
    S.with_(S.FREEZE)
    + """SELECT (SELECT count(*) FROM corpus) AS n_corpus, (SELECT count(*) FROM queries) AS n_queries,
  (SELECT count(*) FROM qrels) AS n_qrels, """
    + _flat("corpus", "doc_id", "row_idx") + " AS corpus_hash"
)
def freeze_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job with its files: write, check, commit the manifest, read it back."""
    qrels = st.raw_qrels(spark, sf)
    judged = qrels.where(F.col("score") > 0).select("query_id").distinct().count()
    spec = FreezeSpec(
        max(1, judged // 2), st.table(spark, sf, "documents").count() // 2, source="documents", flat_hash=True
    )
    root = fresh_path(spark, "corpus")
    freeze(spark, st.raw_corpus(spark, sf), st.raw_queries(spark, sf), qrels, root, spec)
    return manifest(spark, root).select("n_corpus", "n_queries", "n_qrels", "corpus_hash")


@query(f"SELECT {_flat('documents', 'doc_id', 'doc_id')} AS fingerprint, (SELECT count(*) FROM documents) AS n")
def id_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return flat_fingerprint(st.table(spark, sf, "documents"), "doc_id", "doc_id")


@query(f"SELECT {S.tree('documents', 'doc_id', 'doc_id', 100)} AS fingerprint, (SELECT count(*) FROM documents) AS n")
def id_fingerprint_tree(spark: SparkSession, sf: str) -> DataFrame:
    return tree_fingerprint(st.table(spark, sf, "documents"), "doc_id", "doc_id", chunk=100)


@query(
    f"""SELECT row_number() OVER (ORDER BY {S.key('doc_id', 'shuffle')}) - 1 AS row_idx, doc_id
FROM documents"""
)
def shuffled_rows(spark: SparkSession, sf: str) -> DataFrame:
    return shuffled_index(st.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS row_idx, CAST(doc_id AS VARCHAR) AS doc_id FROM documents")
def sorted_rows(spark: SparkSession, sf: str) -> DataFrame:
    ids = st.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"))
    return sorted_index(ids, ["doc_id"])


@query(
    S.with_(S.RAW)
    + """SELECT DISTINCT corpus_id FROM judged_all
WHERE corpus_id NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)"""
)
def missing_positives(spark: SparkSession, sf: str) -> DataFrame:
    """Judged documents absent from a corpus of the labelled documents only."""
    labelled = st.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    return missing_documents(positive(st.raw_qrels(spark, sf)), labelled)


def _edited(docs: DataFrame) -> DataFrame:
    """German texts changed, one source removed, another source's rows added again."""
    text = F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    kept = docs.where(F.col("source") != "src3").select("doc_id", text.alias("text"))
    added = docs.where(F.col("source") == "src5").select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    return kept.unionByName(added).withColumn("name", F.col("doc_id").cast("string"))


_EDITED = """
edited AS (
  SELECT doc_id, CASE WHEN lang = 'de' THEN concat(text, '!') ELSE text END AS text
  FROM documents WHERE source <> 'src3'
  UNION ALL SELECT -1 - doc_id, text FROM documents WHERE source = 'src5'),
differences AS (
  SELECT coalesce(d.doc_id, e.doc_id) AS doc_id,
         CASE WHEN d.doc_id IS NULL THEN 'added' WHEN e.doc_id IS NULL THEN 'removed'
              WHEN d.text IS DISTINCT FROM e.text THEN 'text' END AS kind,
         d.text AS left_text, e.text AS right_text
  FROM documents d FULL OUTER JOIN edited e ON d.doc_id = e.doc_id)"""


def _both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = st.table(spark, sf, "documents")
    return docs.select("doc_id", "text", F.col("doc_id").cast("string").alias("name")), _edited(docs)


@query(
    S.with_(_EDITED)
    + """SELECT (SELECT count(*) FROM documents) AS n_left, (SELECT count(*) FROM edited) AS n_right,
  NOT bool_or(coalesce(kind IN ('added', 'removed'), false)) AS ids_equal,
  bool_and(kind IS NULL) AS texts_equal, count(kind) AS n_different FROM differences"""
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _both(spark, sf)
    return diff.snapshot_diff(left, right, "doc_id", "name")


@query(S.with_(_EDITED) + "SELECT doc_id, kind FROM differences WHERE kind IS NOT NULL")
def snapshot_rows(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _both(spark, sf)
    return diff.row_differences(left, right, "doc_id", "name").select("doc_id", "kind")


@query(
    S.with_(_EDITED)
    + """SELECT doc_id, kind, substr(left_text, 1, 120) AS left_text, substr(right_text, 1, 120) AS right_text
FROM differences WHERE kind IS NOT NULL ORDER BY doc_id LIMIT 5"""
)
def snapshot_examples(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _both(spark, sf)
    return diff.examples(diff.row_differences(left, right, "doc_id", "name"), key="doc_id")


@query(
    S.with_(_EDITED)
    + """SELECT doc_id, CASE kind WHEN 'added' THEN 'target' ELSE 'source' END AS only_in
FROM differences WHERE kind IN ('added', 'removed')"""
)
def alignment_gaps(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _both(spark, sf)
    return diff.alignment_gaps(left, right, "doc_id")


@query(
    f"""SELECT doc_id, md5({S.strip(S.strip("concat('  ', source, ' ')") + " || ' ' || " + S.strip('text'))}) AS text_md5
FROM documents"""
)
def title_join(spark: SparkSession, sf: str) -> DataFrame:
    docs = st.texts(spark, sf).withColumn("title", F.concat(F.lit("  "), "source", F.lit(" ")))
    return docs.select("doc_id", F.md5(title_and_text("text", "title")).alias("text_md5"))


# No-break space, ideographic space, vertical tab, next line, unit separator.
_SPACES = [0xA0, 0x3000, 0x0B, 0x85, 0x1F]


@query(f"SELECT doc_id, md5({S.strip('text')}) AS text_md5 FROM documents")
def unicode_trim(spark: SparkSession, sf: str) -> DataFrame:
    """Texts padded with unusual spaces; trimming gives what plain texts give."""
    pad = F.lit("".join(map(chr, _SPACES)))
    docs = st.texts(spark, sf)
    return docs.select("doc_id", F.md5(strip(F.concat(pad, "text", pad))).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def mojibake_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Corrupted texts, repaired; the twin states the original."""
    docs = st.texts(spark, sf)
    return docs.select("doc_id", F.md5(repair(corrupt("text"))).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def repair_clean_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without defects come through the repair unchanged."""
    docs = st.texts(spark, sf)
    return docs.select("doc_id", F.md5(repair("text")).alias("text_md5"))


_MODEL_ROWS = ", ".join(
    "('{}', '{}', '{}')".format(m[0], m[2]["query"], m[2]["doc"]) for m in registry.MODELS
)


@query(
    f"""WITH models AS (SELECT * FROM (VALUES {_MODEL_ROWS}) t(model, query_prefix, doc_prefix)),
named AS (SELECT list(model ORDER BY model) AS names FROM models),
asked AS (
  SELECT doc_id, text, source, CASE WHEN lang = 'en' THEN 'doc' ELSE 'query' END AS side,
         names[CAST(substr(source, 4) AS INT) % len(names) + 1] AS model
  FROM documents, named)
SELECT doc_id, model, side, md5(concat(CASE
    WHEN model LIKE 'Qwen/Qwen3-Embedding%' AND side = 'query' AND source = 'src4' THEN 'Query: '
    WHEN side = 'query' THEN query_prefix ELSE doc_prefix END, text)) AS text_md5
FROM asked JOIN models USING (model)"""
)
def prefix_text(spark: SparkSession, sf: str) -> DataFrame:
    """Each document under one registered model and side, with the prefix that applies.

    One source stands for a model that brings its own query prompt.
    """
    models = registry.models(spark)
    names = sorted(m[0] for m in registry.MODELS)
    place = F.substring("source", 4, 9).cast("int") % len(names) + 1
    asked = st.table(spark, sf, "documents").select(
        "doc_id", "text", "source",
        F.when(F.col("lang") == "en", "doc").otherwise("query").alias("side"),
        F.element_at(F.array(*map(F.lit, names)), place).alias("model"),
    )
    own = F.when(F.col("source") == "src4", F.lit("Query: "))
    joined = asked.join(models.select("model", "prefix"), "model")
    prefix = registry.effective_prefix(own)
    return joined.select(
        "doc_id", "model", "side", F.md5(with_prefix(prefix, "text")).alias("text_md5")
    )


@query(
    """SELECT lang || '/' || source AS name, lang || '_' || source AS slug, substr(source, 1, 18) AS short,
  count(*) AS n FROM documents GROUP BY lang, source"""
)
def slug_names(spark: SparkSession, sf: str) -> DataFrame:
    named = st.table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("n")).select(
        "name", slug("name").alias("slug"), short_name("name").alias("short"), "n"
    )


_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"


@query(
    f"""SELECT doc_id, len(w) AS n_tokens, md5(array_to_string(w[1:512], ' ')) AS kept_md5
FROM (SELECT doc_id, {_WORDS} AS w FROM documents)"""
)
def input_cap(spark: SparkSession, sf: str) -> DataFrame:
    """The model's input limit of 512 tokens, as an operator."""
    docs = st.texts(spark, sf)
    return docs.select(
        "doc_id",
        F.size(tokens("text")).cast("bigint").alias("n_tokens"),
        F.md5(cap_tokens("text", registry.MAX_TOKENS)).alias("kept_md5"),
    )


@query(
    S.with_(S.RAW)
    + """SELECT query_id, CAST(q.text IS NOT NULL AS BOOLEAN) AS has_query, count(*) AS n_docs,
  CAST(sum(r.score) AS BIGINT) AS total_rel, CAST(sum(length(c.text)) AS BIGINT) AS n_chars
FROM raw_qrels r JOIN raw_corpus c ON c._id = r.corpus_id LEFT JOIN raw_queries q ON q._id = r.query_id
GROUP BY ALL"""
)
def benchmark_layout_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Corpus and queries as JSON lines and judgments as TSV, written and read back."""
    root = fresh_path(spark, "benchmark")
    st.raw_corpus(spark, sf).write.json(f"{root}/corpus.jsonl")
    st.raw_queries(spark, sf).write.json(f"{root}/queries.jsonl")
    st.raw_qrels(spark, sf).select(
        F.col("query_id").alias("query-id"), F.col("corpus_id").alias("corpus-id"), "score"
    ).write.csv(f"{root}/qrels/test.tsv", sep="\t", header=True)
    docs, asked, graded = benchmark_layout(spark, root)
    return (
        graded.join(docs.select(F.col("_id").alias("doc_id"), F.length("text").alias("n")), "doc_id")
        .join(asked.select(F.col("_id").alias("query_id"), F.lit(True).alias("found")), "query_id", "left")
        .groupBy("query_id", F.coalesce("found", F.lit(False)).alias("has_query"))
        .agg(F.count("*").alias("n_docs"), F.sum("rel").alias("total_rel"), F.sum("n").alias("n_chars"))
    )
