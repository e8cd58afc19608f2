"""Freeze a retrieval corpus: queries first, then the documents they point at."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import schemas
from rebasis.functions.text import repair, strip, title_and_text
from rebasis.operators.fingerprint import flat_fingerprint, tree_fingerprint
from rebasis.operators.judgments import missing_documents, positive, to_rows
from rebasis.operators.ordering import Cut, find_cut, shuffled_index, sorted_index
from rebasis.registry import N_DOCS, N_QUERIES, SEED
from rebasis.session import small
from rebasis.sinks.tables import refuse_if_frozen, write_manifest, write_table
from rebasis.sources.tables import frozen


@dataclass(frozen=True)
class FreezeSpec:
    n_queries: int = N_QUERIES
    n_docs: int = N_DOCS
    seed: int = SEED
    source: str = ""
    clean_text: bool = True
    flat_hash: bool = False


@dataclass
class Chosen:
    """What a freeze takes from the raw tables, before rows are numbered."""

    documents: DataFrame
    queries: DataFrame
    judged: DataFrame
    missing: DataFrame
    n_judged: int
    n_positives: int
    query_cut: Cut
    distractor_cut: Cut


def choose(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, spec: FreezeSpec) -> Chosen:
    """Sample queries among the judged ones, keep their positives, fill up with distractors."""
    corpus = corpus.withColumn("_id", F.col("_id").cast("string"))
    queries = queries.withColumn("_id", F.col("_id").cast("string"))
    judged = positive(qrels)
    query_cut = find_cut(
        judged.select("query_id").distinct(), "query_id", spec.n_queries, spec.seed, "queries"
    )
    judged = judged.where(query_cut.keeps("query_id"))
    n_judged = judged.count()
    # at most one row per judgment, and at most n_queries ids below
    wanted = small(
        judged.select(F.col("corpus_id").alias("_id")).distinct().withColumn("_pos", F.lit(True)),
        n_judged,
    )
    n_positives = corpus.select("_id").join(wanted, "_id", "left_semi").count()
    n_distractors = spec.n_docs - n_positives
    if n_distractors < 0:
        raise ValueError(
            f"{n_positives} positives exceed n_docs={spec.n_docs}; raise it or lower n_queries"
        )
    pool = corpus.select("_id").join(wanted, "_id", "left_anti")
    distractor_cut = find_cut(pool, "_id", n_distractors, spec.seed, "distractors")
    # one scan: positives and the distractors below the cut
    documents = (
        corpus.join(wanted, "_id", "left")
        .where(F.col("_pos").isNotNull() | distractor_cut.keeps("_id"))
        .drop("_pos")
    )
    asked = small(judged.select(F.col("query_id").alias("_id")).distinct(), spec.n_queries)
    taken = queries.join(asked, "_id", "left_semi")
    missing = missing_documents(judged, corpus.withColumnRenamed("_id", "doc_id"), n_judged)
    return Chosen(
        documents, taken, judged, missing, n_judged, n_positives, query_cut, distractor_cut
    )


def indexed_corpus(chosen: Chosen, spec: FreezeSpec) -> DataFrame:
    documents = chosen.documents
    title = "title" if "title" in documents.columns else None
    text = title_and_text("text", title)
    return shuffled_index(
        documents.select(
            F.col("_id").alias("doc_id"), (repair(text) if spec.clean_text else text).alias("text")
        ),
        "doc_id", spec.seed,
    )


def indexed_queries(chosen: Chosen, spec: FreezeSpec) -> DataFrame:
    text = repair("text") if spec.clean_text else F.col("text")
    return sorted_index(
        chosen.queries.select(F.col("_id").alias("query_id"), text.alias("text")),
        ["query_id"],
    )


@dataclass
class Frozen:
    corpus: DataFrame
    queries: DataFrame
    qrels: DataFrame
    missing: DataFrame | None = None


def frozen_frames(corpus: DataFrame, queries: DataFrame, qrels: DataFrame,
                  spec: FreezeSpec) -> tuple[Frozen, Chosen]:
    """The frozen tables as plans, without writing them."""
    chosen = choose(corpus, queries, qrels, spec)
    docs, asked = indexed_corpus(chosen, spec), indexed_queries(chosen, spec)
    return Frozen(docs, asked, to_rows(chosen.judged, asked, docs, chosen.n_judged)), chosen


def manifest_row(tables: Frozen, spec: FreezeSpec) -> DataFrame:
    """One row of seed, source, fingerprints and counts. Tree fingerprints always, flat ones if asked for."""
    spark = tables.corpus.sparkSession

    def hashes(df: DataFrame, ident: str) -> tuple[str | None, str, int]:
        flat = flat_fingerprint(df, ident).first().fingerprint if spec.flat_hash else None
        tree = tree_fingerprint(df, ident).first()
        return flat, tree.fingerprint, tree.n

    corpus_hash, corpus_tree, n_corpus = hashes(tables.corpus, "doc_id")
    queries_hash, queries_tree, n_queries = hashes(tables.queries, "query_id")
    row = (
        spec.seed, spec.source, corpus_hash, queries_hash, corpus_tree, queries_tree,
        n_corpus, n_queries, tables.qrels.count(), spec.clean_text,
    )
    return spark.createDataFrame([row], schemas.MANIFEST)


def invariants(tables: Frozen, n_docs: int | None = None) -> DataFrame:
    """One row per invariant: its name, the number of violations, and whether it holds."""

    def unfolded(df: DataFrame, counts: dict) -> DataFrame:
        """Several counts of one aggregate as rows."""
        one = df.agg(*(c.cast("bigint").alias(n) for n, c in counts.items()))
        parts = ", ".join(f"'{n}', `{n}`" for n in counts)
        return one.selectExpr(f"stack({len(counts)}, {parts}) AS (invariant, violations)")

    n_corpus, n_queries = tables.corpus.count(), tables.queries.count()

    def outside(column: str, n: int) -> Column:
        return F.count_if(~F.col(column).between(0, n - 1))

    def per_table(df: DataFrame, name: str, ident: str, n: int) -> DataFrame:
        empty = strip("text") == ""
        content = {
            f"{name}_text_null": F.count_if(F.col("text").isNull()),
            f"{name}_text_empty": F.count_if(empty),
            f"{name}_row_range": outside("row_idx", n),
        }
        repeats = lambda c: unfolded(
            df.groupBy(c).count(),
            {f"{name}_{c}_unique": F.coalesce(F.sum(F.col("count") - 1), F.lit(0))},
        )
        return unfolded(df, content).unionByName(repeats(ident)).unionByName(repeats("row_idx"))

    lost = tables.queries.select("row_idx").join(
        tables.qrels.select(F.col("query_row").alias("row_idx")), "row_idx", "left_anti"
    )
    rows = (
        per_table(tables.corpus, "corpus", "doc_id", n_corpus)
        .unionByName(per_table(tables.queries, "queries", "query_id", n_queries))
        # row numbers being dense, those in range exist
        .unionByName(unfolded(tables.qrels, {
            "qrels_empty": (F.count("*") == 0).cast("int"),
            "qrels_corpus_row": outside("corpus_row", n_corpus),
            "qrels_query_row": outside("query_row", n_queries),
        }))
        .unionByName(unfolded(lost, {"query_without_positive": F.count("*")}))
    )
    if n_docs is not None:
        off = F.abs(F.count("*") - F.lit(n_docs))
        rows = rows.unionByName(unfolded(tables.corpus, {"corpus_size": off}))
    return rows.withColumn("passed", F.col("violations") == 0)


def require_invariants(tables: Frozen, n_docs: int | None = None) -> DataFrame:
    """The invariant table; raises if one is broken, naming queries left without positives."""
    found = invariants(tables, n_docs)
    rows = found.collect()
    broken = [f"{r.invariant}: {r.violations}" for r in rows if not r.passed]
    if broken:
        lost = tables.queries.join(
            tables.qrels.select(F.col("query_row").alias("row_idx")), "row_idx", "left_anti"
        )
        n_lost = lost.count()
        names = [r.query_id for r in lost.orderBy("query_id").limit(20).collect()]
        hint = f"; {n_lost} queries without positives, the first {names}" if names else ""
        raise ValueError("broken corpus invariants: " + ", ".join(broken) + hint)
    return found.sparkSession.createDataFrame(rows, found.schema)


def freeze(spark: SparkSession, corpus: DataFrame, queries: DataFrame, qrels: DataFrame,
           root: str, spec: FreezeSpec = FreezeSpec()) -> Frozen:
    """Write corpus, queries, qrels and, last, the manifest. Refuses a frozen ``root``.

    Each table is written before the next step reads it, so nothing is computed twice.
    Judged documents that the raw corpus lacks are stored as ``missing`` and warned about.
    """
    refuse_if_frozen(spark, root)
    chosen = choose(corpus, queries, qrels, spec)
    write_table(indexed_corpus(chosen, spec), f"{root}/corpus")
    write_table(indexed_queries(chosen, spec), f"{root}/queries")
    docs, asked = frozen(spark, root, "corpus"), frozen(spark, root, "queries")
    write_table(to_rows(chosen.judged, asked, docs, chosen.n_judged), f"{root}/qrels")
    write_table(chosen.missing.select(F.col("corpus_id").alias("doc_id")), f"{root}/missing")
    missing = spark.read.schema("doc_id STRING").parquet(f"{root}/missing")
    if n_missing := missing.count():
        warnings.warn(f"{n_missing} judged documents are not in the corpus; their judgments are dropped", stacklevel=2)
    tables = Frozen(docs, asked, frozen(spark, root, "qrels"), missing)
    require_invariants(tables, spec.n_docs)
    write_manifest(manifest_row(tables, spec), root)
    return tables


def load(spark: SparkSession, root: str) -> Frozen:
    return Frozen(*(frozen(spark, root, name) for name in ("corpus", "queries", "qrels")))
