"""Queries over vectors: functions, retrieval, metrics, maps, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis.functions import vectors as V
from rebasis.operators import linmap as L
from rebasis.operators import metrics as M
from rebasis.operators.encode import HashedTermEncoder, encode
from rebasis.operators.judgments import in_split, renumbered
from rebasis.operators.ordering import find_cut, split_train_test
from rebasis.operators.retrieve import top_k
from rebasis.plans.ceilings import ceilings
from rebasis.plans.pairs import all_pairs, evaluate_grid, evaluate_pairs
from rebasis.plans.reports import ceiling_lines, pair_summary
from rebasis.schemas import PAIR_RESULTS
from rebasis.session import fresh_path, stored
from rebasis.sinks.tables import write_pair_results
from rebasis.workload import sql as S
from rebasis.workload import standins as st
from rebasis.workload.base import query


def _spread(df: DataFrame, vector: str, digits: int = 6) -> DataFrame:
    """One row per vector element, rounded."""
    return df.select("vec_id", F.posexplode(vector).alias("i", "value")).select(
        "vec_id", "i", (F.round(F.col("value").cast("double"), digits) + F.lit(0.0)).alias("value")
    )


def _spread_sql(relation: str, digits: int = 6) -> str:
    return f"""SELECT vec_id, CAST(i - 1 AS INT) AS i, round(CAST(value AS DOUBLE), {digits}) + 0.0 AS value
FROM (SELECT vec_id, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM {relation})"""


@query(
    S.with_(
        """x AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * label) AS v0 FROM embeddings)""",
        """n AS (SELECT vec_id, v0, greatest(sqrt(list_dot_product(v0, v0)), 1e-8) AS n FROM x)""",
        """u AS (SELECT vec_id, list_transform(v0, lambda x: x / n) AS v FROM n)""",
    )
    + _spread_sql("u")
)
def normalize_l2(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors stretched by their label, which makes those of label 0 zero vectors."""
    df = st.table(spark, sf, "embeddings")
    stretched = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.col("label"))
    return _spread(df.select("vec_id", V.unit(stretched).alias("v")), "v")


@query(
    S.with_(
        f"""h AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {S.half('x')}) AS v FROM embeddings)"""
    )
    + _spread_sql("h", 8)
)
def half_round(spark: SparkSession, sf: str) -> DataFrame:
    df = st.table(spark, sf, "embeddings")
    return _spread(df.select("vec_id", V.half_round("embedding").alias("v")), "v", 8)


@query(
    f"""SELECT count(*) AS n, round(min(c), 6) AS min_cosine, round(avg(c), 6) AS mean_cosine
FROM (SELECT {S.dot('a.embedding', 'b.embedding')} AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"""
)
def paired_cosine(spark: SparkSession, sf: str) -> DataFrame:
    df = st.table(spark, sf, "embeddings")
    after = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("after"))
    return df.join(after, "vec_id").select(V.dot("embedding", "after").alias("c")).agg(
        F.count("*").alias("n"),
        F.round(F.min("c"), 6).alias("min_cosine"),
        F.round(F.avg("c"), 6).alias("mean_cosine"),
    )


def ranked_vectors(spark: SparkSession, sf: str, **how) -> DataFrame:
    docs = st.base_vectors(spark, sf).withColumnRenamed("row_idx", "corpus_row")
    asked = st.blended_queries(spark, sf).withColumnRenamed("row_idx", "query_row")
    return top_k(docs, asked, doc_id="corpus_row", **how)


_RANKED = S.ranked("vdocs", "vqueries")


@query(S.with_(S.VECTORS, _RANKED) + "SELECT query_row, rank, corpus_row, score FROM ranked")
def topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_vectors(spark, sf)


@query(S.with_(S.VECTORS, _RANKED) + "SELECT query_row, rank, corpus_row, score FROM ranked")
def topk_cosine_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken when the query set is too large to broadcast."""
    return ranked_vectors(spark, sf, broadcast_bytes=0, block_bytes=64 * 8 * 200)


@query(S.with_(S.VECTORS, _RANKED) + "SELECT query_row, rank, corpus_row, score FROM ranked")
def topk_cosine_passes(spark: SparkSession, sf: str) -> DataFrame:
    """The way taken when the query set is a few broadcast blocks."""
    return ranked_vectors(spark, sf, broadcast_bytes=64 * 8 * 200)


_HITS = S.with_(S.VECTORS, _RANKED, S.HITS)


@query(
    _HITS
    + """SELECT query_row, count(*) AS n_relevant, CAST(sum(hit) AS BIGINT) AS n_hits,
  sum(hit) / count(*) AS recall FROM hits GROUP BY query_row"""
)
def recall_by_query(spark: SparkSession, sf: str) -> DataFrame:
    return M.recall_by_query(st.graded_pairs(spark, sf), ranked_vectors(spark, sf))


@query(
    _HITS
    + """SELECT round(avg(r), 6) AS recall, count(*) AS n_queries
FROM (SELECT sum(hit) / count(*) AS r FROM hits GROUP BY query_row)"""
)
def recall_macro(spark: SparkSession, sf: str) -> DataFrame:
    return M.macro_recall(st.graded_pairs(spark, sf), ranked_vectors(spark, sf)).withColumn(
        "recall", F.round("recall", 6)
    )


@query(
    _HITS
    + """SELECT count(*) AS n_pairs, CAST(sum(hit) AS BIGINT) AS n_hits,
  round(sum(hit) / count(*), 6) AS recall FROM hits"""
)
def recall_micro(spark: SparkSession, sf: str) -> DataFrame:
    return M.micro_recall(st.graded_pairs(spark, sf), ranked_vectors(spark, sf)).withColumn(
        "recall", F.round("recall", 6)
    )


_NDCG = S.with_(S.VECTORS, _RANKED, S.ndcg("graded", "ranked", "query_row", "corpus_row"))


@query(_NDCG + "SELECT round(avg(ndcg), 6) AS ndcg, count(*) AS n_queries FROM ndcgs")
def ndcg_at_10(spark: SparkSession, sf: str) -> DataFrame:
    return M.ndcg(
        st.graded_pairs(spark, sf), ranked_vectors(spark, sf), "query_row", "corpus_row"
    ).withColumn("ndcg", F.round("ndcg", 6))


@query(_NDCG + "SELECT query_row, round(ndcg, 6) AS ndcg FROM ndcgs")
def ndcg_by_query(spark: SparkSession, sf: str) -> DataFrame:
    return M.ndcg_by_query(
        st.graded_pairs(spark, sf), ranked_vectors(spark, sf), "query_row", "corpus_row"
    ).withColumn("ndcg", F.round("ndcg", 6))


_SPLIT = f"""
split AS (
  SELECT vec_id, row_number() OVER (ORDER BY {S.key('vec_id', 'split')}) AS r,
         (SELECT count(*) // 2 FROM embeddings) AS n FROM embeddings)"""


@query(S.with_(_SPLIT) + "SELECT vec_id AS row_idx, r <= n AS is_train FROM split")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    ids = st.base_vectors(spark, sf).select("row_idx")
    train, test, _ = split_train_test(ids, "row_idx", ids.count() // 2)
    return train.withColumn("is_train", F.lit(True)).unionByName(
        test.withColumn("is_train", F.lit(False))
    )


_TEST_QRELS = _SPLIT + """,
test_docs AS (SELECT vec_id, r - n - 1 AS test_row FROM split WHERE r > n),
test_qrels AS (
  SELECT g.query_row, g.corpus_row, t.test_row FROM graded g JOIN test_docs t ON t.vec_id = g.corpus_row)"""


@query(S.with_(S.JUDGED_VECTORS, _TEST_QRELS) + "SELECT query_row, corpus_row, test_row FROM test_qrels")
def test_qrels_remap(spark: SparkSession, sf: str) -> DataFrame:
    ids = st.base_vectors(spark, sf).select("row_idx")
    cut = find_cut(ids, "row_idx", ids.count() // 2, stream="split")
    kept = in_split(st.graded_pairs(spark, sf), cut)
    return renumbered(kept, ids.where(~cut.keeps("row_idx")))


def _products_sql(left: str, right: str) -> str:
    return f"""
x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a,
        list_transform(list_reverse(CAST(embedding AS DOUBLE[])),
                       lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END) AS b FROM embeddings),
l AS (SELECT vec_id, unnest({left}) AS value, generate_subscripts({left}, 1) - 1 AS i FROM x),
r AS (SELECT vec_id, unnest({right}) AS value, generate_subscripts({right}, 1) - 1 AS j FROM x)"""


_CELLS = """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(sum(l.value * r.value), 4) + 0.0 AS value
FROM l JOIN r USING (vec_id) GROUP BY i, j"""


def _cells(rows: DataFrame, digits: int = 4) -> DataFrame:
    return L.cells(rows).withColumn("value", F.round("value", digits) + F.lit(0.0))


@query(S.with_(_products_sql("a", "a")) + _CELLS)
def gram_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(L.product(st.table(spark, sf, "embeddings"), "embedding", "embedding"))


@query(S.with_(_products_sql("a", "b")) + _CELLS)
def cross_covariance(spark: SparkSession, sf: str) -> DataFrame:
    df = st.table(spark, sf, "embeddings")
    both = df.select(F.col("embedding").alias("a"), L.planted_rotation("embedding").alias("b"))
    return _cells(L.product(both, "a", "b"))


_DIMS = "SELECT max(len(embedding)) AS d FROM embeddings"


@query(
    f"""SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j,
  CAST(CASE WHEN i = d - 1 - j THEN CASE WHEN j % 2 = 1 THEN -1 ELSE 1 END ELSE 0 END AS DOUBLE) AS value
FROM ({_DIMS}), range(64) a(i), range(64) b(j)"""
)
def orthogonal_map(spark: SparkSession, sf: str) -> DataFrame:
    """The map fitted to a planted rotation; the twin states that rotation."""
    df = st.table(spark, sf, "embeddings")
    both = df.select(F.col("embedding").alias("a"), L.planted_rotation("embedding").alias("b"))
    return _cells(L.to_rows(spark, L.fit(both, "a", "b").matrix), 6)


@query(
    """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j,
  CAST(CASE WHEN j < 64 AND i = j THEN 1 WHEN j >= 64 AND i = j - 64 THEN 2 ELSE 0 END AS DOUBLE) AS value
FROM range(64) a(i), range(96) b(j)"""
)
def least_squares_map(spark: SparkSession, sf: str) -> DataFrame:
    """The map fitted to a planted extension; the twin states that extension."""
    df = st.table(spark, sf, "embeddings")
    both = df.select(F.col("embedding").alias("a"), L.planted_extension("embedding").alias("b"))
    return _cells(L.to_rows(spark, L.fit(both, "a", "b").matrix), 6)


def _planted_decay(vector: Column | str, smallest: float = 1e-9) -> Column:
    """A test fixture: coordinate j scaled by ``smallest ** (j / (d - 1))``, in double.

    Rows so scaled have singular values spread down to about ``smallest`` of the largest.
    """
    v = (F.col(vector) if isinstance(vector, str) else vector).cast("array<double>")
    last = F.greatest(F.size(v) - 1, F.lit(1))
    return F.transform(v, lambda x, j: x * F.pow(F.lit(smallest), j / last))


@query(
    """SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j,
  CAST(CASE WHEN j < 64 AND i = j THEN 1 WHEN j >= 64 AND i = j - 64 THEN 2 ELSE 0 END AS DOUBLE) AS value
FROM range(64) a(i), range(96) b(j)"""
)
def least_squares_qr(spark: SparkSession, sf: str) -> DataFrame:
    """The extension map fitted by a tall QR to rows whose singular values reach down to 1e-9.

    The squared (Gram) form cannot see the smallest directions; the triangular factor can.
    """
    df = st.table(spark, sf, "embeddings")
    decayed = df.select(_planted_decay("embedding").alias("a"))
    both = decayed.select("a", L.planted_extension("a").alias("b"))
    return _cells(L.to_rows(spark, L.fit_least_squares_qr(both, "a", "b").matrix), 6)


_ROTATED = """
t AS (SELECT vec_id, list_transform(list_reverse(CAST(embedding AS DOUBLE[])),
                       lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END) AS w FROM embeddings),
s AS (SELECT vec_id, w, greatest(sqrt(list_dot_product(w, w)), 1e-8) AS n FROM t),
moved AS (SELECT vec_id, list_transform(w, lambda x: x / n) AS v FROM s)"""


@query(S.with_(_ROTATED) + _spread_sql("moved"))
def translate_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors through the fitted rotation, scaled to unit length."""
    df = st.table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = df.select(F.col("embedding").alias("a"), L.planted_rotation("embedding").alias("b"))
    return _spread(L.translate(df, L.fit(both, "a", "b").matrix), "embedding")


@query(
    S.with_(_ROTATED.replace("x / n", "x"))
    + _spread_sql("moved").replace("SELECT vec_id, CAST(i - 1 AS INT) AS i", "SELECT vec_id, CAST(i - 1 AS INT) AS j")
)
def translate_relational(spark: SparkSession, sf: str) -> DataFrame:
    df = st.table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = df.select(F.col("embedding").alias("a"), L.planted_rotation("embedding").alias("b"))
    rows = L.to_rows(spark, L.fit(both, "a", "b").matrix)
    return L.translate_relational(df, rows, "vec_id").withColumn(
        "value", F.round("value", 6) + F.lit(0.0)
    )


_IMAGES = {
    "studio/base": "v",
    "studio/rotated": "list_transform(list_reverse(v), lambda x, i: CASE WHEN i % 2 = 0 THEN -x ELSE x END)",
    "studio/extended": "list_concat(v, list_transform(v[1:32], lambda x: CAST(2 * x AS FLOAT)))",
}


def _pairs_sql(pairs: list[tuple[str, str]]) -> str:
    """Planted maps carry a source's queries exactly onto the target's."""
    targets = list(dict.fromkeys(b for _, b in pairs))
    parts = [S.VECTORS, _TEST_QRELS]
    counts = []
    for n, target in enumerate(targets):
        image = _IMAGES[target]
        parts += [
            f"d{n} AS (SELECT corpus_row, {image} AS v FROM vdocs WHERE corpus_row IN (SELECT vec_id FROM test_docs))",
            f"q{n} AS (SELECT query_row, {image} AS v FROM vqueries)",
            S.ranked(f"d{n}", f"q{n}", name=f"r{n}"),
        ]
        counts.append(
            f"SELECT '{target}' AS target, count(r.rank) / count(*) AS recall FROM test_qrels t "
            f"LEFT JOIN r{n} r ON r.query_row = t.query_row AND r.corpus_row = t.corpus_row"
        )
    rows = ", ".join(
        f"('{a}', '{b}', '{L.method_for(st.MODELS[a], st.MODELS[b])}', {st.MODELS[a]}, {st.MODELS[b]})"
        for a, b in pairs
    )
    parts += [
        "recalls AS (" + " UNION ALL ".join(counts) + ")",
        f"pairs AS (SELECT * FROM (VALUES {rows}) t(source, target, method, src_dim, tgt_dim))",
    ]
    return S.with_(*parts) + """
SELECT source, p.target, method, src_dim, tgt_dim, (SELECT count(*) // 2 FROM embeddings) AS train_docs,
  (SELECT count(*) FROM test_docs) AS test_docs, (SELECT count(*) FROM test_qrels) AS test_qrels,
  (SELECT count(DISTINCT query_row) FROM test_qrels) AS test_queries,
  round(recall, 5) AS recall_at_10_translated, round(recall, 5) AS recall_at_10_native_target,
  CAST(CASE WHEN recall > 0 THEN 1 ELSE 0 END AS DOUBLE) AS ratio, 42 AS seed
FROM pairs p JOIN recalls USING (target)"""


def _evaluated(spark: SparkSession, sf: str, pairs: list[tuple[str, str]]) -> DataFrame:
    half = st.base_vectors(spark, sf).count() // 2
    return evaluate_pairs(
        st.vectors(spark, sf), st.graded_pairs(spark, sf), pairs, train_size=half
    ).drop("train_seconds", "solve_seconds", "aggregate_seconds", "train_queries", "map_rank")


_ONE = [("studio/base", "studio/rotated")]
_LS = [("studio/base", "studio/extended")]
_ALL = all_pairs(list(st.MODELS))


@query(_pairs_sql(_ONE))
def pair_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, _ONE)


@query(_pairs_sql(_ALL))
def pair_results_file(spark: SparkSession, sf: str) -> DataFrame:
    """Results of all pairs, written as JSON and read back."""
    half, path = st.base_vectors(spark, sf).count() // 2, fresh_path(spark, "pairs")
    write_pair_results(
        evaluate_pairs(st.vectors(spark, sf), st.graded_pairs(spark, sf), _ALL, train_size=half), path)
    return spark.read.schema(PAIR_RESULTS).json(path).drop(
        "train_seconds", "solve_seconds", "aggregate_seconds", "train_queries", "map_rank"
    )


@query(_pairs_sql(_LS))
def pair_ratio_least_squares(spark: SparkSession, sf: str) -> DataFrame:
    return _evaluated(spark, sf, _LS)


@query(_pairs_sql(_ALL))
def pair_grid(spark: SparkSession, sf: str) -> DataFrame:
    found = st.vectors(spark, sf)
    half = st.base_vectors(spark, sf).count() // 2
    return evaluate_grid(found, st.graded_pairs(spark, sf), train_size=half).drop(
        "train_seconds", "solve_seconds", "aggregate_seconds", "train_queries", "map_rank"
    )


@query(
    f"""SELECT substr(split_part(source, '/', -1), 1, 18) AS source, substr(split_part(target, '/', -1), 1, 18) AS target,
  printf('%.5f', recall_at_10_translated) AS translated, printf('%.5f', recall_at_10_native_target) AS native,
  printf('%.5f', ratio) AS ratio FROM ({_pairs_sql(_ALL)})"""
)
def pair_report(spark: SparkSession, sf: str) -> DataFrame:
    return pair_summary(_evaluated(spark, sf, _ALL))


def _ceiling_sql(select: str) -> str:
    parts = [S.VECTORS]
    rows = []
    for n, (model, image) in enumerate(_IMAGES.items()):
        parts += [
            f"d{n} AS (SELECT corpus_row, {image} AS v FROM vdocs)",
            f"q{n} AS (SELECT query_row, {image} AS v FROM vqueries)",
            S.ranked(f"d{n}", f"q{n}", name=f"r{n}"),
        ]
        rows.append(
            f"SELECT '{model}' AS model, avg(r) AS recall_at_10 FROM (SELECT count(r.rank) / count(*) AS r "
            f"FROM graded g LEFT JOIN r{n} r ON r.query_row = g.query_row AND r.corpus_row = g.corpus_row "
            f"GROUP BY g.query_row)"
        )
    return S.with_(*parts, "ceilings AS (" + " UNION ALL ".join(rows) + ")") + select


@query(_ceiling_sql("SELECT model, printf('recall@10 = %.5f', recall_at_10) AS line FROM ceilings"))
def ceiling_report(spark: SparkSession, sf: str) -> DataFrame:
    return ceiling_lines(ceilings(st.vectors(spark, sf), st.graded_pairs(spark, sf), list(st.MODELS)))


# Text encoders of different spaces: the only pairs here whose maps have no closed form.
TEXT_MODELS = [
    HashedTermEncoder(768, "a", "terms/a"),
    HashedTermEncoder(768, "b", "terms/b"),
    HashedTermEncoder(1024, "c", "terms/c"),
]


def text_vectors(spark: SparkSession, sf: str, models: list) -> tuple[DataFrame, DataFrame]:
    """Documents and passages under several text encoders, and their judgments."""
    docs = st.texts(spark, sf).select(F.col("doc_id").alias("row_idx"), "text")
    asked = st.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_idx"), "text")
    out = None
    for model in models:
        for split, rows in (("corpus", docs), ("queries", asked)):
            part = encode(rows, model).select(
                F.lit(model.name).alias("model"), F.lit(split).alias("split"), "row_idx", "embedding"
            )
            out = part if out is None else out.unionByName(part)
    judged = st.contained(spark, sf).select(
        F.col("item_id").alias("query_row"), F.col("doc_id").alias("corpus_row")
    )
    return out, judged


def _text_grid(spark: SparkSession, sf: str, models: list) -> DataFrame:
    found, judged = text_vectors(spark, sf, models)
    half = st.table(spark, sf, "documents").count() // 2
    return evaluate_pairs(
        stored(found, "text-vectors", ("model", "split")), stored(judged, "text-qrels"),
        all_pairs([m.name for m in models]), train_size=half,
    )


@query()
def text_pair_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Translate between text encoders: half of the documents train, all others are searched."""
    return _text_grid(spark, sf, TEXT_MODELS)


@query()
def text_pair_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same between the smallest and the largest registered dimension."""
    return _text_grid(spark, sf, [TEXT_MODELS[0], HashedTermEncoder(2560, "d", "terms/d")])
