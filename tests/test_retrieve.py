import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebasis.operators import metrics as M
from rebasis.operators import retrieve as R
from rebasis.operators.retrieve import _Best, top_k


def brute(docs, queries, k=10):
    """{query: [doc, ...]} by rounded score, then id."""
    ids = np.array(sorted(docs))
    matrix = np.array([docs[i] for i in ids])
    out = {}
    for q, v in queries.items():
        score = np.round(matrix @ np.array(v), 6)
        out[q] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def frames(spark, docs, queries, parts=4):
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in docs.items()], "row_idx long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in queries.items()], "query_row long, embedding array<float>")
    return d.repartition(parts), q


def lists(ranked, key="query_row"):
    out = {}
    for r in sorted(ranked.collect(), key=lambda r: (r[key], r["rank"])):
        out.setdefault(r[key], []).append(r.row_idx)
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    docs = {i: v for i, v in enumerate(rng.integers(-2, 3, (400, 6)).astype(np.float32))}
    docs |= {1000 + i: docs[3] for i in range(200)}  # a third of all rows are copies
    queries = {i: v for i, v in enumerate(rng.integers(-2, 3, (23, 6)).astype(np.float32))}
    return docs, queries


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("how", [
    {}, {"broadcast_bytes": 6 * 8 * 7}, {"broadcast_bytes": 0, "block_bytes": 6 * 8 * 50},
])
def test_equals_brute_force_with_ties(spark, data, parts, how):
    docs, queries = data
    d, q = frames(spark, docs, queries, parts)
    assert lists(top_k(d, q, 10, **how)) == brute(docs, queries)


def test_small_batches_and_few_tasks(spark, data):
    docs, queries = data
    d, q = frames(spark, docs, queries, 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert lists(top_k(d, q, 10, max_tasks=2)) == brute(docs, queries)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_fewer_documents_than_k(spark):
    docs, queries = {5: [1.0, 0.0], 2: [1.0, 0.0]}, {0: [1.0, 0.0]}
    d, q = frames(spark, docs, queries)
    assert lists(top_k(d, q, 10)) == {0: [2, 5]}


def test_no_queries(spark):
    d, q = frames(spark, {1: [1.0]}, {0: [1.0]})
    assert top_k(d, q.where("false"), 3).count() == 0


def test_nan_vectors_are_never_retrieved(spark):
    d, q = frames(spark, {1: [float("nan"), 0.0], 2: [0.1, 0.0]}, {0: [1.0, 0.0]})
    assert lists(top_k(d, q, 10)) == {0: [2]}


def test_infinite_scores_are_returned(spark):
    d, q = frames(spark, {1: [float("inf"), 0.0], 2: [0.1, 0.0], 3: [float("-inf"), 0.0]}, {0: [1.0, 0.0]})
    assert lists(top_k(d, q, 10)) == {0: [1, 2, 3]}


def test_uneven_vectors_raise(spark):
    d, q = frames(spark, {1: [1.0, 0.0], 2: [0.1]}, {0: [1.0, 0.0]})
    with pytest.raises(Exception, match="expected vectors of length 2"):
        top_k(d, q, 10).collect()


def test_several_query_keys(spark, data):
    docs, queries = data
    d, q = frames(spark, docs, queries)
    named = q.select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("source"), "query_row", "embedding")
    for how in ({}, {"broadcast_bytes": 700}, {"broadcast_bytes": 0, "block_bytes": 2000}):
        got = top_k(d, named, 10, query_id=["source", "query_row"], **how)
        for s in "xy":
            assert lists(got.where(F.col("source") == s)) == brute(docs, queries)


def test_running_best_keeps_the_lowest_ids():
    best = _Best(1, 2)
    for ids in ([9, 8], [7, 1], [5, 0]):
        best.offer(np.ones((1, 2)), np.array(ids))
    assert best.rows()[1].tolist() == [0, 1]


@pytest.fixture(scope="module")
def micro(spark):
    """Three queries with 1, 2 and 4 relevant documents, one hit each."""
    judged = spark.createDataFrame(
        [(0, 1, 1), (1, 1, 3), (1, 2, 1), (2, 1, 0), (2, 2, 2), (2, 3, 1), (2, 4, 1)],
        "query_row long, corpus_row long, rel int",
    )
    ranked = spark.createDataFrame(
        [(0, 1, 1), (0, 2, 9), (1, 1, 9), (1, 2, 1), (2, 1, 3), (9, 1, 1)],
        "query_row long, rank int, corpus_row long",
    )
    return judged, ranked


def test_recalls(micro):
    judged, ranked = micro
    macro = M.macro_recall(judged, ranked).first()
    assert round(macro.recall, 6) == 0.583333 and macro.n_queries == 3
    row = M.micro_recall(judged, ranked).first()
    assert round(row.recall, 6) == 0.428571 and (row.n_hits, row.n_pairs) == (3, 7)


def test_repeated_judgments_count_once(micro):
    judged, ranked = micro
    assert M.micro_recall(judged.union(judged), ranked).first().n_pairs == 7


def test_ndcg(micro):
    judged, ranked = micro
    got = {r[0]: r[1] for r in M.ndcg_by_query(judged, ranked, "query_row", "corpus_row").collect()}
    log = np.log2
    assert set(got) == {0, 1, 2}  # query 9 is not judged
    assert got[0] == 1.0
    assert abs(got[1] - (3 / log(3)) / (3 / log(2) + 1 / log(3))) < 1e-12
    assert abs(got[2] - (1 / log(2)) / (2 / log(2) + 1 / log(3) + 1 / log(4))) < 1e-12


def test_ndcg_without_hits_or_grades(spark):
    judged = spark.createDataFrame([(0, 5, 1), (1, 5, 0), (2, 5, 1)], "query_row long, corpus_row long, rel int")
    ranked = spark.createDataFrame([(0, 1, 6), (1, 1, 5)], "query_row long, rank int, corpus_row long")
    got = {r[0]: r[1] for r in M.ndcg_by_query(judged, ranked, "query_row", "corpus_row").collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 0.0}  # query 2 found nothing


def test_hot_query(spark):
    """One query holds a third of all judgments."""
    hot = spark.range(1000).selectExpr("0L query_row", "id corpus_row", "cast(id % 4 as int) rel")
    rest = spark.range(2000).selectExpr("1 + id query_row", "id corpus_row", "1 rel")
    ranked = spark.range(2001).selectExpr("id query_row", "1 rank", "greatest(id - 1, 0L) corpus_row")
    row = M.micro_recall(hot.union(rest), ranked).first()
    assert (row.n_pairs, row.n_hits) == (3000, 2001)
    plan = M.ndcg(hot.union(rest), ranked, "query_row", "corpus_row")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_stored_blocks_with_bounds_are_exact(spark):
    """Clustered documents: sub-blocks far from a query are skipped, results equal brute force."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(5, 8)) * 10
    docs = {i: (centres[i % 5] + rng.normal(size=8) * 0.1).astype(np.float32) for i in range(3000)}
    queries = {i: (centres[i % 5] + rng.normal(size=8)).astype(np.float32) for i in range(60)}
    d, q = frames(spark, docs, queries, parts=3)
    # sorted documents make sub-blocks of one cluster each
    d = d.repartitionByRange(3, (F.col("row_idx") % 5) * 10000 + F.col("row_idx"))
    got = lists(top_k(d, q, 7, broadcast_bytes=0, block_bytes=8 * 8 * 13))
    assert got == brute(docs, queries, 7)


def test_stored_blocks_of_an_empty_query_hash(spark, data):
    docs, queries = data
    d, q = frames(spark, docs, {0: queries[0]})
    got = lists(top_k(d, q, 5, broadcast_bytes=0, block_bytes=8))  # many blocks, one query
    assert got == brute(docs, {0: queries[0]}, 5)


def test_candidates_do_not_grow_with_document_splits(spark, data, monkeypatch):
    """A query of a blocked search is ranked by one task: k rows each, whatever the splits."""
    docs, queries = data
    d, q = frames(spark, docs, queries, 16)
    found = []
    rank = R._rank
    monkeypatch.setattr(R, "_rank", lambda df, *how: found.append(df) or rank(df, *how))
    assert lists(top_k(d, q, 10, broadcast_bytes=0, block_bytes=6 * 8 * 10)) == brute(docs, queries)
    assert found[0].count() == 10 * len(queries)


def test_memory_of_a_search_is_bounded():
    """Neither more documents nor wide batches of them add to what a query block needs."""
    rng = np.random.default_rng(3)
    queries = rng.normal(size=(20_000, 8))
    search = R._Search(queries, 10, 6)
    tracemalloc.start()
    try:
        for lo in range(0, 12_000, 6_000):
            search.offer(np.arange(lo, lo + 6_000), rng.normal(size=(6_000, 8)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 48 << 20  # all scores of one batch would be 960 MB


def test_scores_closer_than_32_bits_can_tell(spark):
    """Large and nearly equal scores rank by their 64-bit values, overflowing ones too."""
    docs = {i: np.array([4000.0, i / 64], np.float32) for i in range(300)}
    queries = {0: [4000.0, 1e-3], 1: [4000.0, -1e-3], 2: [0.0, 1.0]}
    d, q = frames(spark, docs, {}, 3)[0], spark.createDataFrame(
        list(queries.items()), "query_row long, embedding array<double>")
    got = lists(top_k(d, q, 10, broadcast_bytes=0))
    assert got == {0: list(range(299, 289, -1)), 1: list(range(10)), 2: list(range(299, 289, -1))}
    huge = {i: np.array([1e38, i], np.float32) for i in range(300)}
    far = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1e38, 0.0])], "query_row long, embedding array<double>")
    d = frames(spark, huge, {}, 3)[0]
    for how in ({}, {"broadcast_bytes": 0}):
        assert lists(top_k(d, far, 10, **how)) == {0: list(range(299, 289, -1)), 1: list(range(10))}
