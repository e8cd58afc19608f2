import numpy as np
import pytest
from pyspark.sql import functions as F

from rebasis.operators import linmap as L
from rebasis.plans import pairs as P
from rebasis.plans.ceilings import ceilings
from tests.helpers import vector_table


def frame(spark, **columns):
    names = list(columns)
    rows = [tuple(map(lambda v: v.tolist(), r)) for r in zip(*columns.values())]
    return spark.createDataFrame(rows, ", ".join(f"{n} array<double>" for n in names))


@pytest.fixture(scope="module")
def random():
    return np.random.default_rng(3)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_products(spark, random, parts):
    a, b = random.normal(size=(200, 5)), random.normal(size=(200, 7))
    df = frame(spark, a=a, b=b).repartition(parts)
    cross = L.to_matrix(L.product(df, "a", "b"), (5, 7))
    assert np.allclose(cross, a.T @ b)
    assert np.allclose(L.to_matrix(L.product(df, "a", "a"), (5, 5)), a.T @ a)


def test_products_in_small_batches(spark, random):
    a = random.normal(size=(50, 3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = L.to_matrix(L.product(frame(spark, a=a).repartition(3), "a", "a", max_tasks=2), (3, 3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose(got, a.T @ a)


def test_orthogonal_fit_recovers_a_rotation(spark, random):
    a = random.normal(size=(300, 8))
    q, _ = np.linalg.qr(random.normal(size=(8, 8)))
    q[:, 0] *= -1  # a reflection is as good as a rotation
    got = L.fit(frame(spark, a=a, b=a @ q), "a", "b")
    assert got.method == "orthogonal_procrustes" and got.rank == 8
    assert np.allclose(got.matrix, q, atol=1e-10)


def test_noisy_orthogonal_fit_is_the_best_orthogonal_map(spark, random):
    a = random.normal(size=(200, 6))
    b = a @ np.linalg.qr(random.normal(size=(6, 6)))[0] + 0.3 * random.normal(size=(200, 6))
    m = L.fit(frame(spark, a=a, b=b), "a", "b").matrix
    u, _, vt = np.linalg.svd(a.T @ b)
    assert np.allclose(m, u @ vt) and np.allclose(m.T @ m, np.eye(6))


def test_least_squares_equals_lstsq(spark, random):
    a, b = random.normal(size=(300, 6)), random.normal(size=(300, 9))
    got = L.fit(frame(spark, a=a, b=b), "a", "b")
    assert got.method == "least_squares"
    assert np.allclose(got.matrix, np.linalg.lstsq(a, b, rcond=None)[0])


def test_rank_deficient_least_squares_has_minimum_norm(spark, random):
    low = random.normal(size=(300, 4))
    a = np.hstack([low, 2 * low[:, :3]])
    b = random.normal(size=(300, 5))
    got = L.fit(frame(spark, a=a, b=b), "a", "b")
    assert got.rank == 4
    assert np.allclose(got.matrix, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-8)


def test_translate_forms_agree(spark, random):
    a, m = random.normal(size=(20, 4)), random.normal(size=(4, 3))
    a[5] = 0
    df = frame(spark, embedding=a).withColumn("id", F.monotonically_increasing_id())
    plain = {r.id: r.embedding for r in L.translate(df, m, renormalize=False).collect()}
    for r in L.translate_relational(df, L.to_rows(spark, m), "id").collect():
        assert abs(plain[r.id][r.j] - r.value) < 1e-12
    lengths = [np.linalg.norm(r.embedding) for r in L.translate(df, m).collect()]
    assert sorted(round(x, 12) for x in lengths) == [0.0] + [1.0] * 19


def test_large_matrices_are_refused(spark):
    with pytest.raises(ValueError, match="too large"):
        L.to_matrix(L.to_rows(spark, np.eye(2)), (10**5, 10**5))


def numpy_pair(src, tgt, qrels, train, k=10):
    """The pair evaluation on whole matrices, for the same split."""
    (sd, sq), (td, tq) = src, tgt
    mask = np.zeros(len(sd), bool)
    mask[train] = True
    a, b = np.vstack([sd[mask], sq]), np.vstack([td[mask], tq])
    if a.shape[1] == b.shape[1]:
        u, _, vt = np.linalg.svd(a.T @ b)
        m = u @ vt
    else:
        m = np.linalg.lstsq(a, b, rcond=None)[0]
    moved = sq @ m
    moved /= np.linalg.norm(moved, axis=1, keepdims=True)
    test = np.flatnonzero(~mask)

    def recall(queries):
        score = np.round(queries @ td[test].T, 6)
        top = {q: set(test[np.lexsort((test, -s))[:k]]) for q, s in enumerate(score)}
        judged = [(q, d) for q, d in qrels if not mask[d]]
        return sum(d in top[q] for q, d in judged) / len(judged)

    return recall(moved), recall(tq)


@pytest.fixture(scope="module")
def spaces(random):
    def unit(x):
        return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).astype(float)

    docs = random.normal(size=(400, 12))
    queries = docs[:60] + 0.5 * random.normal(size=(60, 12))
    rotation = np.linalg.qr(random.normal(size=(12, 12)))[0]
    wide = random.normal(size=(12, 16))
    out = {}
    for name, m in {"m/one": np.eye(12), "m/two": rotation, "m/three": wide}.items():
        noise = lambda x: 0.15 * random.normal(size=x.shape)
        out[name] = tuple(unit(x @ m + noise(x @ m)) for x in (docs, queries))
    return out


def test_grid_equals_numpy(spark, spaces):
    qrels = [(q, d) for q in range(60) for d in (q, q + 60)]
    table = vector_table(spark, spaces)
    judged = spark.createDataFrame(qrels, "query_row long, corpus_row long")
    rows = P.evaluate_pairs(table, judged, P.all_pairs(list(spaces)), train_size=200).collect()
    assert len(rows) == 6
    from tests.helpers import train_rows

    train = train_rows(400, 200)
    for r in rows:
        moved, native = numpy_pair(spaces[r.source], spaces[r.target], qrels, train)
        assert r.recall_at_10_translated == round(moved, 5)
        assert r.recall_at_10_native_target == round(native, 5)
        assert r.ratio == round(moved / native, 5)
        assert (r.train_docs, r.test_docs, r.seed) == (200, 200, 42)
        assert r.test_qrels == sum(d not in set(train) for _, d in qrels)
    assert {r.method for r in rows} == {"orthogonal_procrustes", "least_squares"}


@pytest.mark.parametrize("parts", [1, 16])
def test_pairs_do_not_depend_on_partitions(spark, spaces, parts):
    table = vector_table(spark, spaces)
    judged = spark.createDataFrame([(q, q) for q in range(60)], "query_row long, corpus_row long")
    one, two = (
        P.evaluate_grid(t, judged, train_size=150).drop("train_seconds", "solve_seconds", "aggregate_seconds")
        for t in (table.repartition(4), table.repartition(parts))
    )
    assert sorted(one.collect()) == sorted(two.collect())


def test_training_query_choices(spark, spaces):
    table = vector_table(spark, spaces)
    judged = spark.createDataFrame([(q, q) for q in range(60)], "query_row long, corpus_row long")
    seen = {}
    for how in P.TRAIN_QUERIES:
        row = P.evaluate_pairs(
            table, judged, [("m/one", "m/two")], train_size=100, train_queries=how
        ).first()
        assert row.train_queries == how and 0 < row.ratio <= 1.2
        seen[how] = row.recall_at_10_native_target
    assert len(set(seen.values())) == 1
    with pytest.raises(ValueError, match="train_queries"):
        P.evaluate_pairs(table, judged, [("m/one", "m/two")], train_size=100, train_queries="some")


def test_no_test_judgments_gives_no_rows(spark, spaces):
    from tests.helpers import train_rows

    judged = spark.createDataFrame([(0, int(train_rows(400, 200)[0]))], "query_row long, corpus_row long")
    got = P.evaluate_pairs(vector_table(spark, spaces), judged, [("m/one", "m/two")], train_size=200)
    assert got.count() == 0


def test_unequal_counts_raise(spark, spaces):
    table = vector_table(spark, spaces)
    short = table.where("not (model = 'm/two' and split = 'corpus' and row_idx = 3)")
    judged = spark.createDataFrame([(0, 0)], "query_row long, corpus_row long")
    with pytest.raises(ValueError, match="corpus counts differ"):
        P.evaluate_pairs(short, judged, [("m/one", "m/two")], train_size=10)
    with pytest.raises(FileNotFoundError):
        P.evaluate_pairs(table, judged, [("m/one", "m/none")], train_size=10)


def test_shifted_rows_raise(spark, spaces):
    table = vector_table(spark, spaces)
    moved = F.when((F.col("model") == "m/two") & (F.col("split") == "corpus"), F.col("row_idx") + 10).otherwise(F.col("row_idx"))
    judged = spark.createDataFrame([(0, 0)], "query_row long, corpus_row long")
    with pytest.raises(ValueError, match="corpus rows differ.*20}"):
        P.evaluate_pairs(table.withColumn("row_idx", moved), judged, [("m/one", "m/two")], train_size=10)


def test_ceilings(spark, spaces):
    judged = spark.createDataFrame([(q, q) for q in range(60)], "query_row long, corpus_row long")
    got = {r.model: r.recall_at_10 for r in ceilings(vector_table(spark, spaces), judged, list(spaces)).collect()}
    for name, (docs, queries) in spaces.items():
        score = np.round(queries @ docs.T, 6)
        hit = np.mean([q in np.lexsort((np.arange(400), -score[q]))[:10] for q in range(60)])
        assert abs(got[name] - hit) < 1e-12


def _frame(spark, a, b, parts):
    rows = [(i, [float(x) for x in ra], [float(x) for x in rb]) for i, (ra, rb) in enumerate(zip(a, b))]
    return spark.createDataFrame(rows, "i long, a array<double>, b array<double>").repartition(parts, "i")


def test_tall_r_through_the_tree(spark):
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(700, 6))
    b = rnd.normal(size=(700, 3))
    r = L.tall_r(_frame(spark, a, b, 9), ["a", "b"], [6, 3], fanout=2)
    both = np.hstack([a, b])
    assert r.shape == (9, 9)
    assert np.allclose(r.T @ r, both.T @ both)


def test_qr_recovers_what_the_gram_form_loses(spark):
    """Rows with singular values down to 1e-9: the planted map comes back to 1e-6 only through R."""
    rnd = np.random.default_rng(8)
    a = rnd.normal(size=(400, 16)) * (1e-9 ** (np.arange(16) / 15))
    planted = rnd.normal(size=(16, 5))
    b = a @ planted
    fitted = L.fit_least_squares_qr(_frame(spark, a, b, 5), "a", "b")
    assert np.abs(fitted.matrix - planted).max() < 1e-6
    assert fitted.rank == 16
    gram = L.solve_least_squares(L.spectrum(a.T @ a), a.T @ b)
    assert np.abs(gram.matrix - planted).max() > 1e-3


def test_qr_minimum_norm_when_rank_deficient(spark):
    rnd = np.random.default_rng(2)
    base = rnd.normal(size=(300, 4))
    a = np.hstack([base, base[:, :2]])  # two repeated columns
    b = rnd.normal(size=(300, 3))
    fitted = L.fit_least_squares_qr(_frame(spark, a, b, 4), "a", "b")
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    assert fitted.rank == 4
    assert np.allclose(fitted.matrix, want, atol=1e-8)


def test_qr_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "i long, a array<double>, b array<double>")
    r = L.tall_r(empty, ["a", "b"], [3, 2])
    made = L.solve_triangular_least_squares(r, 3)
    assert r.shape == (0, 5) and made.rank == 0 and not made.matrix.any()


def test_both_directions_share_one_tall_factor(spark, monkeypatch):
    rng = np.random.default_rng(21)
    a = rng.normal(size=(200, 5))
    b = np.hstack([a @ rng.normal(size=(5, 5)), rng.normal(size=(200, 2))])
    df = _frame(spark, a, b, 5)
    made, tall = [], L.tall_r
    monkeypatch.setattr(L, "tall_r", lambda *how, **more: made.append(1) or tall(*how, **more))
    maps = L.fit_many(df, {"a": 5, "b": 7}, [("a", "b"), ("b", "a")])
    assert len(made) == 1
    assert np.allclose(maps["a", "b"].matrix, np.linalg.lstsq(a, b, rcond=None)[0])
    assert np.allclose(maps["b", "a"].matrix, np.linalg.lstsq(b, a, rcond=None)[0])


def test_local_factor_takes_large_batches_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(22)
    a, b = rng.normal(size=(300, 4)), rng.normal(size=(300, 2))
    monkeypatch.setattr(L, "QR_BYTES", 1)
    r = L.tall_r(_frame(spark, a, b, 4), ["a", "b"], [4, 2])
    both = np.hstack([a, b])
    assert np.allclose(r.T @ r, both.T @ both)
