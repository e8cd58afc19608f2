import hashlib
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebasis import registry as R
from rebasis.operators import encode as E
from rebasis.functions.text import tokens
from rebasis.operators.fingerprint import flat_fingerprint
from rebasis.plans import audits as A
from rebasis.plans import corpus as C
from rebasis.plans import encoding as P
from rebasis.plans.reports import ceiling_lines, encode_summary, pair_summary
from rebasis.schemas import CEILINGS, MODELS, PAIR_RESULTS
from rebasis.session import fresh_path
from rebasis.sinks.tables import refuse_if_encoded, write_pair_results
from rebasis.sources import tables as src
from rebasis.sources.vectors import shard_totals, stored_shapes, vectors
from rebasis.streaming.encode_stream import encode_new_files

ENCODER = E.HashedTermEncoder(32)


def expected_vector(text, dim=32, salt=""):
    out = np.zeros(dim)
    for t in (text or "").lower().split():
        out[int(hashlib.md5((salt + t).encode()).hexdigest()[:8], 16) % dim] += 1
    return out / max(np.linalg.norm(out), 1e-8)


class Failing(E.HashedTermEncoder):
    def __init__(self, how):
        super().__init__(32, name="failing")
        self.how = how

    def load(self):
        how = self.how

        def call(texts):
            if how == "type":
                return np.zeros((len(texts), 32))
            if how == "dim":
                return np.zeros((len(texts), 31), np.float32)
            return np.random.default_rng().normal(size=(len(texts), 32)).astype(np.float32)

        return call


@pytest.mark.parametrize("half", [False, True])
def test_encode(spark, half):
    texts = ["a b a", "C c\nd", "", None, "x " * 5000]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, text string")
    got = {r.id: np.array(r.embedding, np.float32) for r in E.encode(df, ENCODER, half=half, batch_size=2).collect()}
    for n, t in enumerate(texts):
        want = expected_vector(t).astype(np.float32)
        assert np.array_equal(got[n], want.astype(np.float16).astype(np.float32) if half else want)


def test_prefix_and_cap(spark):
    df = spark.createDataFrame([("b c d",)], "text string")
    got = E.encode(df, ENCODER, prefix="a ", max_tokens=3).first().embedding
    assert np.allclose(got, expected_vector("a b c"))


@pytest.mark.parametrize("how,message", [("type", "expected float32"), ("dim", "expected")])
def test_wrong_encoder_output_raises(spark, how, message):
    df = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match=message):
        E.encode(df, Failing(how)).collect()


@pytest.fixture(scope="module")
def frozen(spark):
    docs = spark.range(250).select(
        F.col("id").alias("_id"), F.concat_ws(" ", F.lit("doc"), F.col("id").cast("string")).alias("text")
    )
    queries = spark.range(20).select(F.col("id").alias("_id"), F.concat_ws(" ", F.lit("doc"), F.col("id").cast("string")).alias("text"))
    qrels = spark.range(20).select(F.col("id").alias("query_id"), F.col("id").alias("corpus_id"), F.lit(1).alias("score"))
    root = fresh_path(spark, "frozen")
    C.freeze(spark, docs, queries, qrels, root, C.FreezeSpec(n_queries=20, n_docs=230))
    return root


JOB = {"split": "corpus", "encoder": ENCODER, "prefix_type": "doc", "prefix": "passage: ", "shard_rows": 50}


def test_encode_split_and_resume(spark, frozen):
    root = fresh_path(spark, "encoded")
    run = P.encode_split(spark, frozen, root, **JOB).first()
    assert (run.n_rows, run.n_shards, run.dim, run.prefix, run.dtype) == (230, 5, 32, "passage: ", "float16")
    assert run.corpus_tree_hash == src.manifest(spark, frozen).first().corpus_tree_hash and run.queries_tree_hash is None
    table = f"{root}/vectors"
    stored = vectors(spark, table, ENCODER.name, "corpus")
    texts = {r.row_idx: r.text for r in src.frozen(spark, frozen, "corpus").collect()}
    for r in stored.collect():
        want = expected_vector("passage: " + texts[r.row_idx]).astype(np.float16).astype(np.float32)
        assert np.array_equal(np.array(r.embedding, np.float32), want) and r.shard_id == r.row_idx // 50
    plan = stored._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(model" in plan

    with pytest.raises(FileExistsError, match="force"):
        P.encode_split(spark, frozen, root, **JOB)
    held = src.manifest(spark, frozen).first().corpus_tree_hash
    expected = E.expected_shards(src.frozen(spark, frozen, "corpus"), 50)
    model, split = ENCODER.name, "corpus"
    assert E.resume_plan(expected, stored, model, split, "passage: ", held, "1").count() == 0
    assert E.resume_plan(expected, stored, model, split, "other: ", held, "1").count() == 5
    assert E.resume_plan(expected, stored, model, split, "passage: ", "x", "1").count() == 5
    assert E.resume_plan(expected, stored, model, split, "passage: ", held, "2").count() == 5
    assert E.resume_plan(expected, stored, model, split, "passage: ", held, "1", 512).count() == 5
    with pytest.raises(ValueError, match="33 are registered"):
        P.encode_split(spark, frozen, root, **JOB, force=True, registered_dim=33)

    run = P.encode_split(spark, frozen, root, **{**JOB, "prefix": "other: "}, force=True).first()
    assert [r.prefix for r in src.encode_runs(spark, root).collect()] == ["other: "]
    assert run.prefix == "other: " and vectors(spark, table, model, split).count() == 230
    assert {r.prefix for r in vectors(spark, table).select("prefix").distinct().collect()} == {"other: "}
    with pytest.raises(FileNotFoundError):
        vectors(spark, table, "no/model")


def test_only_missing_shards_are_encoded(spark, frozen):
    root = fresh_path(spark, "vectors")
    rows = src.frozen(spark, frozen, "corpus")
    expected = E.expected_shards(rows, 50)
    args = (ENCODER, "m", "corpus", "", "h", root)
    P.encode_pending(rows, expected.where("shard_id in (0, 2)"), *args, shard_rows=50)
    before = vectors(spark, root).select("shard_id", "_metadata.file_name").distinct().collect()
    short = vectors(spark, root)
    pending = E.resume_plan(expected, short, "m", "corpus", "", "h", ENCODER.revision)
    assert sorted(r.shard_id for r in pending.collect()) == [1, 3, 4]
    P.encode_pending(rows, pending, *args, shard_rows=50)
    after = vectors(spark, root).select("shard_id", "_metadata.file_name").distinct().collect()
    assert set(before) < set(after)
    total = shard_totals(vectors(spark, root)).first()
    assert (total.n_shards, total.n_rows) == (5, 230)


def test_drift_is_refused(spark, frozen):
    rows = src.frozen(spark, frozen, "corpus")
    held = src.manifest(spark, frozen)
    key, value = P.verify_input(rows, held)
    assert key == "corpus_tree_hash" and len(value) == 16
    with pytest.raises(ValueError, match="corpus_tree_hash mismatch"):
        P.verify_input(rows, held.withColumn("corpus_tree_hash", F.lit("0" * 16)))
    with pytest.raises(ValueError, match="drifted"):
        P.verify_input(rows.where("row_idx > 0"), held)
    none = held.withColumn("corpus_tree_hash", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="no fingerprint"):
        P.verify_input(rows, none)
    flat = none.withColumn("corpus_hash", F.lit(flat_fingerprint(rows, "doc_id").first().fingerprint))
    assert P.verify_input(rows, flat)[0] == "corpus_hash"


def test_run_is_refused_by_another_manifest(spark, frozen):
    root = fresh_path(spark, "encoded")
    P.encode_split(spark, frozen, root, **JOB)
    runs, held = src.encode_runs(spark, root).drop("sidecar"), src.manifest(spark, frozen)
    A.require_hashes(runs, held)
    tables = C.load(spark, frozen)
    short = C.Frozen(tables.corpus.where("row_idx < 100"), tables.queries, tables.qrels)
    with pytest.raises(ValueError, match="corpus_tree_hash"):
        A.require_hashes(runs, C.manifest_row(short, C.FreezeSpec()))
    with pytest.raises(ValueError, match="1 in all"):
        A.require_hashes(runs, held.withColumn("corpus_tree_hash", F.lit(None).cast("string")))


def test_own_query_prompt(spark):
    own = Failing("dim")
    own.name, own.query_prompt = "Qwen/Qwen3-Embedding-0.6B", "Own: "
    models = R.models(spark)
    assert R.prefix_of(models, own, "query") == "Own: "
    assert R.prefix_of(models, own, "doc") == R.prefix_for(models, own.name, "doc")


def test_tokens_of_the_encoder_are_those_of_the_columns(spark):
    text = "a\u00a0b C\tc\x0bd \x1c e  \n"
    df = spark.createDataFrame([(text,)], "text string")
    want = [t for t in df.select(tokens(F.lower("text")).alias("t")).first().t]
    got = ENCODER.load()(np.array([text, None, ""], object))
    assert got[0].sum() == len(want) and not got[1:].any()
    for t in want:
        assert got[0] @ ENCODER.load()(np.array([t], object))[0] > 0


def test_grid_reports_failures(spark, frozen):
    root = fresh_path(spark, "encoded")
    bad = {**JOB, "encoder": Failing("dim")}
    rows = P.encode_grid(spark, frozen, root, [bad, JOB]).collect()
    assert [(r.subject, r.status) for r in rows] == [("failing/corpus", "FAIL"), ("hashed-terms-32/corpus", "OK")]
    refuse_if_encoded(src.encode_runs(spark, root), "failing", "corpus")


def test_pretty_sidecars(spark):
    path = fresh_path(spark, "sidecar")
    text = '{\n  "model": "m/a",\n  "split": "corpus",\n  "n_rows": 7,\n  "seconds": 2.0\n}'
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    row = src.sidecars(spark, path, pretty=True).first()
    assert (row.model, row.n_rows) == ("m/a", 7) and row.sidecar.endswith(".txt")
    assert encode_summary(src.sidecars(spark, path, pretty=True)).first() == ("m_a", "corpus", 7, None, 3.5)


def test_streaming_encodes_new_files_once(spark):
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    docs.where("doc_id < 4").coalesce(1).write.parquet(source)
    args = (spark, source, docs.schema, out, state, ENCODER)
    encode_new_files(*args)
    assert vectors(spark, out).count() == 4
    encode_new_files(*args)
    assert vectors(spark, out).count() == 4
    # a batch that runs again, as after a crash before the checkpoint was written
    encode_new_files(spark, source, docs.schema, out, fresh_path(spark, "other-state"), ENCODER)
    assert vectors(spark, out, ENCODER.name, "corpus").count() == 4
    docs.where("doc_id >= 4").repartition(3).write.mode("append").parquet(source)
    encode_new_files(*args, files_per_batch=1)
    rows = {r.row_idx: r.embedding for r in vectors(spark, out).collect()}
    assert sorted(rows) == list(range(10))
    want = expected_vector("text 7").astype(np.float16)
    assert np.array_equal(np.array(rows[7], np.float16), want)


def table(spark, rows):
    return spark.createDataFrame(rows, "model string, split string, row_idx long, embedding array<float>")


def test_dim_audit(spark):
    nan = float("nan")
    found = table(spark, [
        ("good", "corpus", 0, [1.0, 0.0]), ("good", "queries", 0, [0.0, 0.0]),
        ("bad", "corpus", 0, [1.0, 0.0]), ("bad", "corpus", 1, [1.0]), ("bad", "queries", 0, [nan, 1.0]),
    ])
    known = spark.createDataFrame(
        [(m, 2, {"query": "", "doc": ""}, 1, 1, False) for m in ("good", "bad", "gone")], MODELS
    )
    got = {(r.model, r.split): r for r in A.dim_audit(found, known).collect()}
    assert {k: r.status for k, r in got.items()} == {
        ("good", "corpus"): "OK", ("good", "queries"): "OK", ("bad", "corpus"): "FAIL",
        ("bad", "queries"): "OK", ("gone", "corpus"): "SKIP", ("gone", "queries"): "SKIP",
    }
    assert got["good", "queries"].n_zero == 1 and got["bad", "queries"].n_nan == 1
    assert got["bad", "corpus"].min_dim == 1 and got["gone", "corpus"].n_rows == 0
    assert stored_shapes(found).count() == 4


def test_determinism_audit(spark):
    texts = spark.createDataFrame([(f"text {i}",) for i in range(20)], "text string")
    good = A.determinism_audit(texts, ENCODER).first()
    assert good.status == "OK" and good.n_texts == 20 and abs(good.min_cosine - 1) < 1e-6
    assert A.determinism_audit(texts, Failing("random")).first().status == "FAIL"


def test_prefix_audit(spark):
    asked = spark.createDataFrame([(0, "a b"), (1, "c")], "row_idx long, text string")
    docs = spark.createDataFrame([(0, "x y"), (1, "z"), (2, "w")], "row_idx long, text string")
    qrels = spark.createDataFrame([(0, 2), (0, 0), (1, 1)], "query_row long, corpus_row long")

    def audit(q, d, n=100):
        return A.prefix_audit(qrels, asked, docs, ENCODER, q, d, n).first()

    same = audit("shared ", "shared ")
    assert same.status == "OK" and same.n_pairs == 2
    want = np.mean([
        expected_vector("shared " + q) @ expected_vector("shared " + d) for q, d in (("a b", "x y"), ("c", "z"))
    ])
    assert abs(same.with_prefix - want) < 1e-6
    assert audit("shared ", "shared ", 1).n_pairs == 1
    assert audit("", "").status == "SKIP"
    assert audit("foo ", "").status == "WARN"


def test_metric_audit(spark):
    measured = spark.createDataFrame(
        [("o/near", 0.70), ("o/far", 0.70), ("o/none", 0.70), ("o/percent", 0.70)], "model string, ndcg double"
    )
    expected = spark.createDataFrame(
        [("o/near", 0.71, None, "0-1", 0.02), ("o_near", 0.1, None, "0-1", 0.02), ("o_far", 0.75, None, "0-1", 0.02), ("o/percent", 70.5, None, "0-100", 2.0)],
        "model string, ndcg_at_10 double, source string, scale string, tolerance double",
    )
    def got(**how):
        return {r.model: r.status for r in A.metric_audit(measured, expected, **how).collect()}
    assert got() == {"o/near": "OK", "o/far": "FAIL", "o/none": "??", "o/percent": "OK"}
    assert got(tolerance=0.2)["o/far"] == "OK"


def test_hash_audit(spark):
    runs = spark.createDataFrame(
        [("a", "corpus", "h1", None), ("b", "corpus", "h0", None), ("a", "queries", None, "g1")],
        "model string, split string, corpus_hash string, queries_hash string",
    )
    held = spark.createDataFrame([("h1", "g1")], "corpus_hash string, queries_hash string")
    got = {(r.model, r.split, r.kind): r.status for r in A.hash_audit(runs, held).collect()}
    assert got["a", "corpus", "corpus_hash"] == "OK" and got["b", "corpus", "corpus_hash"] == "FAIL"
    assert got["a", "queries", "queries_hash"] == "OK" and got["a", "corpus", "queries_hash"] == "SKIP"
    with pytest.raises(ValueError, match="b/corpus corpus_hash h0 != h1"):
        A.require_hashes(runs, held)
    A.require_hashes(runs.where("model = 'a'"), held)


def test_totals_audit(spark):
    found = table(spark, [("m", "corpus", i, [1.0]) for i in range(3)]).withColumn("shard_id", F.lit(0))
    for n, status in ((3, "OK"), (4, "FAIL")):
        rows = spark.createDataFrame([("corpus", n)], "split string, expected_rows long")
        assert A.totals_audit(found, rows).first().status == status
    assert A.stored_type_ok(found)
    assert not A.stored_type_ok(found.withColumn("embedding", F.col("embedding").cast("array<double>")))


def test_check_runner(spark):
    def rows(*statuses):
        made = spark.createDataFrame([(s,) for s in statuses], "status string")
        return lambda: A.as_checks("x", made, F.lit("s"), F.lit(""))

    def broken():
        raise RuntimeError("boom")

    checks = {"good": rows("OK", "SKIP"), "bad": rows("OK", "WARN"), "broken": broken}
    results = A.run_checks(spark, checks)
    assert results.where("check_name = 'broken'").first().detail == "boom"
    assert A.exit_code(results) == 1
    assert A.exit_code(A.run_checks(spark, checks, ["good"])) == 0
    assert A.run_checks(spark, checks, ["all"]).count() == 5
    with pytest.raises(KeyError, match="no such checks"):
        A.run_checks(spark, checks, ["other"])
    done = results.withColumn("check_name", F.when(F.col("detail") == "boom", "broken").otherwise("x"))
    got = {r.check_name: r for r in A.summary(done).collect()}
    assert (got["x"].n_passed, got["x"].n_failed, got["x"].n_unknown) == (2, 1, 1)
    assert not got["broken"].passed


def test_registry(spark):
    models = R.models(spark)
    assert models.count() == 6
    assert R.prefix_for(models, "intfloat/e5-base-v2", "doc") == "passage: "
    assert R.prefix_for(models, "Alibaba-NLP/gte-base-en-v1.5", "query") == ""
    for model, side in (("no/model", "doc"), ("intfloat/e5-base-v2", "title")):
        with pytest.raises(KeyError, match="add the model"):
            R.prefix_for(models, model, side)
    asked = spark.createDataFrame(
        [("intfloat/e5-base-v2", "query"), ("Qwen/Qwen3-Embedding-4B", "query"), ("no/model", "doc")],
        "model string, side string",
    )
    assert R.attach_prefix(asked, models).count() == 2
    assert R.unregistered(asked, models).collect() == [("no/model", "doc")]
    own = asked.join(models.select("model", "prefix"), "model").select(
        "model", R.effective_prefix(F.lit("own: ")).alias("p")
    )
    assert {r.model: r.p for r in own.collect()} == {
        "intfloat/e5-base-v2": "query: ", "Qwen/Qwen3-Embedding-4B": "own: ",
    }
    pairs = R.model_pairs(models).collect()
    assert len(pairs) == 30 and all(a != b for a, b in pairs)


def test_reports(spark):
    row = ("org/a-long-source-model-name", "org/b", "m", 1, 1, 1, 1, 1, 1, 0.5, 1.0, 0.5, 0.1, 42, "all", 1, 0.1, 0.2)
    results = spark.createDataFrame([row], PAIR_RESULTS)
    assert pair_summary(results).first() == ("a-long-source-mode", "b", "0.50000", "1.00000", "0.50000")
    path = fresh_path(spark, "pairs")
    write_pair_results(results, path)
    assert spark.read.schema(PAIR_RESULTS).json(path).first() == row
    lines = ceiling_lines(spark.createDataFrame([("m", 0.998)], CEILINGS))
    assert lines.first() == ("m", "recall@10 = 0.99800")


def test_small_shards_share_write_tasks(spark, monkeypatch):
    """Hundreds of shards of a few rows are written by tasks that follow from cores and rows."""
    rows = spark.range(600).selectExpr("id AS row_idx", "concat('a b ', id) AS text")
    expected = E.expected_shards(rows, 2)
    tasks, write = [], P.write_vectors
    monkeypatch.setattr(P, "write_vectors", lambda df, *how: tasks.append(df.rdd.getNumPartitions()) or write(df, *how))
    root = fresh_path(spark, "vectors")
    P.encode_pending(rows, expected, ENCODER, "m", "corpus", "", "h", root, shard_rows=2)
    assert tasks[0] <= 4 * spark.sparkContext.defaultParallelism
    made = vectors(spark, root, "m", "corpus")
    assert made.select("shard_id").distinct().count() == 300 and made.count() == 600


def test_encoder_remembers_a_bounded_number_of_tokens():
    """Tokens that come once do not pile up; forgotten ones get the same bucket again."""
    tracemalloc.start()
    try:
        call = E.HashedTermEncoder(8).load()
        for lo in range(0, 600_000, 20_000):
            call(np.array([" ".join(f"token-{n}" for n in range(lo, lo + 20_000))], object))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 32 << 20
    given = ("token-7", "token-599999", "x" * 200)
    assert call(np.array([" ".join(given)], object))[0].tolist() == _counts8(*given).tolist()


def _bucket8(token):
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % 8


def _counts8(*given):
    return np.bincount([_bucket8(t) for t in given], minlength=8)


def test_model_is_loaded_once_a_worker():
    key, model = "k", E.HashedTermEncoder(8)
    first = E._model(key, model)
    assert E._model(key, model) is first
    for n in range(E.MODELS_HELD):
        E._model(f"other-{n}", model)
    assert len(E._LOADED) == E.MODELS_HELD and E._model(key, model) is not first
