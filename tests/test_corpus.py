import hashlib

import pytest
from pyspark.sql import functions as F

from rebasis.operators import diff
from rebasis.operators import judgments as J
from rebasis.plans import corpus as C
from rebasis.session import exists, fresh_path
from rebasis.sources import tables as src


@pytest.fixture(scope="module")
def raw(spark):
    docs = spark.range(300).select(
        F.col("id").alias("_id"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit(" t"), F.col("id").cast("string"))).alias("title"),
        F.concat(F.lit(" caf"), F.lit("Ã©"), F.col("id").cast("string")).alias("text"),
    )
    queries = spark.range(50).select(F.col("id").alias("_id"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("text"))
    qrels = spark.range(40).select(
        F.col("id").alias("query_id"), (F.col("id") * 3).alias("corpus_id"),
        F.when(F.col("id") < 30, 1).otherwise(0).alias("score"),
    ).union(spark.createDataFrame([(1, 99999, 2), (2, 7, 1)], "query_id long, corpus_id long, score int"))
    return docs, queries, qrels


SPEC = C.FreezeSpec(n_queries=12, n_docs=100, source="unit")


def test_freeze_writes_once(spark, raw):
    root = fresh_path(spark, "frozen")
    assert not exists(spark, f"{root}/manifest")
    tables = C.freeze(spark, *raw, root, SPEC)
    docs = {r.row_idx: r for r in tables.corpus.collect()}
    asked = {r.row_idx: r for r in tables.queries.collect()}
    assert sorted(docs) == list(range(100)) and sorted(asked) == list(range(12))
    ids = [asked[n].query_id for n in range(12)]
    assert ids == sorted(ids) and all(int(i) < 30 for i in ids)
    keyed = sorted(map(str, range(30)), key=lambda i: hashlib.md5(f"42:queries{i}".encode()).hexdigest())
    assert set(ids) == set(keyed[:12])
    for r in tables.qrels.collect():
        assert int(docs[r.corpus_row].doc_id) in (int(asked[r.query_row].query_id) * 3, 7)
    assert all(r.text.endswith(f"café{r.doc_id}") for r in docs.values())
    assert docs[0].text == docs[0].text.strip()

    held = src.manifest(spark, root).first()
    order = [docs[n].doc_id for n in range(100)]
    want = hashlib.sha256(b"".join(f"{i}\0".encode() for i in order)).hexdigest()[:16]
    assert (held.corpus_hash, held.n_corpus, held.n_queries, held.seed) == (None, 100, 12, 42)
    flat = C.manifest_row(tables, C.FreezeSpec(flat_hash=True)).first()
    assert flat.corpus_hash == want and flat.corpus_tree_hash == held.corpus_tree_hash
    with pytest.raises(FileExistsError, match="frozen"):
        C.freeze(spark, *raw, root, SPEC)


def test_frozen_corpora_of_two_sizes_share_queries_and_positives(raw):
    small = C.choose(*raw, SPEC)
    large = C.choose(*raw, C.FreezeSpec(n_queries=12, n_docs=200))
    assert small.query_cut == large.query_cut
    lost = small.documents.join(large.documents, "_id", "left_anti")
    assert lost.count() == 0 and large.documents.count() == 200


def test_missing_positives_are_dropped_and_listed(raw):
    spec = C.FreezeSpec(n_queries=30, n_docs=100)
    tables, chosen = C.frozen_frames(*raw, spec)
    assert [r.corpus_id for r in chosen.missing.collect()] == ["99999"]
    assert tables.qrels.count() == 31  # 30 queries, one with two positives


def test_freeze_reports_missing_documents(spark, raw):
    docs, queries, qrels = raw
    lost = spark.createDataFrame([(3, 99999, 1)], "query_id long, corpus_id long, score int")
    with pytest.warns(UserWarning, match="1 judged documents are not in the corpus"):
        tables = C.freeze(spark, docs, queries, qrels.union(lost), fresh_path(spark, "frozen"),
                          C.FreezeSpec(n_queries=30, n_docs=100))
    assert [r.doc_id for r in tables.missing.collect()] == ["99999"]


def test_query_without_positives_is_named(spark, raw):
    docs, queries, qrels = raw
    lost = spark.createDataFrame([(45, 77777, 1)], "query_id long, corpus_id long, score int")
    tables, _ = C.frozen_frames(docs, queries, qrels.union(lost), C.FreezeSpec(n_queries=31, n_docs=100))
    with pytest.raises(ValueError, match="query_without_positive: 1.*'45'"):
        C.require_invariants(tables, 100)


def test_too_many_positives_or_queries(raw):
    with pytest.raises(ValueError, match="exceed n_docs"):
        C.choose(*raw, C.FreezeSpec(n_queries=30, n_docs=5))
    with pytest.raises(ValueError, match="only 30 exist"):
        C.choose(*raw, C.FreezeSpec(n_queries=500, n_docs=100))


@pytest.mark.parametrize("parts", [1, 7])
def test_freeze_does_not_depend_on_partitions(raw, parts):
    tables, _ = C.frozen_frames(*(df.repartition(parts) for df in raw), SPEC)
    again, _ = C.frozen_frames(*raw, SPEC)
    assert tables.corpus.exceptAll(again.corpus).count() == 0
    assert tables.qrels.exceptAll(again.qrels).count() == 0


def test_corpus_without_titles(raw):
    docs, queries, qrels = raw
    tables, _ = C.frozen_frames(docs.drop("title"), queries, qrels, SPEC)
    assert tables.corpus.where(F.col("text").startswith("caf")).count() == 100


def test_invariants_find_every_defect(spark):
    corpus = spark.createDataFrame(
        [(0, "a", "x"), (0, "a", " "), (7, "c", None)], "row_idx long, doc_id string, text string"
    )
    queries = spark.createDataFrame([(0, "q", "x"), (1, "r", "y")], "row_idx long, query_id string, text string")
    qrels = spark.createDataFrame([(0, 0), (9, 5)], "query_row long, corpus_row long")
    got = {r.invariant: r.violations for r in C.invariants(C.Frozen(corpus, queries, qrels), 5).collect()}
    broken = {k: v for k, v in got.items() if v}
    assert broken == {
        "corpus_text_null": 1, "corpus_text_empty": 1, "corpus_row_range": 1,
        "corpus_doc_id_unique": 1, "corpus_row_idx_unique": 1, "qrels_corpus_row": 1,
        "qrels_query_row": 1, "query_without_positive": 1, "corpus_size": 2,
    }
    assert len(got) == 15


def test_snapshot_diff(spark):
    cols = "row_idx long, doc_id string, text string"
    a = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "c", "z"), (3, "d", None)], cols)
    b = spark.createDataFrame([(0, "a", "x"), (1, "b", "Y" * 200), (3, "d", None), (4, "e", "w")], cols)
    row = diff.snapshot_diff(a, b).first()
    assert row == (4, 4, False, False, 3)
    rows = diff.row_differences(a, b)
    assert {r.row_idx: r.kind for r in rows.collect()} == {1: "text", 2: "removed", 4: "added"}
    shown = diff.examples(rows, 2).collect()
    assert [r.row_idx for r in shown] == [1, 2] and len(shown[0].right_text) == 120
    assert diff.snapshot_diff(a, a).first() == (4, 4, True, True, 0)
    assert {(r.row_idx, r.only_in) for r in diff.alignment_gaps(a, b).collect()} == {(2, "source"), (4, "target")}


def test_renumbered_judgments(spark):
    docs = spark.range(50).withColumnRenamed("id", "row_idx")
    qrels = spark.createDataFrame([(0, 3), (1, 40), (2, 99)], "query_row long, corpus_row long")
    order = sorted(range(50), key=lambda i: hashlib.md5(f"42:split{i}".encode()).hexdigest())
    got = {r.corpus_row: r.test_row for r in J.renumbered(qrels, docs).collect()}
    assert got == {3: order.index(3), 40: order.index(40)}


def test_readers(spark):
    root = fresh_path(spark, "raw")
    docs = spark.createDataFrame([("1", "t", "x"), ("2", None, "y")], "_id string, title string, text string")
    docs.write.json(f"{root}/corpus.jsonl")
    docs.drop("title").write.json(f"{root}/queries.jsonl")
    pairs = spark.createDataFrame([("1", "2", 1)], "`query-id` string, `corpus-id` string, score int")
    pairs.write.csv(f"{root}/qrels/test.tsv", sep="\t", header=True)
    pairs.write.parquet(f"{root}/pairs")
    pairs.write.json(f"{root}/hyphens.jsonl")
    src.raw_qrels(spark, f"{root}/pairs").write.json(f"{root}/underscores.jsonl")
    corpus, queries, graded = src.benchmark_layout(spark, root)
    assert corpus.count() == 2 and queries.columns == ["_id", "text"]
    assert graded.first() == ("1", "2", 1)
    for name in ("qrels/test.tsv", "pairs", "hyphens.jsonl", "underscores.jsonl"):
        assert src.raw_qrels(spark, f"{root}/{name}").first() == ("1", "2", 1)
    spark.createDataFrame([(7, "x")], "_id int, text string").write.json(f"{root}/ints.json")
    assert src.raw_corpus(spark, f"{root}/ints.json").first() == ("7", None, "x")
    assert src.raw_corpus(spark, f"{root}/corpus.jsonl").count() == 2


def test_expected_metrics(spark):
    path = fresh_path(spark, "expected")
    text = src.expected_json({"m/a": 0.5, "m_b": 0.25}, tolerance=0.1)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    rows = {r.model: r for r in src.expected_metrics(spark, path).collect()}
    assert set(rows) == {"m/a", "m_b"} and rows["m/a"].ndcg_at_10 == 0.5
    assert rows["m_b"].scale == "0-1" and rows["m_b"].tolerance == 0.1
    assert src.expected_metrics(spark, None).count() == 0
    with pytest.warns(UserWarning, match="without comparison"):
        assert src.expected_metrics(spark, f"{path}-absent").count() == 0
