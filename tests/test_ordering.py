import hashlib

import pytest
from pyspark.sql import functions as F

from rebasis.operators import ordering as O
from rebasis.operators.fingerprint import flat_fingerprint, tree_fingerprint


def key(i, stream="", seed=42):
    return hashlib.md5(f"{seed}:{stream}{i}".encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_sample_is_a_prefix_of_the_key_order(spark, parts):
    ids = spark.range(3000).repartition(parts)
    wanted = sorted(range(3000), key=key)
    for n in (0, 1, 500, 3000):
        assert sorted(r.id for r in O.sample(ids, "id", n).collect()) == sorted(wanted[:n])


def test_counted_cut_equals_direct_cut(spark):
    ids = spark.range(5000)
    for n in (1, 17, 2500, 5000):
        assert O.find_cut(ids, "id", n, direct_rows=1) == O.find_cut(ids, "id", n)


@pytest.mark.parametrize("direct_rows", [1, 10_000])
def test_too_large_samples_raise(spark, direct_rows):
    with pytest.raises(ValueError, match="only 10 exist"):
        O.find_cut(spark.range(10), "id", 11, direct_rows=direct_rows)
    with pytest.raises(ValueError):
        O.find_cut(spark.range(10), "id", -1)


def test_samples_nest(spark):
    ids = spark.range(1000)
    less, more = O.sample(ids, "id", 100), O.sample(ids, "id", 400)
    assert less.join(more, "id", "left_anti").count() == 0


def test_split_is_exact_and_disjoint(spark):
    train, test, cut = O.split_train_test(spark.range(1000), "id", 333)
    assert (train.count(), test.count()) == (333, 667)
    assert train.intersect(test).count() == 0 and cut.n == 333


@pytest.mark.parametrize("parts", [1, 5])
def test_shuffled_index(spark, parts):
    ids = spark.range(2000).repartition(parts)
    got = {r.row_idx: r.id for r in O.shuffled_index(ids, "id").collect()}
    assert [got[n] for n in range(2000)] == sorted(range(2000), key=lambda i: key(i, "shuffle"))


@pytest.mark.parametrize("parts", [1, 7])
def test_sorted_index(spark, parts):
    df = spark.range(500).select(F.col("id").cast("string").alias("s"), "id").repartition(parts)
    got = {r.row_idx: r.s for r in O.sorted_index(df, ["s"]).collect()}
    assert [got[n] for n in range(500)] == sorted(map(str, range(500)))


def test_first_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "row_idx").repartition(3)
    assert [r.row_idx for r in O.first_rows(df, 3).collect()] == [0, 1, 2]


def _flat(ids):
    return hashlib.sha256(b"".join(f"{i}\0".encode() for i in ids)).hexdigest()[:16]


def test_flat_fingerprint(spark):
    df = spark.range(300).select(F.col("id").alias("row_idx"), (F.col("id") * 7).alias("doc_id"))
    row = flat_fingerprint(df.repartition(5), "doc_id").first()
    assert row == (_flat(7 * i for i in range(300)), 300)
    swapped = df.withColumn("doc_id", F.when(F.col("row_idx") == 0, 7).when(F.col("row_idx") == 1, 0).otherwise(F.col("doc_id")))
    assert flat_fingerprint(swapped, "doc_id").first().fingerprint != row.fingerprint
    assert flat_fingerprint(df.where("false"), "doc_id").first() == (hashlib.sha256().hexdigest()[:16], 0)


def test_delimiter_matters(spark):
    a = spark.createDataFrame([(0, "ab"), (1, "c")], "row_idx long, doc_id string")
    b = spark.createDataFrame([(0, "a"), (1, "bc")], "row_idx long, doc_id string")
    assert flat_fingerprint(a, "doc_id").first() != flat_fingerprint(b, "doc_id").first()


@pytest.mark.parametrize("parts", [1, 6])
def test_tree_fingerprint(spark, parts):
    n, chunk = 1234, 10
    level = [str(i) for i in range(n)]
    for _ in range(2):
        level = [
            hashlib.sha256(b"".join(f"{v}\0".encode() for v in level[i : i + chunk])).hexdigest()
            for i in range(0, len(level), chunk)
        ]
    df = spark.range(n).select(F.col("id").alias("row_idx"), F.col("id").alias("doc_id")).repartition(parts)
    assert tree_fingerprint(df, "doc_id", chunk=chunk).first() == (_flat(level), n)
