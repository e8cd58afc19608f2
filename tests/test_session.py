from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rebasis import session as S


def fake(folder=None, master="spark://host:7077", checkpoints=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder or default),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints),
    )


def test_shared_dir():
    assert S.shared_dir(fake("hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(fake())
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.shared_dir(fake(master="local-cluster[2,1,1024]"))
    assert S.shared_dir(fake(checkpoints="hdfs:///set/")) == "hdfs:///set"


def test_fresh_paths_differ(spark):
    assert S.fresh_path(spark, "x") != S.fresh_path(spark, "x")


def test_small_marks_only_bounded_tables(spark):
    df, other = spark.range(5), spark.range(10**6)

    def plan(n):
        return other.join(S.small(df, n), "id")._jdf.queryExecution().analyzed().toString()

    assert "ResolvedHint" in plan(5)
    assert "ResolvedHint" not in plan(S.BROADCAST_ROWS + 1)


def test_spread_leaves_many_splits_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert S.spread(spark.range(100, numPartitions=1), "id").rdd.getNumPartitions() == cores
    many = spark.range(100, numPartitions=cores + 1)
    assert S.spread(many, "id") is many


def test_stored_and_pinned_tables_are_whole(spark):
    df = spark.range(100).withColumn("part", F.col("id") % 3)
    kept = S.stored(df, "kept", ("part",))
    assert kept.exceptAll(df.select(kept.columns)).count() == 0 and kept.count() == 100
    assert "PartitionFilters: [isnotnull(part" in kept.where("part = 1")._jdf.queryExecution().toString()
    assert S.pin(df).exceptAll(df).count() == 0
