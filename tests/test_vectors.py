import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rebasis.functions import vectors as V


def _frame(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "v array<double>")


def test_unit_and_zero(spark):
    rows = [[3.0, 4.0], [0.0, 0.0], [1e-12, 0.0]]
    got = [r[0] for r in _frame(spark, rows).select(V.unit("v")).collect()]
    assert got[0] == [0.6, 0.8]
    assert got[1] == [0.0, 0.0]
    assert got[2] == [1e-12 / V.NORM_FLOOR, 0.0]


def test_dot_norm_ratio(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0], 3, 0)], "a array<double>, b array<double>, x int, y int")
    row = df.select(V.dot("a", "b"), V.norm("b"), V.ratio("x", "y"), V.ratio("x", "x")).first()
    assert row[0] == 1.0 and abs(row[1] - 10**0.5) < 1e-12 and row[2] == 0.0 and row[3] == 1.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-60000, 60000, width=32), min_size=200, max_size=200))
def test_half_round_equals_numpy(spark, values):
    tiny = [x * 1e-8 for x in values[:50]]
    values = np.array(values + tiny + [0.0, 6e-8, 5.9e-8, 2.0**-24, 65504.0], np.float32)
    df = _frame(spark, [[float(x) for x in values]])
    once = V.half_round("v")
    row = df.select(once.alias("h"), V.half_round(once).alias("hh")).first()
    assert np.array_equal(np.array(row.h, np.float32), values.astype(np.float16).astype(np.float32))
    assert row.h == row.hh


def test_let_evaluates_once(spark):
    """A reference used in a lambda would otherwise be evaluated for every element."""
    df = spark.range(1).select(F.array(*(F.lit(float(i)) for i in range(10))).alias("v"))
    value = V.let(F.rand(1), lambda r: F.transform("v", lambda x: r))
    assert len(set(df.select(value).first()[0])) == 1


def test_dim_of(spark):
    assert V.dim_of(_frame(spark, [[1.0, 2.0]]), "v") == 2
    assert V.dim_of(_frame(spark, [[1.0]]).where("false"), "v") == 0
