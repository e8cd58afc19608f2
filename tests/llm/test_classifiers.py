import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rebasis.llm import quality_model as q, toxicity as t
from rebasis.llm.common import fold, table
from tests.conftest import SMALL

MIDDLE = SMALL.replace("sf0.001", "sf0.1")


def auc(scores, labels):
    order = sorted(zip(scores, labels))
    wins = below = 0.0
    i = 0
    while i < len(order):
        j = i
        while j < len(order) and order[j][0] == order[i][0]:
            j += 1
        ones = sum(y for _, y in order[i:j])
        wins += ones * (below + (j - i - ones) / 2)
        below += j - i - ones
        i = j
    return wins / (sum(labels) * (len(labels) - sum(labels)))


def test_fold(spark):
    got = spark.range(300).select("id", fold(F.col("id"), 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in got)
    assert spark.range(1).select(fold(F.lit(None).cast("long"), 3).alias("f")).first().f == 0


def ftrl(rows, bits, epochs, alpha=0.5, beta=1.0, l1=0.02, l2=0.05):
    """The update rule, a coordinate at a time."""
    z, n = {}, {}

    def weight(i, l1_, l2_):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1_ else -(zi - math.copysign(l1_, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2_)

    for _ in range(epochs):
        for slots, values, y in rows:
            x = [*zip(slots.tolist(), values.tolist()), ("bias", 1.0)]
            w = {i: weight(i, 0 if i == "bias" else l1, 0 if i == "bias" else l2) for i, _ in x}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x)))
            for i, v in x:
                g = (p - y) * v
                s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - s * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return [weight(i, l1, l2) for i in range(1 << bits)], weight("bias", 0, 0)


def test_ftrl_equals_the_rule():
    rng = random.Random(2)
    rows = []
    for _ in range(60):
        y = rng.randrange(2)
        text = " ".join(rng.choices(["good", "fine", "text"] if y else ["bad", "junk", "text"], k=6))
        rows.append((*q.features(text.encode(), 8), y))
    model = q.train(rows, 8, 2)
    weights, bias = ftrl(rows, 8, 2)
    assert np.allclose(model.weights, weights, atol=1e-6) and math.isclose(model.bias, bias, abs_tol=1e-9)


def held_out(spark, module, column, parts, out):
    docs, labels = table(spark, MIDDLE, "documents"), table(spark, MIDDLE, "labels")
    model = module.fit(docs, labels, fold(F.col("doc_id"), parts) != out, column)
    rows = module.score(docs, model).join(labels, "doc_id").where(fold(F.col("doc_id"), parts) == out).collect()
    return [r.score for r in rows], [r[column] for r in rows]


def test_quality_held_out(spark):
    scores, labels = held_out(spark, q, "quality", 3, 1)
    assert auc(scores, labels) > 0.93
    assert np.mean([(s >= 0.5) == y for s, y in zip(scores, labels)]) > 0.93


def test_toxicity_held_out(spark):
    scores, labels = held_out(spark, t, "toxic", 5, 0)
    assert auc(scores, labels) > 0.83
    assert np.mean([(s >= 0.5) == y for s, y in zip(scores, labels)]) > 0.94


@pytest.mark.parametrize("module,column", [(q, "quality"), (t, "toxic")])
def test_edge_rows_and_labels(spark, frame, edge_rows, module, column):
    df = frame(edge_rows)
    for labels in ([], [(5, 1), (6, None)], [(5, 1), (6, 0), (8, 1), (9, 0), (5, 0), (None, 1), (77, 0)]):
        known = spark.createDataFrame(labels, f"doc_id long, {column} int")
        model = module.fit(df, known, F.lit(True), column)
        rows = module.score(df, model).collect()
        assert len(rows) == len(edge_rows) and all(0 <= r.score <= 1 for r in rows)
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in edge_rows)
        if len(labels) == 0:
            assert {r.score for r in rows} == {0.5}
    assert module.score(frame([]), model).count() == 0


def test_labels_of_the_held_out_fold_are_not_read(spark, frame):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["you", "idiot", "scum"] if i % 2 else ["fine", "calm", "words"], k=30)), "a") for i in range(80)]
    df = frame(rows)
    keep = fold(F.col("doc_id"), 5) != 0
    a = spark.createDataFrame([(i, i % 2) for i, *_ in rows], "doc_id long, y int")
    b = a.withColumn("y", F.when(keep, F.col("y")).otherwise(1 - F.col("y")))
    for module in (q, t):
        got = [sorted(module.score(df, module.fit(df, x, keep, "y")).collect()) for x in (a, b)]
        assert got[0] == got[1]


def test_windows_cover_the_text_and_cut_between_words():
    text = " ".join(f"word{i}" for i in range(999)).encode()
    cut = t.windows(text)
    assert b" ".join(w.strip() for w in cut) == text and all(w.startswith(b" ") and w.endswith(b" ") for w in cut)
    assert t.windows(None) == t.windows(b" \n ") == [b""]
    assert t.windows(b"x" * 9999) == [b" " + b"x" * 9999 + b" "]
