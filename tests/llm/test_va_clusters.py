import hashlib
import math
import random

import numpy as np

from rebasis.llm import va_clusters as va


def brute(rows, k=40, rounds=5, dim=64):
    """Plain Lloyd rounds over all kept rows, every distance measured."""
    kept = []
    for vid, vec in rows:
        if vec is None or len(vec) != dim or any(x is None or not math.isfinite(x) for x in vec):
            continue
        kept.append((vid, [math.floor(256 * float(x)) for x in vec]))
    if not kept:
        return []
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), ",".join(map(str, r[1])))
    cents = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
            j = min(range(len(cents)), key=lambda i: (d[i], i))
            out.append((j, d[j]))
        return out

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            members = [kept[i][1] for i, (c, _) in enumerate(got) if c == j]
            if members:
                cents[j] = [sum(col) // len(members) for col in zip(*members)]
    got = assign()
    per = {}
    for j, d in got:
        per[j] = per.get(j, 0) + d
    total = sum(per.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((vid, j, d, per[j], total, sha[j]) for (vid, _), (j, d) in zip(kept, got)), key=repr)


def frame(spark, rows, dim=64):
    return spark.createDataFrame(
        [(vid, vec, 7, "x", 1.5) for vid, vec in rows],
        "vec_id long, embedding array<float>, label int, cluster string, distance double").repartition(3)


def run(spark, rows, k=40):
    out = va.cluster(frame(spark, rows), k=k)
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in out.select(*cols).collect()), key=repr)


def blobs(n, seed=1, dim=64):
    rnd = random.Random(seed)
    centres = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = centres[rnd.randrange(6)]
        rows.append((i, [float(np.float32(x + rnd.gauss(0, 0.2))) for x in c]))
    return rows


def test_matches_plain_lloyd(spark):
    rows = blobs(600)
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    """Nulls, other lengths, NaN and infinity dropped; null ids and repeated rows kept; clashing columns replaced."""
    rows = blobs(120, seed=3)
    rows += [(1000, None), (1001, [0.5] * 63), (1002, [0.5] * 63 + [float("nan")]), (1003, [0.1] * 63 + [float("inf")]),
             (1004, [0.2] * 63 + [None]), (None, rows[0][1]), (None, rows[1][1]), rows[5], rows[5], (7, [0.0] * 64)]
    assert run(spark, rows) == brute(rows)


def test_fewer_vectors_than_k_and_ties(spark):
    rows = [(i, [0.0] * 64) for i in range(5)] + [(9, [1.0] * 64)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[1] for r in got if r[0] < 5} == {min(r[1] for r in got if r[0] < 5)}


def test_empty_and_all_dropped(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0] * 3)]) == []


def test_bounds_hold_exactly():
    """Every interval of the lookup tables holds the exact distance."""
    rnd = np.random.default_rng(5)
    q = rnd.integers(-300, 300, size=(400, 8))
    bounds = np.sort(np.stack([np.quantile(q[:, d], [i / 16 for i in range(1, 16)]).astype(np.int64) for d in range(8)]), 1)
    cells = va._codes(q, bounds)
    cents = rnd.integers(-300, 300, size=(7, 8))
    least, most = va._intervals(cents, bounds, q.min(0), q.max(0))
    exact = ((q[:, None, :] - cents[None]) ** 2).sum(2)
    dims = np.arange(8)
    lb = least[:, dims, cells].sum(2).T
    ub = most[:, dims, cells].sum(2).T
    assert (lb <= exact).all() and (exact <= ub).all()
    cluster, dist = va.assign_batch(cells, lambda r: q[r], cents, least, most)
    assert (cluster == np.argmin(exact, 1)).all() and (dist == exact.min(1)).all()
