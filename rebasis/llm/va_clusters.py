"""Centroid clustering (Lloyd's k-means) over a VA-file of integer vectors.

Each vector is stored twice: as few-bit cells per dimension (the approximation) and whole.
The cell bounds of a dimension are approximate quantiles of all its values, found by one
aggregate over the table. In every round the k centroids (k x d integers, the only thing
broadcast) give, per centroid and dimension, a lookup table of the least and largest squared
distance to each cell. Summing a vector's table entries over its cells gives an interval that
holds its exact distance to each centroid. Only centroids whose lower bound does not exceed the
least upper bound can be the nearest; the whole vector is fetched (taken from the batch) only
for the rows where two or more such intervals overlap, and its exact distances decide. So the
result is that of plain Lloyd rounds, exactly.

A round's new centroids are summed in each task as exact integers, merged by cluster (k rows)
and divided on the driver: only k x d numbers travel. No row, group or table passes through the
driver; the vectors are read once per round from a stored table.

Edge cases, by definition:

* rows whose vector is null, of another length, or holds a null, NaN or infinite component are
  dropped; an empty or wholly dropped table gives an empty result;
* a null ``vec_id`` keeps its row; its seed key is the hash of ``2:`` alone (ranked as any
  other); rows tied on the seed key are ordered by their vector's text;
* repeated rows are separate vectors, each counted and returned;
* fewer vectors than ``k``: every vector is a seed;
* ties in distance go to the centroid of the smaller number; an empty cluster keeps its
  centroid;
* component magnitudes above 2^26 would overflow 64-bit distances and raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from rebasis.llm.common import stored

# Parameters of the operator; the query's contract fixes the first four.
DIM = 64
K = 40
ROUNDS = 5
SCALE = 256
CELL_BITS = 4
LIMIT = 1 << 26


def integer_vectors(table: DataFrame, column: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Rows with a whole vector of ``dim`` finite components, as integers floor(scale * x)."""
    x = F.col(column)
    whole = (F.size(x) == dim) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return table.where(x.isNotNull() & whole).withColumn(
        "_va_q", F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def cell_bounds(vectors: DataFrame, dim: int = DIM, bits: int = CELL_BITS) -> np.ndarray:
    """Per dimension, the 2^bits - 1 inner cell bounds: approximate quantiles of all its values."""
    cells = 1 << bits
    probs = [i / cells for i in range(1, cells)]
    row = vectors.agg(*[F.percentile_approx(F.col("_va_q")[i], probs, 10_000).alias(f"b{i}")
                        for i in range(dim)]).first()
    return np.array([sorted(row[f"b{i}"]) for i in range(dim)], dtype=np.int64)


def _codes(q: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(bounds[d], q[:, d], side="right") for d in range(q.shape[1])], 1).astype(np.uint8)


def _matrix(lists: pa.ListArray, dim: int) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), dim)


def va_table(vectors: DataFrame, bounds: np.ndarray, dim: int = DIM) -> DataFrame:
    """The VA-file: every row with its cells (one byte a dimension) and its whole vector, stored."""
    spark = vectors.sparkSession
    b = spark.sparkContext.broadcast(bounds)
    keep = [c for c in vectors.columns if c != "_va_q"]
    ordered = vectors.select(*[F.col(c).alias(f"_va_c{i}") for i, c in enumerate(keep)], "_va_q")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("_va_q"), dim)
            if len(q) and np.abs(q).max() > LIMIT:
                raise ValueError("vector components beyond 2^26 would overflow 64-bit distances")
            codes = _codes(q, b.value)
            cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(codes), [None, pa.py_buffer(codes.tobytes())])
            yield batch.append_column("_va_cells", cells.cast(pa.binary()))

    schema = StructType(list(ordered.schema.fields) + [StructField("_va_cells", BinaryType())])
    coded = ordered.mapInArrow(encode, schema)
    return stored(coded, "va-file"), keep


def _intervals(c: np.ndarray, bounds: np.ndarray, lo_all: np.ndarray, hi_all: np.ndarray):
    """Per centroid, dimension and cell: least and largest squared distance (k x d x cells)."""
    lo = np.concatenate([lo_all[:, None], bounds], 1)            # d x cells: least value of a cell
    hi = np.concatenate([bounds - 1, hi_all[:, None]], 1)        # largest value of a cell
    hi = np.maximum(hi, lo)
    cc = c[:, :, None]
    below = np.where(cc < lo[None], lo[None] - cc, 0)
    above = np.where(cc > hi[None], cc - hi[None], 0)
    least = np.maximum(below, above) ** 2
    most = np.maximum(np.abs(cc - lo[None]), np.abs(cc - hi[None])) ** 2
    return least, most


def assign_batch(cells: np.ndarray, whole, centroids: np.ndarray, least: np.ndarray, most: np.ndarray,
                 distances: bool = True):
    """Nearest centroid of each row, and its exact squared distance if ``distances``.

    The cells alone decide every row whose interval of one centroid lies below all others;
    ``whole(rows)`` fetches the full vectors of the other rows (and, for distances, of the
    decided rows, to measure the one winning centroid).
    """
    n, d = cells.shape
    dims = np.arange(d)
    lb = least[:, dims, cells].sum(2).T                      # n x k
    ub = most[:, dims, cells].sum(2).T
    cand = lb <= ub.min(1, keepdims=True)
    one = cand.sum(1) == 1
    cluster = np.argmax(cand, 1)
    dist = np.zeros(n, np.int64)
    amb = np.nonzero(~one)[0]
    if len(amb):
        v = whole(amb)
        exact = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
        exact = np.where(cand[amb], exact, np.iinfo(np.int64).max)
        cluster[amb] = np.argmin(exact, 1)
        dist[amb] = exact[np.arange(len(amb)), cluster[amb]]
    sure = np.nonzero(one)[0]
    if distances and len(sure):
        v = whole(sure)
        dist[sure] = ((v - centroids[cluster[sure]]) ** 2).sum(1)
    return cluster, dist


def _cells(column: pa.Array, dim: int) -> np.ndarray:
    """The cells of a batch, straight from the Arrow buffers (every value is ``dim`` bytes)."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0]: offsets[-1]].reshape(-1, dim)


def _assigner(spark, centroids: np.ndarray, bounds: np.ndarray, lo_all: np.ndarray, hi_all: np.ndarray, dim: int):
    least, most = _intervals(centroids, bounds, lo_all, hi_all)
    shared = spark.sparkContext.broadcast((centroids, least, most))

    def assign(batch: pa.RecordBatch, distances: bool = True):
        c, lst, mst = shared.value
        lists = batch.column("_va_q")
        return assign_batch(_cells(batch.column("_va_cells"), dim),
                            lambda rows: _matrix(lists.take(pa.array(rows)), dim), c, lst, mst, distances)

    return assign


def lloyd(va: DataFrame, seeds: np.ndarray, bounds: np.ndarray, lo_all, hi_all, rounds: int = ROUNDS, dim: int = DIM):
    """Centroids after ``rounds`` Lloyd rounds from ``seeds``: each task sums its rows by cluster."""
    spark = va.sparkSession
    centroids = seeds.copy()
    k = len(centroids)
    for _ in range(rounds):
        assign = _assigner(spark, centroids, bounds, lo_all, hi_all, dim)

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((k, dim), dtype=object)
            counts = np.zeros(k, np.int64)
            for batch in batches:
                if batch.num_rows == 0:
                    continue
                cluster, _ = assign(batch, distances=False)
                q = _matrix(batch.column("_va_q"), dim)
                for j in np.unique(cluster):
                    sums[j] += q[cluster == j].sum(0).astype(object)
                    counts[j] += int((cluster == j).sum())
            live = np.nonzero(counts)[0]
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(live.astype(np.int32)), "n": pa.array(counts[live]),
                "s": pa.array([[str(int(x)) for x in sums[j]] for j in live], pa.list_(pa.string()))})

        parts = va.select("_va_cells", "_va_q").mapInArrow(partial, "cluster int, n long, s array<string>")
        merged = parts.groupBy("cluster").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]).collect()
        for r in merged:
            centroids[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
    return centroids


def seeds_of(vectors: DataFrame, k: int = K, salt: str = "2") -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``<salt>:<vec_id>`` (ties: the vector's text), in that order."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    text = F.concat_ws(",", F.transform("_va_q", lambda v: v.cast("string")))
    top = vectors.select(key.alias("h"), text.alias("t"), "_va_q").orderBy("h", "t").limit(k).collect()
    return np.array([r["_va_q"] for r in top], dtype=np.int64).reshape(len(top), -1 if top else 0)


def centroid_sha(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()


def cluster(table: DataFrame, column: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM,
            scale: int = SCALE, bits: int = CELL_BITS) -> DataFrame:
    """Every kept row with ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    The table's own columns come first (a clashing name is replaced by the result's).
    """
    spark = table.sparkSession
    vectors = integer_vectors(table, column, dim, scale)
    seeds = seeds_of(vectors, k)
    names = ["cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if len(seeds) == 0:  # no kept vector: ``vectors`` is empty
        kinds = ["int", "long", "long", "long", "string"]
        return vectors.select(*[c for c in table.columns if c not in names],
                              *[F.lit(None).cast(t).alias(n) for n, t in zip(names, kinds)])
    bounds = cell_bounds(vectors, dim, bits)
    ends = vectors.agg(*[F.min(F.col("_va_q")[i]) for i in range(dim)], *[F.max(F.col("_va_q")[i]) for i in range(dim)]).first()
    lo_all = np.array(ends[:dim], np.int64)
    hi_all = np.array(ends[dim:], np.int64)
    va, keep = va_table(vectors, bounds, dim)
    centroids = lloyd(va, seeds, bounds, lo_all, hi_all, rounds, dim)
    assign = _assigner(spark, centroids, bounds, lo_all, hi_all, dim)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            c, d = assign(batch)
            out = batch.drop_columns(["_va_cells", "_va_q"])
            yield out.append_column("cluster", pa.array(c.astype(np.int32))).append_column("distance", pa.array(d))

    body = [f for f in va.schema.fields if f.name not in ("_va_cells", "_va_q")]
    schema = StructType(body + [StructField("cluster", IntegerType()), StructField("distance", LongType())])
    rows = va.mapInArrow(final, schema)
    shas = spark.createDataFrame([(j, centroid_sha(c)) for j, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    per = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per = per.join(F.broadcast(shas), "cluster")  # k rows at most
    per = per.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy(F.lit(0))))
    out = rows.join(F.broadcast(per), "cluster")
    own = [F.col(f"_va_c{i}").alias(c) for i, c in enumerate(keep) if c not in names]
    return out.select(*own, *[F.col(n) for n in names])
