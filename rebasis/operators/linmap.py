"""Linear maps between two embedding spaces, fitted from aggregated products.

Row-sized work is the product of two vector columns summed over rows: each
task sums its own Arrow batches, and rows of the small product matrix are
added up by row number. Only that d x d' matrix reaches the driver.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebasis.functions.vectors import NORM_FLOOR, dim_of
from rebasis.operators.arrow import dense, list_column

# A product matrix of this size may be collected (about 5,800 x 5,800 doubles).
MATRIX_BYTES = 256 << 20
# Product matrices one task accumulates in one pass.
PASS_BYTES = 512 << 20
# Rows per vector dimension that make a task's sums no larger than its input.
ROWS_PER_DIM = 1
# Singular values below this share of the largest count as zero.
RELATIVE_CUTOFF = 1e-7
# In a solve on the triangular factor the singular values are those of the rows themselves,
# not squared: below this share of the largest (times the dimension) they count as zero.
QR_CUTOFF = 4 * np.finfo(float).eps
# Triangular factors merged by one task of the reduction tree.
QR_FANOUT = 8
# Vector bytes stacked on a task's factor at a time, unless the factor itself is larger.
QR_BYTES = 160 << 20

_PARTIAL = pa.schema([("block", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def _emit(sums: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for block, matrix in sums.items():
        step = max(1, (8 << 20) // (8 * matrix.shape[1]))
        for lo in range(0, len(matrix), step):
            part = matrix[lo : lo + step]
            yield pa.record_batch(
                [
                    pa.array(np.full(len(part), block, np.int32)),
                    pa.array(np.arange(lo, lo + len(part), dtype=np.int32)),
                    list_column(part, pa.float64()),
                ],
                schema=_PARTIAL,
            )


def _multiply(blocks: list[tuple[int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = {c: dense(batch.column(c)) for b in blocks for c in b[1:]}
            for number, left, right in blocks:
                product = vectors[left].T @ vectors[right]
                sums[number] = sums[number] + product if number in sums else product
        yield from _emit(sums)

    return run


def _add_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        rows = batch.column(2)
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        ends = rows.offsets.to_numpy() - rows.offsets[0].as_py()
        for n, key in enumerate(keys):
            row = flat[ends[n] : ends[n + 1]]
            sums[key] = sums[key] + row if key in sums else row.copy()
    for (block, i), row in sums.items():
        yield pa.record_batch(
            [pa.array([block], pa.int32()), pa.array([i], pa.int32()), list_column(row[None], pa.float64())],
            schema=_PARTIAL,
        )


def products(df: DataFrame, pairs: list[tuple[str, str]], max_tasks: int | None = None) -> DataFrame:
    """Sums over rows of ``left x right`` for several pairs of vector columns.

    Rows (block, i, row): row ``i`` of the product matrix of ``pairs[block]``.
    All pairs come from one scan of ``df``.
    """
    spark = df.sparkSession
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    blocks = [(n, columns.index(a), columns.index(b)) for n, (a, b) in enumerate(pairs)]
    limit = max_tasks or spark.sparkContext.defaultParallelism
    partial = (
        df.select(*columns)
        .coalesce(limit)
        .mapInArrow(_multiply(blocks), "block int, i int, row array<double>")
    )
    return partial.repartition("block", "i").mapInArrow(_add_rows, partial.schema)


def product(df: DataFrame, left: str, right: str, max_tasks: int | None = None) -> DataFrame:
    """Rows (i, row) of the sum over rows of ``left x right``; a Gram matrix if equal."""
    return products(df, [(left, right)], max_tasks).select("i", "row")


def tasks_for(n_rows: int, dims: list[int], most: int) -> int:
    """Tasks to sum ``n_rows`` rows with: few enough that sums are not the larger part."""
    return max(1, min(most, n_rows // (ROWS_PER_DIM * max(dims))))


_FACTOR = pa.schema([("part", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))])


def _factor_rows(part: int, r: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = max(1, (8 << 20) // (8 * max(1, r.shape[1])))
    for lo in range(0, len(r), step):
        block = r[lo : lo + step]
        yield pa.record_batch([pa.array(np.full(len(block), part, np.int32)),
                               pa.array(np.arange(lo, lo + len(block), dtype=np.int32)),
                               list_column(block, pa.float64())], schema=_FACTOR)


def _stack_r(held: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangular factor of ``held`` stacked on ``rows``: same Gram matrix, square or fewer rows."""
    both = rows if held is None else np.vstack([held, rows])
    return np.linalg.qr(both, mode="r") if len(both) else both


def _local_r(columns: list[str], dims: list[int]):
    width = sum(dims)
    step = max(1, width, QR_BYTES // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = None
        for batch in batches:
            if batch.num_rows:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    held = _stack_r(held, np.hstack([dense(part.column(c), d) for c, d in zip(columns, dims)]))
        if held is not None:
            yield from _factor_rows(TaskContext.get().partitionId(), held)

    return run


def _merge_r(width: int, fanout: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            if batch.num_rows:
                parts = batch.column("part").to_numpy()
                index = batch.column("i").to_numpy()
                rows = dense(batch.column("row"), width)
                for part in np.unique(parts):
                    factors.setdefault(int(part) // fanout, []).append((index[parts == part].astype(np.int64) + int(part) * width,
                                                                       rows[parts == part]))
        for group, pieces in factors.items():
            order = np.concatenate([p[0] for p in pieces])
            stacked = np.vstack([p[1] for p in pieces])[np.argsort(order, kind="stable")]
            yield from _factor_rows(group, _stack_r(None, stacked))

    return run


def tall_r(df: DataFrame, columns: list[str], dims: list[int], fanout: int = QR_FANOUT,
           max_tasks: int | None = None) -> np.ndarray:
    """R of the QR factorisation of the rows [c1 | c2 | ...], by a tree of tasks.

    Each task factors its own rows (stacking batch after batch on its factor, so it holds one
    factor and one batch). Factors then merge up to ``fanout`` at a time, by their task number, in
    rounds of small shuffles, until one is left; only that one (width x width) reaches the
    driver. The singular values of R are those of the rows: nothing is squared.
    """
    width = sum(dims)
    if width * width * 8 > MATRIX_BYTES:
        raise ValueError(f"a {width} x {width} factor is too large for the driver")
    # wide factors merge fewer at a time, for a task holds all it merges
    fanout = max(2, min(fanout, QR_BYTES // max(1, 8 * width * width)))
    # a bound on the factors is enough for the tree; asking a join for its splits would run it
    count = max_tasks or df.sparkSession.sparkContext.defaultParallelism
    factors = df.select(*columns).coalesce(count).mapInArrow(
        _local_r(columns, dims), "part int, i int, row array<double>")
    while count > 1:
        groups = -(-count // fanout)
        factors = factors.repartition(groups, (F.col("part") / fanout).cast("int")).mapInArrow(
            _merge_r(width, fanout), factors.schema)
        count = groups
    held = factors.toArrow()
    r = np.zeros((0, width))
    if held.num_rows:
        rows = dense(held["row"].combine_chunks(), width)
        r = _stack_r(None, rows[np.argsort(held["i"].to_numpy(), kind="stable")])
    return r


def swapped_r(r: np.ndarray, src_dim: int) -> np.ndarray:
    """R of [B | A] from R of [A | B]: the same rows with their columns exchanged, factored again."""
    return _stack_r(None, np.hstack([r[:, src_dim:], r[:, :src_dim]]))


def solve_triangular_least_squares(r: np.ndarray, src_dim: int, cutoff: float = QR_CUTOFF) -> LinearMap:
    """The minimum-norm M of least ``|A M - B|`` from R of [A | B], by a rank-revealing SVD of R11."""
    square = np.zeros((r.shape[1], r.shape[1]))
    square[: len(r)] = r
    r11, r12 = square[:src_dim, :src_dim], square[:src_dim, src_dim:]
    u, s, vt = np.linalg.svd(r11)
    kept = s > s[0] * cutoff * max(1, src_dim) if len(s) and s[0] > 0 else np.zeros(len(s), bool)
    matrix = vt[kept].T @ ((u[:, kept].T @ r12) / s[kept, None])
    condition = float(s[0] / s[kept].min()) if kept.any() else float("inf")
    return LinearMap(matrix, "least_squares", int(kept.sum()), condition)


def fit_least_squares_qr(df: DataFrame, source: str, target: str, fanout: int = QR_FANOUT) -> LinearMap:
    """The least-squares map from ``source`` to ``target`` through a tall QR of the rows."""
    dims = [dim_of(df, source), dim_of(df, target)]
    started = time.monotonic()
    r = tall_r(df, [source, target], dims, fanout)
    made = solve_triangular_least_squares(r, dims[0])
    return replace(made, solve_seconds=time.monotonic() - started)


def cells(matrix: DataFrame) -> DataFrame:
    """The relational form (i, j, value) of matrix rows (i, row)."""
    return matrix.select("i", F.posexplode("row").alias("j", "value"))


def to_matrix(rows: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """Matrix rows (i, row) as an array; refuses more than ``MATRIX_BYTES``."""
    if shape[0] * shape[1] * 8 > MATRIX_BYTES:
        raise ValueError(f"a {shape[0]} x {shape[1]} matrix is too large for the driver")
    held = rows.select("i", "row").toArrow()
    matrix = np.zeros(shape)
    if held.num_rows:
        matrix[held["i"].to_numpy()] = dense(held["row"].combine_chunks(), shape[1])
    return matrix


def to_rows(spark, matrix: np.ndarray) -> DataFrame:
    """An array as matrix rows (i, row)."""
    table = pa.table(
        [pa.array(np.arange(len(matrix), dtype=np.int32)), list_column(matrix, pa.float64())],
        ["i", "row"],
    )
    return spark.createDataFrame(table)


@dataclass
class LinearMap:
    """``matrix`` sends a source row vector to the target space."""

    matrix: np.ndarray
    method: str
    rank: int
    condition: float
    solve_seconds: float = 0.0


def solve_orthogonal(cross: np.ndarray) -> LinearMap:
    """The orthogonal M closest in ``|A M - B|``, from ``A'B``. Reflections are allowed."""
    u, s, vt = np.linalg.svd(cross)
    rank = int((s > s[0] * RELATIVE_CUTOFF).sum()) if s[0] > 0 else 0
    condition = float(s[0] / s[-1]) if s[-1] > 0 else float("inf")
    return LinearMap(u @ vt, "orthogonal_procrustes", rank, condition)


def spectrum(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, ascending, and eigenvectors of a Gram matrix."""
    return np.linalg.eigh((gram + gram.T) / 2)


def solve_least_squares(gram: tuple[np.ndarray, np.ndarray], cross: np.ndarray,
                        cutoff: float = RELATIVE_CUTOFF) -> LinearMap:
    """The minimum-norm M of least ``|A M - B|``, from the spectrum of ``A'A`` and ``A'B``."""
    values, vectors = gram
    top = values[-1]
    least = top * max(cutoff**2, np.finfo(float).eps * len(values))
    kept = values > least if top > 0 else np.zeros(len(values), bool)
    basis = vectors[:, kept]
    matrix = basis @ ((basis.T @ cross) / values[kept, None])
    condition = float(np.sqrt(top / values[kept].min())) if kept.any() else float("inf")
    return LinearMap(matrix, "least_squares", int(kept.sum()), condition)


def method_for(src_dim: int, tgt_dim: int) -> str:
    return "orthogonal_procrustes" if src_dim == tgt_dim else "least_squares"


def fit_many(df: DataFrame, dims: dict[str, int], pairs: list[tuple[str, str]],
             max_tasks: int | None = None) -> dict[tuple[str, str], LinearMap]:
    """Maps between the named vector columns of aligned rows.

    Orthogonal pairs need only the cross product ``A'B``, which one scan per pass gives for
    all of them (one product serves both directions of a pair); passes are sized so that a
    task can hold its sums. Least-squares pairs are solved from the triangular factor of
    the rows ``[A | B]`` (:func:`tall_r`), so their condition number is never squared; the
    opposite direction takes its factor from that one.
    """
    needed: list[tuple[str, str]] = []
    for a, b in pairs:
        if dims[a] == dims[b] and (a, b) not in needed and (b, a) not in needed:
            needed.append((a, b))
    passes: list[list[tuple[str, str]]] = [[]]
    held = 0
    for a, b in needed:
        size = dims[a] * dims[b] * 8
        if passes[-1] and held + size > PASS_BYTES:
            passes.append([])
            held = 0
        passes[-1].append((a, b))
        held += size

    sums: dict[tuple[str, str], np.ndarray] = {}
    for group in passes:
        if not group:
            continue
        blocks = products(df, group, max_tasks)
        total = sum(dims[a] * dims[b] * 8 for a, b in group)
        if total > max(PASS_BYTES, MATRIX_BYTES):
            raise ValueError("product matrices are too large for the driver")
        table = blocks.toArrow()
        numbers = table["block"].to_numpy()
        for n, (a, b) in enumerate(group):
            matrix = np.zeros((dims[a], dims[b]))
            mine = table.filter(pa.array(numbers == n))
            if mine.num_rows:
                matrix[mine["i"].to_numpy()] = dense(mine["row"].combine_chunks(), dims[b])
            sums[a, b], sums[b, a] = matrix, matrix.T

    maps = {}
    factors: dict[tuple[str, str], np.ndarray] = {}
    for a, b in pairs:
        started = time.monotonic()
        if method_for(dims[a], dims[b]) == "orthogonal_procrustes":
            made = solve_orthogonal(sums[a, b])
        else:
            if (b, a) in factors:
                factor = swapped_r(factors.pop((b, a)), dims[b])
            else:
                factor = tall_r(df, [a, b], [dims[a], dims[b]], max_tasks=max_tasks)
                if (b, a) in pairs:
                    factors[a, b] = factor
            made = solve_triangular_least_squares(factor, dims[a])
        maps[a, b] = replace(made, solve_seconds=time.monotonic() - started)
    return maps


def fit(df: DataFrame, source: str, target: str, max_tasks: int | None = None) -> LinearMap:
    """The map from vector column ``source`` to ``target``; the method follows the dims."""
    dims = {c: dim_of(df, c) for c in (source, target)}
    return fit_many(df, dims, [(source, target)], max_tasks)[source, target]


def translate(df: DataFrame, matrix: np.ndarray, vector: str = "embedding",
              renormalize: bool = True) -> DataFrame:
    """Send ``vector`` through the map, scaled to unit length unless told otherwise."""
    if matrix.nbytes > MATRIX_BYTES:
        raise ValueError("the map is too large to broadcast")
    shared = df.sparkSession.sparkContext.broadcast(matrix)
    place = df.columns.index(vector)
    schema = T.StructType([
        T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == vector else f
        for f in df.schema
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved = dense(batch.column(place), len(shared.value)) @ shared.value
            if renormalize:
                length = np.linalg.norm(moved, axis=1, keepdims=True)
                moved = moved / np.maximum(length, NORM_FLOOR)
            columns = list(batch.columns)
            columns[place] = list_column(moved, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, schema)


def translate_relational(df: DataFrame, matrix: DataFrame, ident: str,
                         vector: str = "embedding") -> DataFrame:
    """The same product as a join on the row number: (ident, j, value)."""
    left = df.select(ident, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    right = cells(matrix).withColumnRenamed("value", "m")
    return left.join(right, "i").groupBy(ident, "j").agg(F.sum(F.col("x") * F.col("m")).alias("value"))


def planted_rotation(vector: Column | str) -> Column:
    """A fixed orthogonal map, as a test fixture: reverse, and negate odd positions."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(F.reverse(v), lambda x, i: F.when(i % 2 == 1, -x).otherwise(x))


def planted_extension(vector: Column | str, extra: int = 32) -> Column:
    """A fixed map to a larger space, as a test fixture: append doubled coordinates."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return F.concat(v, F.transform(F.slice(v, 1, extra), lambda x: x * F.lit(2.0).cast("float")))
