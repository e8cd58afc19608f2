"""Exact top-k retrieval by inner product (the cosine of unit vectors).

Every score is rounded before ranking and ties go to the lower document id, so
results do not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rebasis.operators.arrow import dense
from rebasis.registry import TOP_K

SCORE_DECIMALS = 6
# Query vectors up to this size are broadcast; larger sets are dealt out in blocks.
BROADCAST_BYTES = 8 << 20
MAX_PASSES = 16
# Vector bytes of one query block, held by a task while the documents stream by.
BLOCK_BYTES = 8 << 20
# Score tiles are this many queries by this many documents, so that one stays in the cache.
TILE_QUERIES, TILE_DOCS = 1024, 512
# Documents after which found candidates are ranked.
MERGE_DOCS = 8192
# Values of candidate vectors gathered at a time for their exact scores.
GATHER = 1 << 20

_CANDIDATES = pa.schema([("_q", pa.int32()), ("_d", pa.int64()), ("score", pa.float64())])


class _Best:
    """Running top-k per query: rounded score descending, then id ascending."""

    def __init__(self, n_queries: int, k: int, decimals: int = SCORE_DECIMALS):
        self.k, self.decimals = k, decimals
        # scores further apart than this keep their order when rounded
        self.margin = 10.0**-decimals
        self.score = np.full((n_queries, k), -np.inf)
        self.ident = np.full((n_queries, k), np.iinfo(np.int64).max)

    def offer(self, score: np.ndarray, ident: np.ndarray) -> None:
        """Take a (queries, documents) block of raw scores; NaN is never taken."""
        n, k = len(self.score), self.k
        near = score >= self.score[:, -1:] - self.margin
        if score.shape[1] > k and np.count_nonzero(near) > 4 * n * k:
            kth = -np.partition(-score, k - 1, axis=1)[:, k - 1 : k]
            near &= ~(score < kth - self.margin)
        q, d = np.nonzero(near)
        self.take(q, score[q, d], ident[d])

    def take(self, q: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        """Take raw scores of single (query, document) pairs, each pair once."""
        k = self.k
        # adding zero turns a rounded -0.0 into 0.0
        value = np.round(score, self.decimals) + 0.0
        last = self.score[q, -1]
        better = (value > last) | ((value == last) & (ident < self.ident[q, -1]))
        q, value, ident = q[better], value[better], ident[better]
        if not len(q):
            return
        # only queries with a better candidate are sorted again
        hit, place = np.unique(q, return_inverse=True)
        all_q = np.concatenate([np.repeat(np.arange(len(hit)), k), place])
        all_score = np.concatenate([self.score[hit].ravel(), value])
        all_ident = np.concatenate([self.ident[hit].ravel(), ident])
        order = np.lexsort((all_ident, -all_score, all_q))
        sizes = k + np.bincount(place)
        starts = np.cumsum(sizes) - sizes
        keep = order[starts[:, None] + np.arange(k)]
        self.score[hit], self.ident[hit] = all_score[keep], all_ident[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filled places only; infinite scores are returned like any other."""
        empty = (self.score == -np.inf) & (self.ident == np.iinfo(np.int64).max)
        q, r = np.nonzero(~empty)
        return q.astype(np.int32), self.ident[q, r], self.score[q, r]


def _places(true: np.ndarray) -> np.ndarray:
    """Flat places of the few true cells; whole words of eight cells are skipped."""
    flat = true.reshape(-1)
    if len(flat) % 8:
        return np.flatnonzero(flat)
    word = np.flatnonzero(flat.view(np.uint64))
    row, byte = np.nonzero(flat.reshape(-1, 8)[word])
    return word[row] * 8 + byte


class _Search:
    """A query block and its running top-k; documents are offered a batch at a time.

    Scores are first taken in 32 bits, in tiles. Whatever could still reach the top k, given
    the largest error of a 32-bit product, is scored again in 64 bits, so results are those
    of 64-bit products throughout. Memory is bounded by the block, whatever is offered.
    """

    def __init__(self, queries: np.ndarray, k: int, decimals: int):
        self.queries, self.best = queries, _Best(len(queries), k, decimals)
        self.norms = np.linalg.norm(queries, axis=1)
        with np.errstate(over="ignore"):
            self.narrow = queries.astype(np.float32)
        self.cells = np.empty(TILE_QUERIES * TILE_DOCS, np.float32)
        self.marks = np.empty(TILE_QUERIES * TILE_DOCS, bool)
        self.seen = 0

    def offer(self, ident: np.ndarray, docs: np.ndarray) -> None:
        lo = 0
        while lo < len(ident):
            # short steps at first, while few documents are ruled out
            step = min(MERGE_DOCS, max(64, self.seen))
            some = slice(lo, lo + step)
            longest = float(np.linalg.norm(docs[some], axis=1).max(initial=0.0))
            with np.errstate(over="ignore"):
                narrow = np.ascontiguousarray(docs[some].T, dtype=np.float32)
            reach = longest * float(self.norms.max(initial=0.0))
            for first in range(0, len(self.queries), TILE_QUERIES):
                rows = slice(first, first + TILE_QUERIES)
                if self.seen < self.best.k or not reach < 1e30:
                    self._offer_wide(rows, ident[some], docs[some])
                else:
                    self._offer_tile(rows, ident[some], docs[some], narrow, longest)
            lo += step
            self.seen += step

    def _offer_wide(self, rows: slice, ident: np.ndarray, docs: np.ndarray) -> None:
        """All scores in 64 bits: for the first documents, and where 32 bits could overflow."""
        part = _Best.__new__(_Best)
        part.k, part.decimals, part.margin = self.best.k, self.best.decimals, self.best.margin
        part.score, part.ident = self.best.score[rows], self.best.ident[rows]  # views
        for lo in range(0, len(ident), TILE_DOCS):
            some = slice(lo, lo + TILE_DOCS)
            part.offer(self.queries[rows] @ docs[some].T, ident[some])

    def _offer_tile(self, rows: slice, ident: np.ndarray, docs: np.ndarray, narrow: np.ndarray,
                    longest: float) -> None:
        dim = docs.shape[1]
        error = (dim + 8) * 2.0**-23 * longest * self.norms[rows] + 1e-30
        least = self.best.score[rows, -1] - self.best.margin - error
        least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None]
        queries = self.narrow[rows]
        found_q, found_d = [], []
        for lo in range(0, len(ident), TILE_DOCS):
            tile = narrow[:, lo : lo + TILE_DOCS]
            shape = len(queries), tile.shape[1]
            cells = self.cells[: shape[0] * shape[1]].reshape(shape)
            near = _places(np.greater_equal(
                np.matmul(queries, tile, out=cells), least, out=self.marks[: cells.size].reshape(shape)))
            if len(near):
                q, d = np.divmod(near, shape[1])
                found_q.append(q + rows.start)
                found_d.append(d + lo)
        if not found_q:
            return
        q, d = np.concatenate(found_q), np.concatenate(found_d)
        step = max(1, GATHER // max(1, dim))
        for lo in range(0, len(q), step):
            some_q, some_d = q[lo : lo + step], d[lo : lo + step]
            score = np.einsum("ij,ij->i", self.queries[some_q], docs[some_d])
            self.best.take(some_q, score, ident[some_d])


def _scan(shared, k: int, decimals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        search = _Search(queries, k, decimals)
        for batch in batches:
            ident = batch.column(0).to_numpy(zero_copy_only=False)
            if len(ident):
                search.offer(ident, dense(batch.column(1), queries.shape[1]))
        q, d, score = search.best.rows()
        yield pa.record_batch([pa.array(q), pa.array(d), pa.array(score)], schema=_CANDIDATES)

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP_K, *, doc_id: str = "row_idx",
          query_id: list[str] | str = "query_row", vector: str = "embedding",
          decimals: int = SCORE_DECIMALS, broadcast_bytes: int = BROADCAST_BYTES,
          max_passes: int = MAX_PASSES, block_bytes: int = BLOCK_BYTES,
          max_tasks: int | None = None, query_shape: tuple[int, int] | None = None) -> DataFrame:
    """The ``k`` best documents of every query: query ids, rank (1-based), doc id, score.

    Documents are never shuffled. A query set of at most ``broadcast_bytes`` is broadcast:
    each task scans its documents, multiplies its Arrow batches with it and keeps k rows per
    query; only these candidates are shuffled. A larger one is dealt out in blocks of at most
    about ``block_bytes``, and each task streams the stored documents past its block
    (:func:`_stored_scan`), so that a task's memory does not grow with either table.
    ``query_shape``, the number and length of query vectors, saves counting them if known.
    Ids must be unique on both sides. ``max_passes`` is kept for callers and no longer used.
    """
    keys = [query_id] if isinstance(query_id, str) else list(query_id)
    n, dim = query_shape or queries.agg(F.count("*"), F.max(F.size(vector))).first()
    right = queries.select(*keys, F.col(vector).alias("_v"))
    left = docs.select(F.col(doc_id).cast("bigint").alias("_d"), F.col(vector).alias("_v"))

    if n == 0:
        ranked = right.select(
            *keys, F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("_d"),
            F.lit(0.0).alias("score"),
        ).where(F.lit(False))
    elif n * dim * 8 <= broadcast_bytes:
        tasks = max_tasks or 4 * docs.sparkSession.sparkContext.defaultParallelism
        # merged splits: a task reports its best rows once for many files
        ranked = _one_pass(left.coalesce(tasks), right, keys, k, decimals, dim, broadcast_bytes)
    else:
        per_block = max(1, block_bytes // (dim * 8))
        cores = docs.sparkSession.sparkContext.defaultParallelism
        blocks = max(math.ceil(n / per_block), min(cores, math.ceil(n / (2 * TILE_QUERIES))))
        # whole rounds of tasks, for the last one would leave cores idle
        blocks = blocks if blocks < cores else math.ceil(blocks / cores) * cores
        ranked = _stored_scan(left, right, keys, k, decimals, dim, blocks)
    return ranked.select(*keys, "rank", F.col("_d").alias(doc_id), "score")


def _one_pass(left: DataFrame, right: DataFrame, keys: list[str], k: int, decimals: int, dim: int,
              broadcast_bytes: int) -> DataFrame:
    """Rank one query block, small enough for the driver, against a scan of the documents."""
    spark = left.sparkSession
    held = right.toArrow()
    block = dense(held["_v"].combine_chunks(), dim)
    if block.nbytes > 2 * broadcast_bytes:  # hashing spreads unique ids evenly
        raise ValueError("a query block is too large; query ids are not unique")
    found = left.mapInArrow(
        _scan(spark.sparkContext.broadcast(block), k, decimals), "_q int, _d bigint, score double"
    )
    numbered = held.select(keys).append_column("_q", pa.array(np.arange(len(block), dtype=np.int32)))
    named = spark.createDataFrame(
        numbered, T.StructType([*(right.schema[c] for c in keys), T.StructField("_q", T.IntegerType())])
    )
    # as many rows as the broadcast query block
    return _rank(found, ["_q"], k).join(F.broadcast(named), "_q").drop("_q")


# Stored documents read at a time by one task.
READ_DOCS = 8192


def _block_search(paths: list[str], keys: list[str], k: int, decimals: int, dim: int):
    """Task body of the blocked path: the stored documents, streamed past the task's queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark import TaskContext
        from pyarrow import fs

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        search = _Search(np.vstack([dense(b.column(len(keys)), dim) for b in held]), k, decimals)
        # tasks start at different files
        first = TaskContext.get().partitionId() % max(1, len(paths))
        for path in paths[first:] + paths[:first]:
            files, name = fs.FileSystem.from_uri(path)
            with files.open_input_file(name) as source:
                for batch in pq.ParquetFile(source).iter_batches(READ_DOCS, columns=["_d", "_v"], use_threads=False):
                    if batch.num_rows:
                        ident = batch.column(0).to_numpy(zero_copy_only=False)
                        search.offer(ident, dense(batch.column(1), dim))
        row, doc, score = search.best.rows()
        step = max(1, READ_DOCS * k)
        for lo in range(0, len(row), step):
            part = slice(lo, lo + step)
            out = table.select(keys).take(pa.array(row[part])).combine_chunks()
            yield pa.RecordBatch.from_pydict(
                {**{c: out[c].combine_chunks() for c in keys}, "_d": pa.array(doc[part], pa.int64()),
                 "score": pa.array(score[part], pa.float64())})

    return run


def _stored_scan(left: DataFrame, right: DataFrame, keys: list[str], k: int, decimals: int, dim: int,
                 blocks: int) -> DataFrame:
    """Query sets too large to broadcast: one task per query block, which reads all documents.

    The documents are written once to the shared folder. Queries are dealt to ``blocks`` tasks
    by a hash of their ids; each task holds its block and the running best, and streams the
    stored files past them a few thousand documents at a time. A query's best rows come from
    one task, so that k rows per query are shuffled, whatever the number of documents.
    """
    from rebasis.session import stored

    paths = sorted(stored(left, "search-documents").inputFiles())
    schema = T.StructType([
        *(right.schema[c] for c in keys),
        T.StructField("_d", T.LongType()), T.StructField("score", T.DoubleType()),
    ])
    asked = right.repartition(blocks, *keys)
    return _rank(asked.mapInArrow(_block_search(paths, keys, k, decimals, dim), schema), keys, k)


def _rank(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "_d")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
