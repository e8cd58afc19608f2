"""Seeded sampling, splitting and dense row numbers without a global sort.

All orders here are those of a uniform hash key, so that a prefix of the order
is a sample. A sample of ``n`` rows is described by its largest key (a *cut*):
finding the cut needs key counts only, and taking the sample is then a plain
row filter that moves no rows and can be repeated on any table with the id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebasis.functions.hashing import order_key
from rebasis.registry import SEED
from rebasis.session import pin

# Above this many rows the cut is found by counting key prefixes first.
DIRECT_ROWS = 10_000
# Hex digits per counting round: at most 16 ** 4 counters reach the driver.
PREFIX_DIGITS = 4
KEY_DIGITS = 32


@dataclass(frozen=True)
class Cut:
    """The first ``n`` ids in key order: those whose key is at most ``key``."""

    seed: int
    stream: str
    n: int
    key: str | None  # None: every id

    def keeps(self, ident: Column | str) -> Column:
        if self.n == 0:
            return F.lit(False)
        if self.key is None:
            return F.lit(True)
        return order_key(ident, self.seed, self.stream) <= self.key


def find_cut(df: DataFrame, ident: str, n: int, seed: int = SEED, stream: str = "",
             direct_rows: int = DIRECT_ROWS) -> Cut:
    """The cut holding exactly ``n`` of the ids of ``df``, which must be unique.

    Raises if there are fewer than ``n``.
    """
    if n < 0:
        raise ValueError(f"cannot take {n} rows")
    if n == 0:
        return Cut(seed, stream, 0, "")
    keys = df.select(order_key(ident, seed, stream).alias("k"))
    rank, prefix = n, ""
    while rank > direct_rows and len(prefix) < KEY_DIGITS:
        width = len(prefix) + PREFIX_DIGITS
        counts = (
            keys.where(F.col("k").startswith(prefix))
            .groupBy(F.substring("k", 1, width).alias("p"))
            .count()
            .orderBy("p")
            .collect()
        )
        for row in counts:
            if rank <= row["count"]:
                prefix = row["p"]
                break
            rank -= row["count"]
        else:
            raise ValueError(f"asked for {n} rows, only {n - rank} exist")
    found = (
        keys.where(F.col("k").startswith(prefix))
        .orderBy("k")
        .limit(rank)
        .agg(F.count("*").alias("n"), F.max("k").alias("k"))
        .first()
    )
    if found.n < rank:
        raise ValueError(f"asked for {n} rows, only {n - rank + found.n} exist")
    return Cut(seed, stream, n, found.k)


def sample(df: DataFrame, ident: str, n: int, seed: int = SEED, stream: str = "") -> DataFrame:
    """Exactly ``n`` rows; a smaller sample is part of a larger one."""
    return df.where(find_cut(df, ident, n, seed, stream).keeps(ident))


def split_train_test(df: DataFrame, ident: str, train_size: int, seed: int = SEED,
                     stream: str = "split") -> tuple[DataFrame, DataFrame, Cut]:
    """Seeded split: ``train_size`` rows and the rest."""
    cut = find_cut(df, ident, train_size, seed, stream)
    return df.where(cut.keeps(ident)), df.where(~cut.keeps(ident)), cut


def shuffled_index(df: DataFrame, ident: str, seed: int = SEED, stream: str = "shuffle",
                   index: str = "row_idx") -> DataFrame:
    """Dense 0-based index in seeded random order.

    Key prefixes are uniform, so they serve as even, fixed sort buckets: each
    bucket is sorted by itself and shifted by the number of rows before it.
    """
    keyed = df.withColumn("_k", order_key(ident, seed, stream))
    keyed = keyed.withColumn("_b", F.substring("_k", 1, PREFIX_DIGITS))
    in_order = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.select(F.substring(order_key(ident, seed, stream), 1, PREFIX_DIGITS).alias("_b"))
        .groupBy("_b")
        .agg(F.count("*").alias("_n"))
        # at most 16 ** PREFIX_DIGITS rows, whatever the size of df
        .select("_b", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("_b").orderBy("_k", ident)
    return (
        keyed.join(F.broadcast(starts), "_b")
        .withColumn(index, F.col("_start") + F.row_number().over(within) - 1)
        .select(index, *df.columns)
    )


def sorted_index(df: DataFrame, by: list[str], index: str = "row_idx") -> DataFrame:
    """Dense 0-based index in the order of columns that identify a row.

    Rows are range-partitioned and pinned (range bounds are sampled, so a
    recomputation could move rows), and partitions get offsets.
    """
    ranged = pin(df.repartitionByRange(*by).sortWithinPartitions(*by))
    # the row id is (partition << 33) + position in the partition
    placed = ranged.withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_p", F.shiftright("_id", 33))
    in_order = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_p")
        .agg(F.count("*").alias("_n"))
        # one row per partition
        .select("_p", F.coalesce(F.sum("_n").over(in_order), F.lit(0)).alias("_start"))
    )
    position = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), "_p")
        .withColumn(index, F.col("_start") + position)
        .select(index, *df.columns)
    )


def first_rows(df: DataFrame, n: int, index: str = "row_idx") -> DataFrame:
    return df.orderBy(index).limit(n)
