"""Benchmark decontamination: short test items inside long documents.

Texts are compared as sets of five-word shingles of their normalised words (lower
case, letters and digits only); a shorter text is one shingle, its whole word
sequence. A document is contaminated by an item if it holds at least 0.8 of the
item's distinct shingles.

Search: items are partitioned by size, in powers of two. An item is searched by
its MinHash sketch, its k smallest shingle hashes. A document with at least r of m
shingles lacks at most m - r, so it meets any m - r + 1 of them; k is the largest
such number of the item's partition, and no containment at the threshold is lost.
Long documents need no sketch of their own, which would drown short items.

Proof: candidates are read again and their shingles compared as text.

Skew: a passage in a third of all documents gives each of them its own candidate
rows, aggregated by (document, item). Sketches are broadcast if their counted rows
allow it, else both sides meet in a shuffled join, which AQE splits.

Nulls and texts without words have no shingles and match nothing; items without
words are never found. Repeated document rows count once per id, and an id
with several texts has the highest count. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import small, stored

SHINGLE = 5
THRESHOLD = 0.8
NOISE = r"[^\p{L}\p{N}]+"


def normal_words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), NOISE), "")


def over_shingles(words: Column, make) -> Column:
    """``make`` of each shingle's word columns; a short text is one shingle, no words none."""
    many = F.transform(
        F.sequence(F.lit(0), F.size(words) - SHINGLE),
        lambda i: make(*(F.get(words, i + k) for k in range(SHINGLE))),
    )
    # concat_ws and the hash both skip nulls, so absent words change nothing
    one = F.array(make(*(F.get(words, F.lit(k)) for k in range(SHINGLE))))
    return (
        F.when(F.size(words) >= SHINGLE, many)
        .when(F.size(words) > 0, one)
        .otherwise(F.array().cast(_kind(make)))
    )


def as_text(*w: Column) -> Column:
    return F.concat_ws(" ", *w)


def as_hash(*w: Column) -> Column:
    return F.xxhash64(*w)


def _kind(make) -> str:
    return "array<string>" if make is as_text else "array<bigint>"


def needed(m: Column) -> Column:
    """The least whole number of shared shingles that reaches the threshold."""
    return F.ceil(m * THRESHOLD - 1e-9)


def items_table(benchmark: DataFrame) -> DataFrame:
    """(item_id, n_shingles, shingles): the distinct shingles of each item; stored, as it is read thrice."""
    words = benchmark.select("item_id", normal_words("text").alias("w")).where(F.size("w") > 0)
    shingles = words.select("item_id", F.array_distinct(over_shingles(F.col("w"), as_text)).alias("shingles"), "w")
    return stored(
        shingles.select("item_id", F.size("shingles").alias("n_shingles"), "shingles", "w"), "items")


def sketches(items: DataFrame) -> DataFrame:
    """(item_id, h): the sketch of each item, as long as its size partition asks for."""
    sized = items.select("*", F.floor(F.log2("n_shingles")).alias("part"))
    depth = sized.groupBy("part").agg(
        F.max(F.col("n_shingles") - needed(F.col("n_shingles")) + 1).cast("int").alias("k"))
    return (
        sized.join(depth, "part")
        .select("item_id", F.explode(F.slice(
            F.array_sort(F.array_distinct(over_shingles(F.col("w"), as_hash))), F.lit(1), F.col("k"))).alias("h"))
    )


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, item_id) pairs that share a hash of the item's sketch."""
    words = docs.select("doc_id", normal_words("text").alias("w"))
    hashes = words.select("doc_id", F.explode(over_shingles(F.col("w"), as_hash)).alias("h"))
    return hashes.join(small(sketch, sketch.count()), "h").select("doc_id", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) of all contaminated documents."""
    items = items_table(benchmark)
    found = stored(candidates(docs, stored(sketches(items), "sketches")), "candidates")
    ids = found.select(F.col("doc_id").alias("of")).distinct()
    suspects = (
        docs.select("doc_id", "text")
        .join(small(ids, ids.count()), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
        .select("doc_id", F.xxhash64("text").alias("version"), normal_words("text").alias("w"))
        .select("doc_id", "version", F.explode(F.array_distinct(over_shingles(F.col("w"), as_text))).alias("s"))
    )
    wanted = items.select("item_id", "n_shingles", F.explode("shingles").alias("s"))
    shared = (
        suspects.join(small(wanted, wanted.count()), "s")
        .distinct()
        .groupBy("doc_id", "version", "item_id", "n_shingles").agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") >= needed(F.col("n_shingles")))
    )
    return shared.groupBy("doc_id", "item_id").agg(
        F.max("n_shared").alias("n_shared"), F.max(F.col("n_shingles").cast("long")).alias("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns."""
    bad = stored(matches(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct(), "contaminated")
    return docs.join(small(bad, bad.count()), F.col("doc_id").eqNullSafe(F.col("__id")), "left_anti")
