"""Quality rules: counts inside a document, and lines that too many documents of a host share.

A line is normalised (lower case, one space between words) and hashed. It is
*frequent* in a host if more than ``max(min_documents, share of the host)``
distinct documents of that host have it. Frequent lines are removed; a document
that loses more than ``max_removed`` of its words is depleted and rejected.

Copies are one document here, else a popular text would condemn its own lines:
documents are told apart by their *anchor*, the five words from the first of
their longest words on. Exact copies share it, and so do copies whose edits lie elsewhere.

Hosts and lines are counted by hash aggregation, so a host with a third of all
rows is spread over all tasks. A host has at most (lines of a document) / share
frequent lines, whatever its size, so they fit one array per host.

Nulls and empty texts have no words and fail the base rules. A null host is a
host of its own. Repeated rows are judged one by one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rebasis.llm.common import let, line_words, small, stored, text_words

SYMBOLS = "[^#*$%&|<>]+"  # all that is no symbol
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 0.2


def repeat_words(words: Column) -> Column:
    """How many words stand in windows of five words that occur twice or more.

    Windows are hashed and the hashes compared; only a text with an equal pair
    is sorted by (hash, place) to find the windows and the union of their words.
    """
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - WINDOW),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(found: Column) -> Column:
        places = let(
            F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.array_sort(F.filter(
                F.transform(s, lambda x, k: F.when(
                    (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])),
                lambda i: i.isNotNull(),
            )),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end"))
        return F.aggregate(
            places, start,
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).alias("n"), (p + WINDOW).alias("end")),
            lambda a: a["n"],
        )

    return let(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)),
    )


def anchor(words: Column) -> Column:
    """Hash of the five words from the first of the longest words on; null without words."""
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("at"))))
    return F.when(
        F.size(words) > 0,
        F.xxhash64(F.array_join(F.slice(words, F.coalesce(-longest["at"], F.lit(0)) + 1, F.lit(WINDOW)), " ")),
    )


def normal_line(words: Column) -> Column:
    return F.lower(F.array_join(words, " "))


def signals(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per document: id, host, anchor, base counts, and (hash, words) of each of its lines."""
    # generators, so that no later filter takes the splitting into its own lambdas
    split = docs.select(
        "doc_id", F.col(host).alias("host"), F.col("text"), F.explode(F.array(line_words("text"))).alias("cells"))
    flat = split.select("*", F.explode(F.array(F.flatten("cells"))).alias("words"))
    spoken = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return flat.select(
        "doc_id", "host", anchor(F.col("words")).alias("anchor"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(F.coalesce("text", F.lit("")), SYMBOLS, "")).cast("long").alias("n_symbols"),
        let(spoken, lambda s: (F.size(s) - F.size(F.array_distinct(s)))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.transform(
            F.filter("cells", lambda c: F.size(c) > 0),
            lambda c: F.struct(F.xxhash64(normal_line(c)).alias("h"), F.size(c).alias("n")),
        ).alias("lines"),
    )


def frequent_lines(found: DataFrame, min_documents: int = 20, share: float = 0.01) -> DataFrame:
    """(host, bad): the hashes of the lines that too many distinct documents of a host have."""
    documents = (
        found.where(F.col("anchor").isNotNull()).select("host", "anchor").distinct()
        .groupBy("host").agg(F.count("*").alias("documents"))
    )
    lines = (
        found.select("host", "anchor", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .distinct().groupBy("host", "h").agg(F.count("*").alias("n"))
        .where(F.col("n") > min_documents)
    )
    bar = documents.select(F.col("host").alias("of"), "documents")
    above = lines.join(F.broadcast(bar) if bar.count() < 100_000 else bar, F.col("host").eqNullSafe(F.col("of")))
    return (
        above.where(F.col("n") > F.col("documents") * share)
        .groupBy("host").agg(F.sort_array(F.collect_list("h")).alias("bad"))
    )


def with_bad(rows: DataFrame, bad: DataFrame, host: str) -> DataFrame:
    """``rows`` with the frequent lines of their host, an empty array if it has none."""
    side = bad.select(F.col("host").alias("__host"), F.col("bad").alias("__bad"))
    size = bad.agg(F.coalesce(F.sum(F.size("bad") + 1), F.lit(0))).first()[0]
    return (
        rows.join(small(side, size), F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")
        .withColumn("__bad", F.coalesce("__bad", F.array().cast("array<bigint>")))
    )


def judge(found: DataFrame, bad: DataFrame, max_removed: float = 0.8) -> DataFrame:
    """Base counts, the words in frequent lines, and the verdict, one row per row of ``found``."""
    removed = F.aggregate(
        F.filter("lines", lambda x: F.array_contains("__bad", x["h"])), F.lit(0).cast("long"),
        lambda s, x: s + x["n"],
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEATED * F.col("n_words"))
    return with_bad(found, bad, "host").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        removed.alias("n_removed_words"), failed.alias("base_failed"),
    ).withColumn(
        "kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words")),
    )


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """Verdict of every document. The text is read once; counts and line hashes are stored."""
    found = stored(signals(docs, host), "quality")
    return judge(found, stored(frequent_lines(found), "frequent"))


def apply_rules(docs: DataFrame, host: str = "source", max_removed: float = 0.8) -> DataFrame:
    """The documents that pass, without their frequent lines. Keeps the columns of ``docs``.

    The verdict is taken again beside the text, from the same signals and the
    same table of frequent lines, so that no text is shuffled to meet it.
    """
    found = stored(signals(docs, host), "quality")
    bad = stored(frequent_lines(found), "frequent")


    def judged(cells: Column, gone: Column, words: Column) -> Column:
        lost = F.aggregate(
            F.zip_with(cells, gone, lambda c, g: F.when(g, F.size(c)).otherwise(0)), F.lit(0), lambda s, x: s + x)
        rest = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line, i: ~F.get(gone, i)), "\n")
        n = F.size(words)
        return let(lost, lambda out: F.struct(
            ((n >= MIN_WORDS) & (out <= max_removed * n)
             & (100 * repeat_words(words) <= 100 * MAX_REPEATED * n)).alias("ok"),
            F.when(out > 0, rest).otherwise(F.col("text")).alias("rest"),
        ))

    verdict = let(line_words("text"), lambda cells: let(
        F.transform(cells, lambda c: (F.size(c) > 0) & F.array_contains("__bad", F.xxhash64(normal_line(c)))),
        lambda gone: let(F.flatten(cells), lambda words: judged(cells, gone, words))))
    # a generator keeps the filter from being pushed into, and computed beside, the verdict
    out = with_bad(docs, bad, host).select(*docs.columns, F.explode(F.array(verdict)).alias("__q"))
    out = out.where("__q.ok").withColumn("text", F.col("__q.rest"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)
