"""How much retrieval quality survives when queries move between embedding spaces."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rebasis import schemas
from rebasis.functions.vectors import dim_of, ratio
from rebasis.operators.diff import alignment_gaps
from rebasis.operators.judgments import in_split
from rebasis.operators.linmap import LinearMap, fit_many, tasks_for, translate
from rebasis.operators.metrics import micro_recall
from rebasis.operators.ordering import Cut, find_cut
from rebasis.operators.retrieve import top_k
from rebasis.registry import SEED, TOP_K, TRAIN_DOCS, model_pairs

TRAIN_QUERIES = ("all", "none", "holdout")
NATIVE = ""


def _of(vectors: DataFrame, model: str, split: str) -> DataFrame:
    return vectors.where((F.col("model") == model) & (F.col("split") == split)).select(
        "row_idx", "embedding"
    )


def aligned(vectors: DataFrame, models: list[str], keep: dict[str, object]) -> DataFrame:
    """Rows that take part in fitting, one vector column per model (``v0``, ``v1``, ...).

    ``keep`` gives a row predicate by split. It is applied to every side before
    the join, so only training rows are shuffled.
    """
    parts = []
    for split, condition in keep.items():
        sides = [
            _of(vectors, m, split).where(condition).withColumnRenamed("embedding", f"v{n}")
            for n, m in enumerate(models)
        ]
        parts.append(reduce(lambda a, b: a.join(b, "row_idx"), sides))
    return reduce(DataFrame.unionByName, parts)


def _shapes(vectors: DataFrame, models: list[str]) -> tuple[dict[str, int], int, int]:
    """Dimension by model, numbers of documents and queries; raises where rows are not the same.

    Row numbers are compared by count and by an order-free sum and exclusive-or of their
    hashes, one scan of that column; dimensions come from one row each. Uneven
    lengths surface in the scans that read the vectors anyway.
    """
    mark = F.xxhash64("row_idx")
    read = vectors.where(F.col("model").isin(models)).groupBy("model", "split").agg(
        F.count("*").alias("n"), F.sum(mark.cast("decimal(38,0)")).alias("total"), F.bit_xor(mark).alias("mix"),
    ).collect()
    counts = {(r.model, r.split): r.n for r in read}
    marks = {(r.model, r.split): (r.total, r.mix) for r in read}
    for split in ("corpus", "queries"):
        found = {m: counts.get((m, split), 0) for m in models}
        if 0 in found.values():
            raise FileNotFoundError(f"no {split} vectors for some of {found}")
        if len(set(found.values())) > 1:
            raise ValueError(f"{split} counts differ: {found}")
        if len({marks[m, split] for m in models}) > 1:
            first = _of(vectors, models[0], split)
            gaps = {m: alignment_gaps(first, _of(vectors, m, split)).count() for m in models[1:]}
            raise ValueError(f"{split} rows differ from those of {models[0]}: {gaps} rows are on one side only")
    dims = {m: dim_of(_of(vectors, m, "corpus")) for m in models}
    return dims, counts[models[0], "corpus"], counts[models[0], "queries"]


def fit_pairs(vectors: DataFrame, pairs: list[tuple[str, str]], dims: dict[str, int], cut: Cut,
              train_queries: str, qrels: DataFrame, n_rows: int) -> dict[tuple[str, str], LinearMap]:
    """All maps from one aligned training table.

    ``train_queries``: ``all`` stacks every query onto the training documents,
    ``none`` leaves queries out, ``holdout`` takes those without a test judgment.
    ``n_rows`` is the number of training rows, at most.
    """
    if train_queries not in TRAIN_QUERIES:
        raise ValueError(f"train_queries must be one of {TRAIN_QUERIES}")
    models = list(dict.fromkeys(m for pair in pairs for m in pair))
    keep: dict[str, object] = {"corpus": cut.keeps("row_idx")}
    if train_queries == "all":
        keep["queries"] = F.lit(True)
    rows = aligned(vectors, models, keep)
    if train_queries == "holdout":
        scored = in_split(qrels, cut).select(F.col("query_row").alias("row_idx")).distinct()
        asked = aligned(vectors, models, {"queries": F.lit(True)})
        rows = rows.unionByName(asked.join(scored, "row_idx", "left_anti"))
    name = {m: f"v{n}" for n, m in enumerate(models)}
    tasks = tasks_for(
        n_rows, list(dims.values()), vectors.sparkSession.sparkContext.defaultParallelism
    )
    fitted = fit_many(
        rows, {name[m]: dims[m] for m in models}, [(name[a], name[b]) for a, b in pairs], tasks
    )
    return {(a, b): fitted[name[a], name[b]] for a, b in pairs}


def evaluate_pairs(vectors: DataFrame, qrels: DataFrame, pairs: list[tuple[str, str]],
                   train_size: int = TRAIN_DOCS, seed: int = SEED, k: int = TOP_K,
                   train_queries: str = "all") -> DataFrame:
    """One row per (source, target): micro recall of translated and native queries.

    ``vectors`` holds (model, split, row_idx, embedding). Test documents of a
    target are scanned once, for its native queries and for those of all its
    sources together. No test judgments: no rows.
    """
    spark = vectors.sparkSession
    models = list(dict.fromkeys(m for pair in pairs for m in pair))
    dims, n_docs, n_queries = _shapes(vectors, models)
    if train_size > n_docs:
        raise ValueError(f"{train_size} training documents asked for, {n_docs} exist")
    cut = find_cut(_of(vectors, models[0], "corpus").select("row_idx"), "row_idx",
                   train_size, seed, "split")
    test_qrels = in_split(qrels, cut).select("query_row", "corpus_row").distinct()
    judged = test_qrels.agg(
        F.count("*").alias("n"), F.count_distinct("query_row").alias("q")
    ).first()
    if judged.n == 0:
        return spark.createDataFrame([], schemas.PAIR_RESULTS)

    started = time.monotonic()
    maps = fit_pairs(
        vectors, pairs, dims, cut, train_queries, qrels, train_size + n_queries
    )
    # sums are taken once for all pairs, each map is solved by itself
    solving = sum(m.solve_seconds for m in maps.values())
    aggregate = round(time.monotonic() - started - solving, 3)

    recalls = []
    for target in dict.fromkeys(b for _, b in pairs):
        sources = [a for a, b in pairs if b == target]
        asked = [_of(vectors, target, "queries").withColumn("source", F.lit(NATIVE))]
        for source in sources:
            moved = translate(_of(vectors, source, "queries"), maps[source, target].matrix)
            asked.append(moved.withColumn("source", F.lit(source)))
        wide = F.col("embedding").cast("array<double>").alias("embedding")
        queries = reduce(DataFrame.unionByName, (
            q.select("source", F.col("row_idx").alias("query_row"), wide) for q in asked
        ))
        docs = _of(vectors, target, "corpus").where(~cut.keeps("row_idx")).select(
            F.col("row_idx").alias("corpus_row"), "embedding"
        )
        ranked = top_k(docs, queries, k, doc_id="corpus_row", query_id=["source", "query_row"],
                       query_shape=(n_queries * (1 + len(sources)), dims[target]))
        names = F.array(*(F.lit(s) for s in (NATIVE, *sources)))
        pairs_judged = test_qrels.withColumn("source", F.explode(names))
        recalls.append(
            micro_recall(pairs_judged, ranked, k=k, by=["source"]).withColumn("target", F.lit(target))
        )

    # the native row of a target is spread to its sources, so results are read once
    native = F.max(F.when(F.col("source") == NATIVE, F.col("recall"))).over(Window.partitionBy("target"))
    measured = reduce(DataFrame.unionByName, recalls).select(
        "source", "target", "recall", native.alias("native")
    )
    facts = spark.createDataFrame(
        [
            (a, b, m.method, dims[a], dims[b], train_size, n_docs - train_size, judged.n,
             judged.q, round(m.solve_seconds + aggregate / len(pairs), 3), seed, train_queries, m.rank,
             round(m.solve_seconds, 3), aggregate)
            for (a, b), m in maps.items()
        ],
        "source string, target string, method string, src_dim int, tgt_dim int, "
        "train_docs bigint, test_docs bigint, test_qrels bigint, test_queries bigint, "
        "train_seconds double, seed int, train_queries string, map_rank int, "
        "solve_seconds double, aggregate_seconds double",
    )
    return (
        facts.join(measured, ["source", "target"])
        .withColumn("recall_at_10_translated", F.round("recall", 5))
        .withColumn("recall_at_10_native_target", F.round("native", 5))
        .withColumn("ratio", F.round(ratio("recall", "native"), 5))
        .select(*schemas.PAIR_RESULTS.fieldNames())
    )


def evaluate_grid(vectors: DataFrame, qrels: DataFrame, **options) -> DataFrame:
    """All ordered pairs of the models that ``vectors`` holds."""
    pairs = model_pairs(vectors).orderBy("source", "target").collect()
    return evaluate_pairs(vectors, qrels, [(r.source, r.target) for r in pairs], **options)


def all_pairs(models: list[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in models for b in models if a != b]
