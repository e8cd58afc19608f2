"""Jobs from the command line, as for spark-submit.

    python -m rebasis freeze --corpus C --queries Q --qrels R --out ROOT
    python -m rebasis encode --corpus ROOT --out VECTORS --split corpus --model NAME --encoder pkg.mod:OBJ
    python -m rebasis ceilings --corpus ROOT --vectors VECTORS
    python -m rebasis pairs --corpus ROOT --vectors VECTORS [--source A --target B | --all-pairs] --out FOLDER
    python -m rebasis check all --vectors VECTORS [--corpus ROOT] [--encoder pkg.mod:OBJ ...]
"""

from __future__ import annotations

import argparse
import importlib
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis import registry as R
from rebasis.operators.encode import Encoder
from rebasis.plans import audits as A
from rebasis.plans.ceilings import ceilings
from rebasis.plans.corpus import FreezeSpec, freeze, load
from rebasis.plans.encoding import encode_split
from rebasis.plans.pairs import evaluate_grid, evaluate_pairs
from rebasis.plans.reports import ceiling_lines, encode_summary, pair_summary
from rebasis.session import exists
from rebasis.sinks.tables import write_pair_results
from rebasis.sources import tables as src
from rebasis.sources.vectors import vectors


def _print(df: DataFrame, **how) -> None:
    """All rows of a report, which has a row per model, pair or check."""
    rows = df.collect()
    df.sparkSession.createDataFrame(rows, df.schema).show(max(1, len(rows)), truncate=False, **how)


def _encoder(path: str) -> Encoder:
    """An encoder object, or a function without arguments that makes one."""
    module, name = path.split(":")
    found = getattr(importlib.import_module(module), name)
    return found if hasattr(found, "load") and not isinstance(found, type) else found()


def _freeze(spark: SparkSession, a: argparse.Namespace) -> int:
    spec = FreezeSpec(a.n_queries, a.n_docs, a.seed, a.source_name, flat_hash=a.flat_hash)
    freeze(
        spark, src.raw_corpus(spark, a.corpus), src.raw_queries(spark, a.queries),
        src.raw_qrels(spark, a.qrels), a.out, spec,
    )
    _print(src.manifest(spark, a.out), vertical=True)
    return 0


def _encode(spark: SparkSession, a: argparse.Namespace) -> int:
    side = "doc" if a.split == "corpus" else "query"
    encoder = _encoder(a.encoder)
    model = a.model or encoder.name
    registered = R.models(spark)
    prefix = a.prefix if a.prefix is not None else R.prefix_of(registered, encoder, side, model)
    batch_size = a.batch_size or R.batch_size_for(registered, model, a.large) or R.BATCH_SIZE
    encode_split(
        spark, a.corpus, a.out, a.split, encoder, side, prefix, model, batch_size,
        a.max_tokens, force=a.force, registered_dim=R.dim_for(R.models(spark), model),
    )
    _print(encode_summary(src.encode_runs(spark, a.out).drop("sidecar")))
    return 0


def _models(found: DataFrame) -> list[str]:
    return [r.model for r in found.select("model").distinct().orderBy("model").collect()]


def _ceilings(spark: SparkSession, a: argparse.Namespace) -> int:
    held = src.manifest(spark, a.corpus)
    if exists(spark, f"{a.vectors}/runs"):
        A.require_hashes(src.encode_runs(spark, a.vectors), held)
    found = vectors(spark, f"{a.vectors}/vectors")
    qrels = src.frozen(spark, a.corpus, "qrels")
    _print(ceiling_lines(ceilings(found, qrels, a.models or _models(found))))
    return 0


def _pairs(spark: SparkSession, a: argparse.Namespace) -> int:
    found = vectors(spark, f"{a.vectors}/vectors")
    qrels = src.frozen(spark, a.corpus, "qrels")
    options = {"train_size": a.train_size, "seed": a.seed, "train_queries": a.train_queries}
    if a.all_pairs:
        results = evaluate_grid(found, qrels, **options)
    elif a.source and a.target:
        results = evaluate_pairs(found, qrels, [(a.source, a.target)], **options)
    else:
        raise SystemExit("give --source and --target, or --all-pairs")
    write_pair_results(results, a.out)
    _print(pair_summary(spark.read.schema(results.schema).json(a.out)))
    return 0


def _check(spark: SparkSession, a: argparse.Namespace) -> int:
    registered = R.models(spark)
    encoders = [_encoder(e) for e in a.encoder]

    def each(one) -> DataFrame:
        if not encoders:
            raise ValueError("this check needs --encoder")
        return reduce(DataFrame.unionByName, (one(e) for e in encoders))

    def dim() -> DataFrame:
        found = vectors(spark, f"{a.vectors}/vectors", must_exist=False)
        where = F.concat_ws("/", "model", "split")
        return A.as_checks("dim", A.dim_audit(found, registered), where, F.to_json(F.struct("min_dim", "max_dim", "n_rows")))

    def determinism() -> DataFrame:
        texts = load(spark, a.corpus).queries
        return each(lambda e: A.as_checks(
            "determinism", A.determinism_audit(texts, e, R.prefix_of(registered, e, "doc")),
            F.col("model"), F.to_json(F.struct("min_cosine", "mean_cosine")),
        ))

    def prefix() -> DataFrame:
        tables = load(spark, a.corpus)

        def one(e) -> DataFrame:
            if not R.prefix_testable(registered, e.name):
                skipped = spark.createDataFrame([(e.name, "SKIP")], "model string, status string")
                return A.as_checks("prefix", skipped, F.col("model"), F.lit("the prefix audit does not apply to this model"))
            return A.as_checks(
                "prefix", A.prefix_audit(
                    tables.qrels, tables.queries, tables.corpus, e,
                    R.prefix_of(registered, e, "query"), R.prefix_of(registered, e, "doc"),
                ),
                F.col("model"), F.to_json(F.struct("with_prefix", "without_prefix", "gap")),
            )

        return each(one)

    def metric() -> DataFrame:
        tables = src.benchmark_layout(spark, a.benchmark)
        measured = each(lambda e: A.benchmark_ndcg(
            *tables, e, R.prefix_of(registered, e, "query"), R.prefix_of(registered, e, "doc")
        ))
        result = A.metric_audit(measured, src.expected_metrics(spark, a.expected))
        return A.as_checks(
            "metric", result, F.col("model"), F.to_json(F.struct("ndcg", "expected", "diff"))
        )

    checks = {"dim": dim, "determinism": determinism, "prefix": prefix, "metric": metric}
    results = A.run_checks(spark, checks, a.names)
    _print(results)
    _print(A.summary(results))
    return A.exit_code(results)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rebasis")
    jobs = top.add_subparsers(dest="job", required=True)

    p = jobs.add_parser("freeze")
    for name in ("corpus", "queries", "qrels", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--n-queries", type=int, default=R.N_QUERIES)
    p.add_argument("--n-docs", type=int, default=R.N_DOCS)
    p.add_argument("--seed", type=int, default=R.SEED)
    p.add_argument("--source-name", default="")
    p.add_argument("--flat-hash", action="store_true", help="record the hash of all ids in one run, too")
    p.set_defaults(run=_freeze)

    p = jobs.add_parser("encode")
    for name in ("corpus", "out", "encoder"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--split", choices=R.SPLITS, required=True)
    p.add_argument("--model")
    p.add_argument("--prefix")
    p.add_argument("--batch-size", type=int, help="default: the model's registered batch size")
    p.add_argument("--large", action="store_true", help="use the batch size registered for the large scale")
    p.add_argument("--max-tokens", type=int)
    p.add_argument("--force", action="store_true")
    p.set_defaults(run=_encode)

    p = jobs.add_parser("ceilings")
    p.add_argument("--corpus", required=True)
    p.add_argument("--vectors", required=True)
    p.add_argument("--models", nargs="*")
    p.set_defaults(run=_ceilings)

    p = jobs.add_parser("pairs")
    for name in ("corpus", "vectors", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--source")
    p.add_argument("--target")
    p.add_argument("--all-pairs", action="store_true")
    p.add_argument("--train-size", type=int, default=R.TRAIN_DOCS)
    p.add_argument("--train-queries", default="all")
    p.add_argument("--seed", type=int, default=R.SEED)
    p.set_defaults(run=_pairs)

    p = jobs.add_parser("check")
    p.add_argument("names", nargs="+", choices=["dim", "determinism", "prefix", "metric", "all"])
    p.add_argument("--vectors")
    p.add_argument("--corpus")
    p.add_argument("--benchmark", help="folder of corpus.jsonl, queries.jsonl, qrels/test.tsv")
    p.add_argument("--expected", help="JSON file of expected metrics")
    p.add_argument("--encoder", nargs="*", default=[])
    p.set_defaults(run=_check)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(spark or SparkSession.builder.appName("rebasis").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
