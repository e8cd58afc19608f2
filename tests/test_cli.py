import pytest
from pyspark.sql import functions as F

from rebasis import registry as R
from rebasis.__main__ import main
from rebasis.operators.encode import HashedTermEncoder
from rebasis.session import fresh_path
from rebasis.sources import tables as src

# Stand-ins under registered names, so that prefixes and dimensions are found.
E5 = HashedTermEncoder(768, name="intfloat/e5-base-v2")
NOMIC = HashedTermEncoder(768, "s", name="nomic-ai/nomic-embed-text-v1.5")
QWEN = HashedTermEncoder(1024, "t", name="Qwen/Qwen3-Embedding-0.6B")


def module(name):
    return f"tests.test_cli:{name}"


def test_jobs_end_to_end(spark, capsys):
    raw, root, out = (fresh_path(spark, n) for n in ("raw", "frozen", "encoded"))
    docs = spark.range(120).select(
        F.col("id").cast("string").alias("_id"), F.lit(None).cast("string").alias("title"),
        F.concat_ws(" ", F.lit("topic"), F.col("id"), F.col("id") % 7).alias("text"),
    )
    docs.write.json(f"{raw}/corpus.jsonl")
    docs.where("cast(_id as int) % 4 = 0").drop("title").write.json(f"{raw}/queries.jsonl")
    pairs = spark.range(0, 120, 4).select(
        F.col("id").alias("query-id"), F.col("id").alias("corpus-id"), F.lit(1).alias("score")
    )
    pairs.write.csv(f"{raw}/qrels/test.tsv", sep="\t", header=True)
    expected = fresh_path(spark, "expected")
    text = src.expected_json({E5.name: 1.0, NOMIC.name: 0.1})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(expected)

    freeze = ["freeze", "--corpus", f"{raw}/corpus.jsonl", "--queries", f"{raw}/queries.jsonl",
              "--qrels", f"{raw}/qrels/test.tsv", "--out", root, "--n-queries", "20", "--n-docs", "100"]
    assert main(freeze, spark) == 0
    with pytest.raises(FileExistsError):
        main(freeze, spark)
    for name in ("E5", "NOMIC", "QWEN"):
        for split in R.SPLITS:
            job = ["encode", "--corpus", root, "--out", out, "--split", split, "--encoder", module(name)]
            assert main(job, spark) == 0
    assert {r.prefix for r in src.encode_runs(spark, out).collect()} == {
        "query: ", "passage: ", "search_query: ", "search_document: ", R.INSTRUCT_PROMPT, "",
    }
    # without --batch-size each model is encoded with its registered batch size
    assert {(r.model, r.batch_size) for r in src.encode_runs(spark, out).collect()} == {
        (E5.name, 256), (NOMIC.name, 256), (QWEN.name, 128),
    }
    where = ["--corpus", root, "--vectors", out]
    assert main(["ceilings", *where], spark) == 0
    assert "recall@10 = " in capsys.readouterr().out

    results = fresh_path(spark, "pairs")
    one = ["pairs", *where, "--source", E5.name, "--target", QWEN.name, "--out", results, "--train-size", "50"]
    assert main(one, spark) == 0
    row = spark.read.json(results).first()
    assert (row.method, row.src_dim, row.tgt_dim, row.test_docs) == ("least_squares", 768, 1024, 50)
    assert main(["pairs", *where, "--all-pairs", "--out", results, "--train-size", "50"], spark) == 0
    assert spark.read.json(results).count() == 6
    with pytest.raises(SystemExit, match="--all-pairs"):
        main(["pairs", *where, "--out", results], spark)

    check = ["check", "all", *where, "--benchmark", raw, "--expected", expected, "--encoder", module("E5"), module("NOMIC")]
    capsys.readouterr()
    assert main(check, spark) == 1  # one expectation is far off
    shown = capsys.readouterr().out
    assert all(name in shown for name in ("determinism", "prefix", "metric", "SKIP", "FAIL"))
    assert main(["check", "dim", "determinism", *where, "--encoder", module("E5")], spark) == 0
    capsys.readouterr()
    assert main(["check", "prefix", *where, "--encoder", module("QWEN")], spark) == 0  # not audited: skipped
    assert "SKIP" in capsys.readouterr().out


def test_registry_batch_sizes_and_testable_models(spark):
    registered = R.models(spark)
    assert R.batch_size_for(registered, QWEN.name) == 128
    assert R.batch_size_for(registered, QWEN.name, large=True) == 256
    assert R.batch_size_for(registered, "nobody/unknown") is None
    assert R.prefix_testable(registered, E5.name)
    assert not R.prefix_testable(registered, QWEN.name)
    assert not R.prefix_testable(registered, "nobody/unknown")
