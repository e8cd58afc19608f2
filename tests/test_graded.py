import hashlib

import numpy as np

from rebasis.functions import text as X
from rebasis.operators.encode import HashedTermEncoder
from rebasis.workload import audit_queries


def test_graded_pairs_search_the_texts_once(spark, tmp_path):
    """NDCG reads its judgments twice; the search for passages is not repeated by that."""
    passage = "one two three four five six"
    docs = [(1, f"x {passage} y"), (2, passage), (3, "one two three four"), (4, None), (5, f"{passage} {passage}"),
            (6, "a two three four b")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, passage), (8, "not in any of them")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    graded = audit_queries._text_graded(spark, str(tmp_path))
    assert sorted(map(tuple, graded.collect())) == [(7, 1, 1), (7, 2, 2), (7, 5, 1)]
    assert "Generate" not in graded._jdf.queryExecution().toString()


def test_strip_and_title_of_odd_ends(spark):
    texts = ["", " ", "a", "a b", " a  b\n", "　a\x0b", " ", "é ", None, "a \n", "\x85\U0001f600"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(X.strip("t"), X.title_and_text("t")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] == [t if t is None else t.strip() for t in texts]


def test_term_buckets_equal_the_definition():
    texts = np.array(["", None, "a\x0bb a", "  A b\tc\r\n", "Été éTÉ x" * 40, "\x0b"], object)
    for batch in (texts, texts[[0, 1, 3, 4]]):
        got = HashedTermEncoder(16, "s").load()(batch)
        want = np.zeros((len(batch), 16), np.float32)
        for n, text in enumerate(batch):
            for token in (text or "").lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" "):
                if token:
                    want[n, int(hashlib.md5(("s" + token).encode()).hexdigest()[:8], 16) % 16] += 1
        assert (got == want).all()
