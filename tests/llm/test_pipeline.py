"""The pipeline against the stages' brute-force versions, one after the other."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq

import corpus_pipeline
from rebasis.llm.common import stored, table
from tests.conftest import SMALL
from tests.llm import test_decontaminate, test_mixing, test_quality_rules, test_simhash


def test_stages(spark):
    columns = table(spark, SMALL, "documents").columns
    docs, seen = table(spark, SMALL, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SMALL), "test")
        seen[name] = before, docs.collect()
        assert name == "token_output" or docs.columns == columns

    before, after = seen["quality"]
    rows = [(r.doc_id, r.text, r.source) for r in before]
    kept = {r[0] for r in test_quality_rules.brute(rows, 20, 0.01) if r[8]}
    assert {r.doc_id for r in after} == kept and len(after) == len(kept)

    before, after = seen["near_duplicates"]
    want = test_simhash.brute([(r.doc_id, test_simhash.fingerprint(r.text)) for r in before], 4)
    assert {str(r.doc_id) for r in after} == {i for i, _, c in want if i == c}

    before, after = seen["contamination"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()]
    bad = {k[0] for k in test_decontaminate.brute([(r.doc_id, r.text, 0) for r in before], items)}
    assert bad and {r.doc_id for r in after} == {r.doc_id for r in before} - bad

    before, after = seen["source_mix"]
    sizes, took = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += test_mixing.size(r.text)
    for r in after:
        took[r.source] += test_mixing.size(r.text)
    assert dict(took) == {s: int(x + 0.5) for s, x in test_mixing.targets(sizes).items()}

    before, after = seen["token_output"]
    import public_tokenizers
    from tokenizers import Tokenizer
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    start, want = 0, []
    for r in sorted(before, key=lambda r: (r.doc_id, r.text.encode())):
        ids = encode(r.text, add_special_tokens=False).ids + [1]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, after), key=lambda r: r[1]) == want


def test_run_equals_the_stages(spark):
    a = corpus_pipeline.run(spark, SMALL)
    assert a.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    b = corpus_pipeline.run(spark, SMALL)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
