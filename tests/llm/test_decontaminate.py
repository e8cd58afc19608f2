import random
import re

import numpy as np

from rebasis.llm import decontaminate as d


def words(text):
    return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, items):
    best = {}
    for doc_id, text, _ in docs:
        s = shingles(text)
        for item, t in items:
            m = shingles(t)
            if m and len(s & m) >= int(np.ceil(len(m) * 0.8 - 1e-9)):
                best[doc_id, item] = max(best.get((doc_id, item), (0, 0)), (len(s & m), len(m)))
    return {(k[0], k[1], *v) for k, v in best.items()}


def run(spark, df, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in d.matches(df, bench).collect()}


def planted():
    rng = random.Random(3)
    vocab = [f"v{n}" for n in range(300)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 9, 20, 33, 60])))) for i in range(60)]
    docs = []
    for i in range(150):
        body = rng.choices(vocab, k=rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = [p.upper() + rng.choice(["", ",", "."]) for p in part]
        docs.append((i, " ".join(body), "a"))
    docs += [(900, items[0][1], "a"), (901, items[1][1] + "!", None)]
    return docs, items


def test_planted_and_edge_rows(spark, frame, edge_rows):
    docs, items = planted()
    docs = docs + [r for r in edge_rows if r[0] not in (10, 13)]
    items = items + [(100, None), (101, ""), (102, "..."), (103, edge_rows[4][1]), (103, edge_rows[4][1]), (None, "one")]
    items = [x for n, x in enumerate(items) if x not in items[:n]]
    want = brute(docs, items)
    assert len(want) > 20 and run(spark, frame(docs), items) == want


def test_short_item_in_a_long_document(spark, frame, edge_rows):
    long = edge_rows[8][1].split()
    item = "nobody ever wrote these exact eleven words in this very order"
    text = " ".join(long[:30_000] + item.split() + long[30_000:])
    assert run(spark, frame([(1, text, "a"), (2, " ".join(long), "a")]), [(7, item)]) == {(1, 7, 7, 7)}


def test_filter_keeps_clean_documents(spark, frame, edge_rows):
    docs, items = planted()
    docs = docs + edge_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = frame(docs)
    bad = {r[0] for r in brute([x for x in docs if x[0] not in (10, 13)], items)}
    out = d.decontaminate(df, bench)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r[0]) for r in docs if r[0] not in bad)


def test_empty(spark, frame):
    assert run(spark, frame([]), [(1, "a b c d e f")]) == set()
    assert run(spark, frame([(1, "a b c d e f", "a")]), []) == set()
