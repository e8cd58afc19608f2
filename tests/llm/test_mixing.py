import re
from collections import Counter, defaultdict

import pytest

from rebasis.llm import mixing as m

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(WORD.findall(text or ""))


def targets(sizes, weights=(3, 1, 2), share=1.5, limit=2.0):
    """Share by weight, cap, and share the rest again until nothing is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if each * weight[s] > limit * sizes[s]}
        for s in over or open_:
            out[s] = limit * sizes[s] if over else each * weight[s]
        left -= sum(out[s] for s in over)
        open_ -= over or open_
    return out


def corpus():
    rows = [(i, " ".join(f"s{i}w{k}" for k in range(i * 37 % 211)), "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    return rows + rows[:4] + [(1000, "tiny source", None), (1001, None, "none"), (1002, " ", "none"), (None, "a b c", "hot")]


@pytest.mark.parametrize("spec", [m.Mix(), m.Mix(block=8, shard=16), m.Mix(block=1, shard=4, weights=(1, 100))])
def test_words_taken(frame, spec):
    rows = corpus()
    out = m.taken_words(m.mix(m.doc_sizes(frame(rows)), spec)).collect()
    sizes, want = defaultdict(int), Counter((i, size(t)) for i, t, _ in rows)
    source = {}
    for i, t, s in rows:
        sizes[s] += size(t)
        source[i, size(t)] = s
    aims = targets(sizes, spec.weights)
    assert Counter((r.doc_id, r.size) for r in out) == want
    taken = defaultdict(int)
    for r in out:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(aims[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(taken[s] == int(aims[s] + 0.5) for s in sizes)


def test_shards_follow_the_weights(frame):
    mixed = m.mix(m.doc_sizes(frame(corpus())), m.Mix(block=8, shard=256))
    shards = defaultdict(Counter)
    for r in mixed.slots.collect():
        shards[r.shard][r.source_no] += 1
    plan = {r.source_no: r.target for r in mixed.targets.collect()}
    total = sum(plan.values())
    full = [c for c in shards.values() if sum(c.values()) == 256]
    assert len(full) > 5
    for c in full:
        for no, t in plan.items():
            p = t / total
            assert abs(c[no] - 256 * p) <= 6 * (256 * p * (1 - p)) ** 0.5 + 2


def test_blocks_of_an_epoch_are_taken_once(frame):
    mixed = m.mix(m.doc_sizes(frame(corpus())), m.Mix(block=8, shard=64))
    seen = Counter((r.source_no, r.epoch, r.block) for r in mixed.slots.collect())
    assert max(seen.values()) == 1 and {e for _, e, _ in seen} == {0, 1}


def test_permutation(spark):
    from pyspark.sql import functions as F
    for n in (1, 2, 7, 100):
        rows = spark.range(n).select(m.permuted(m.Mix(), F.lit(3), F.lit(0), F.col("id"), F.lit(n).cast("long")).alias("x"))
        assert sorted(r.x for r in rows.collect()) == list(range(n))


def test_reruns_and_partitions_agree(frame):
    a, b = (sorted(map(tuple, m.taken_words(m.mix(m.doc_sizes(df))).collect()), key=str)
            for df in (frame(corpus()), frame(corpus()).repartition(7)))
    assert a == b


def test_documents_of_the_mix(frame):
    rows = corpus()
    df = frame(rows)
    spec = m.Mix(block=8, shard=64)
    out = m.mixed_documents(df, spec)
    assert out.columns == df.columns
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(t)
    words = Counter()
    for r in out.collect():
        run = WORD.findall(r.text)
        words[r.source] += len(run)
        assert r.n_chars == len(r.text)
        assert any(f" {' '.join(run)} " in f" {' '.join(WORD.findall(t or ''))} " for t in texts[r.doc_id])
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
    aims = targets(sizes)
    assert all(words[s] == int(aims[s] + 0.5) for s in sizes)


def test_edge_rows(frame, edge_rows):
    out = m.taken_words(m.mix(m.doc_sizes(frame(edge_rows)))).collect()
    assert len(out) == len(edge_rows) and all(r.taken <= 2 * r.size for r in out)
    m.mixed_documents(frame(edge_rows)).collect()


def test_empty(frame):
    for rows in ([], [(1, None, "a")]):
        assert [r.taken for r in m.taken_words(m.mix(m.doc_sizes(frame(rows)))).collect()] == [0] * len(rows)
        assert m.mixed_documents(frame(rows)).count() == 0
