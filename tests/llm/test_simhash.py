import random

import xxhash
from hypothesis import given, settings, strategies as st

from rebasis.llm import simhash as s


def fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(prints, radius):
    """Least id by component of {id: fingerprint} lists."""
    up = list(range(len(prints)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                up[top(a)] = top(b)
    least = {}
    for n, (i, _) in enumerate(prints):
        if i is not None:
            least[top(n)] = min(i, least.get(top(n), i))
    return sorted((str(i), f"{p:016x}", str(least.get(top(n)))) for n, (i, p) in enumerate(prints))


def near_texts():
    rng = random.Random(9)
    vocab = [f"v{n}" for n in range(500)]
    rows = []
    for g in range(12):
        base = rng.choices(vocab, k=rng.choice([3, 30, 200]))
        for _ in range(rng.choice([1, 2, 12])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) * 7 % 101, " ".join(words), "a"))
    return rows


def collect(df):
    return sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in df.collect())


def test_documents(frame, edge_rows):
    rows = near_texts() + edge_rows
    want = brute([(i, fingerprint(t)) for i, t, _ in rows], s.RADIUS)
    assert collect(s.near_duplicates(frame(rows))) == want
    # trees of two members: every route is cut finer and dealt into many trees
    assert collect(s.near_duplicates(frame(rows), shard=2)) == want


def test_one_of_each(frame, edge_rows):
    rows = near_texts() + edge_rows
    df = frame(rows)
    out = s.one_of_each(df)
    heads = {i for i, _, c in collect(s.near_duplicates(df)) if i == c}
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(heads)


def test_one_of_each_takes_one_row_of_each_component(frame):
    say = lambda tag: " ".join(f"{tag}{k}word" for k in range(40))
    first, second, third, other = say("a"), say("b"), say("c"), say("d")
    rows = [
        (1, first, "x"), (7, first, "x"), (7, second, "x"), (7, second, "x"), (8, second, "x"),  # id 7 is of two components
        (None, third, "x"), (None, third, "x"), (None, other, "x"), (None, first, "x"), (9, say("e"), "x"),
    ]
    got = sorted((str(r.doc_id), r.text) for r in s.one_of_each(frame(rows)).collect())
    assert got == sorted([("1", first), ("7", second), ("None", third), ("None", other), ("9", say("e"))])


def chain(spark, prints, radius=4, shard=s.SHARD):
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    return {r.fp % (1 << 64): r.root % (1 << 64) for r in s.components(s.links(fps, radius, shard)).collect()}


def test_chains_and_dense_groups(spark):
    rng = random.Random(5)
    prints = set()
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):  # a chain of small steps, far apart at its ends
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            prints.add(x)
    center = rng.getrandbits(64)
    prints |= {center ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)}
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    want = {}
    for (_, fp, c), p in zip(brute(list(enumerate(prints)), 4), prints):
        pass
    groups = {}
    for i, fp, c in brute(list(enumerate(prints)), 4):
        groups.setdefault(c, set()).add(int(fp, 16))
    for shard in (s.SHARD, 64):
        root = chain(spark, prints, shard=shard)
        got = {}
        for p in prints:
            got.setdefault(root.get(p, p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=60), st.integers(0, 12))
def test_tree_finds_what_a_scan_finds(prints, radius):
    tree = s.Tree()
    for p in prints:
        tree.add(p)
    for p in prints[:5] + [0]:
        assert sorted(tree.near(p, radius)) == sorted(x for x in prints if (x ^ p).bit_count() <= radius)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint(text):
    got = s.text_fingerprint(text.encode("utf-8", "replace")) % (1 << 64)
    assert got == fingerprint(text.encode("utf-8", "replace").decode())


def test_empty(frame):
    assert s.near_duplicates(frame([])).count() == 0
