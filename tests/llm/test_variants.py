import random
import re
import zlib
from collections import Counter

from rebasis.llm import variants as v


def lower_az(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = lower_az(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                p = h % len(low)
                low = low[:p] + low[p + 1:]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    out = {}
    for w, n in words.items():
        near = [(o, words[o]) for o in words if one_edit(w, o)]
        best = min(near, key=lambda x: (-x[1], x[0])) if near else None
        form = best[0] if best and best[1] >= 10 * n else None
        out[w] = [form, n, len(near), best[1] if form else None]
    for w, r in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        r.insert(1, root)
    return sorted((w, f, root, n, k, fn) for w, (f, root, n, k, fn) in out.items())


def run(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "x", 1, 2) for i, t in rows],
                                 "doc_id long, text string, lang string, word string, n int, root int").repartition(3)
    return sorted(tuple(r) for r in v.variants(docs).collect())


def corpus(seed=7, n_docs=60):
    rnd = random.Random(seed)
    stems = ["reading", "beautiful", "knowledge", "organisation", "naïveté", "Straßenbahn", "colour", "extraordinary",
             "Mississippi", "résumé", "ambiguous", "abcdefg", "zzzzzzzz"]
    docs = []
    for d in range(n_docs):
        words = []
        for _ in range(rnd.randrange(0, 80)):
            w = rnd.choice(stems)
            r = rnd.random()
            if r < 0.1 and len(w) > 1:  # a deletion
                i = rnd.randrange(len(w)); w = w[:i] + w[i + 1:]
            elif r < 0.2:  # a replacement or insertion
                i = rnd.randrange(len(w)); w = w[:i] + rnd.choice("aeiouxé") + w[i + (r < 0.15):]
            words.append(w.upper() if rnd.random() < 0.05 else w)
        docs.append((d, " ".join(words) + rnd.choice(["", " 123 x-y", "\n\t"])))
    return docs


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert any(r[1] is not None for r in want) and any(r[4] > 1 for r in want)
    assert run(spark, rows) == want


def test_edges(spark):
    rows = corpus(seed=3, n_docs=20) + [
        (None, "reading reading readingx"), (None, None), (100, ""), (101, None), (5, "reading " * 3000),
        (5, "reading " * 3000), (102, "ÀÉÎÕÜÿ ÀÉÎÕÜÿ àéîõüÿa àéîõüÿa"), (103, "abc1defghij abc1defghij"),
    ]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, "short words only")]) == []


def test_pairs_of_short_and_long_words(spark):
    """Every near pair of a dense word set, through both the gram lists and the deletion path."""
    rnd = random.Random(11)
    base = ["abcdefg", "abcdefgh", "abcdefghijklmnop", "qrstuvwxyz", "aaaaaaaaaa", "ababababab"]
    words = set(base)
    while len(words) < 400:
        w = list(rnd.choice(sorted(words)))
        i = rnd.randrange(len(w))
        op = rnd.randrange(3)
        if op == 0 and len(w) > 7:
            del w[i]
        elif op == 1:
            w[i] = rnd.choice("abcxyz")
        else:
            w.insert(i, rnd.choice("abcxyz"))
        words.add("".join(w))
    table = spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")
    got = sorted(tuple(r) for r in v.near_pairs(table).collect())
    want = sorted((a, b) for a in words for b in words if one_edit(a, b))
    assert got == want


def test_bound_counts_only_grams_that_an_edit_can_change(spark):
    """The bound holds for every one-edit pair, by gram and start, and keeps long words apart by several grams."""
    rnd = random.Random(5)
    words = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(7, 14))) for _ in range(150)}
    for w in sorted(words):
        i, c = rnd.randrange(len(w)), rnd.choice("abcd")
        words |= {w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:], w[:i] + "e" + w[i:]}
    dic = v.dictionary(spark.createDataFrame([(w,) for w in words], "word string"), share=0.05)
    grams = {r.g for r in dic.collect()}
    longer = {g[:-1] for g in grams}
    parts = {w: v.split_word(w, grams, longer) for w in words}
    pairs = [(a, b) for a in words for b in words if a < b and one_edit(a, b)]
    assert len(pairs) > 200
    for a, b in pairs:
        shift = len(b) - len(a)
        (ta, sa, ba), (tb, sb, bb) = parts[a], parts[b]
        there = set(zip((t.split("#")[0] for t in tb), sb))
        same = sum((t.split("#")[0], p) in there or (t.split("#")[0], p + shift) in there for t, p in zip(ta, sa))
        assert same >= max(ba, bb)
    # all 2- to 4-grams known: each place but the last two starts a gram of four, an edit changes four
    word = "abcdefghijkl"
    every = {word[p : p + q] for q in (2, 3, 4) for p in range(len(word) - q + 1)}
    tokens, starts, b = v.split_word(word, every, {g[:-1] for g in every})
    assert starts == list(range(9)) and b == 9 - 4  # windows of Q_MAX - 1 to both sides gave 9 - 7


def test_letter_mask_of_one_edit():
    rnd = random.Random(9)
    for _ in range(500):
        w = "".join(rnd.choice("abcdefgéÿz") for _ in range(rnd.randrange(7, 12)))
        i, c = rnd.randrange(len(w)), rnd.choice("abcdefgéÿzü")
        for o in (w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]):
            assert ((v.letter_mask(w) ^ v.letter_mask(o)) & (1 << 64) - 1).bit_count() <= 2


def test_candidates_are_checked_where_they_meet(spark):
    """The exact one-edit check stands in the joins, before candidates are shuffled to their grams."""
    words = spark.createDataFrame([(w, 3) for w in ("internal", "internall", "xinternal", "external", "intrenal")],
                                  "word string, n long")
    near = v.near_pairs(words)
    plan = near._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Join Inner" in line and "levenshtein" in line for line in plan) >= 2
    got = {tuple(r) for r in near.collect()}
    assert got == {("internal", "internall"), ("internall", "internal"), ("internal", "xinternal"), ("xinternal", "internal")}


def test_only_ascii_capitals_are_lowered(spark):
    """In texts of ASCII alone and in others, also where a character's lower case is no single one."""
    rows = [(1, "WORDSOFASCII WordsOfAscii"), (2, "ÄRGERLICH äRGERLICH ÄRGERLICH İSTANBULCITY"), (3, None), (4, "STANBULCITY")]
    runs = [(k, lower_az(r)) for k, text in rows for r in re.findall(v.RUN, text or "")]
    want = Counter(r if (h := zlib.crc32(f"{k}:{r}".encode())) % 31 else r[: h % len(r)] + r[h % len(r) + 1 :] for k, r in runs)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.word: r.n for r in v.spelled_words(docs).collect()}
    assert got and got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}
