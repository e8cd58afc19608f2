import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rebasis.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    often = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def brute(rows, min_documents, share, max_removed=0.8):
    def anchor(w):
        at = max(range(len(w)), key=lambda i: (len(w[i]), -i))
        return tuple(w[at:at + 5])

    norm = lambda line: " ".join(WORD.findall(line)).lower()
    hosts, seen = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        w = WORD.findall(text or "")
        if w:
            hosts[host].add(anchor(w))
            for line in (text or "").split("\n"):
                if WORD.search(line):
                    seen[host, norm(line)].add(anchor(w))
    bad = {k for k, a in seen.items() if len(a) > min_documents and len(a) > share * len(hosts[k[0]])}
    out = []
    for i, text, host in rows:
        b = base(text)
        gone = [x for x in (text or "").split("\n") if WORD.search(x) and (host, norm(x)) in bad]
        lost = sum(len(WORD.findall(x)) for x in gone)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        out.append((i, *b, lost, failed, not failed and lost <= max_removed * b[0]))
    return out


def judged(df, min_documents, share):
    found = q.signals(df)
    return [tuple(r) for r in q.judge(found, q.frequent_lines(found, min_documents, share)).collect()]


def shared_rows():
    rng = random.Random(4)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for i in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        if i % 2:
            lines.insert(rng.randint(0, len(lines)), "Subscribe  to OUR newsletter")
        if i % 9 == 0:
            lines = ["Subscribe to our newsletter", "click here for more of our very best offers and deals today only", f"onlyinthisdocument{i}"]
        rows.append((i, "\n".join(lines), "a" if i % 3 else None))
    return rows + rows[:5]


def test_edge_rows(frame, edge_rows):
    key = lambda r: tuple(map(str, r))
    assert sorted(judged(frame(edge_rows), 1, 0.0), key=key) == sorted(brute(edge_rows, 1, 0.0), key=key)


def test_frequent_lines_and_depletion(frame):
    rows = shared_rows()
    key = lambda r: tuple(map(str, r))
    got, want = sorted(judged(frame(rows), 5, 0.01), key=key), sorted(brute(rows, 5, 0.01), key=key)
    assert got == want
    assert any(r[6] for r in want) and any(not r[7] and not r[8] for r in want)


def test_repeats_are_exact(frame):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 40))), "a") for i in range(300)]
    got = {r[0]: r[5] for r in judged(frame(rows), 20, 0.01)}
    assert got == {i: base(t)[4] for i, t, _ in rows}


def test_stage_agrees_with_verdicts(frame, edge_rows):
    rows = shared_rows() + edge_rows
    df = frame(rows)
    found = q.signals(df)
    bad = q.frequent_lines(found)
    kept = q.judge(found, bad).where("kept").select("doc_id").collect()
    out = q.apply_rules(df)
    assert out.columns == df.columns
    got = out.collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, (r.doc_id for r in kept)))
    assert all(r.n_chars == len(r.text) for r in got)
    bad_lines = bad.select(F.explode("bad")).count()
    assert bad_lines and not any("newsletter" in r.text and r.source == "a" and r.doc_id is not None and r.doc_id < 120
                                 for r in got)


def test_copies_do_not_condemn_their_lines(frame):
    text = "\n".join(" ".join(f"word{n}x{k}" for k in range(12)) for n in range(8))
    rows = [(i, text, "a") for i in range(200)] + [(1000 + i, f"quite other words number {i} stand here and go on for a while", "a")
                                                   for i in range(50)]
    assert all(r[8] for r in judged(frame(rows), 20, 0.01))


def test_empty(frame):
    df = frame([])
    assert q.quality_rules(df).count() == 0 and q.apply_rules(df).count() == 0
