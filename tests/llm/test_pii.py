import hashlib
import re

from rebasis.llm import pii, queries

KINDS = ["email", "ip", "card", "phone"]
RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def ok(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) < 256 for p in s.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text):
    if not text:
        return []
    return sorted(((k, m.start(), m.end()) for k in KINDS for m in re.finditer(RAW[k], text) if ok(k, m.group())),
                  key=lambda x: (KINDS.index(x[0]), x[1]))


TEXTS = [
    None, "", "plain words only", "write a.b@example.com or c_d@mail.co.uk today", "ip 10.0.0.1, 256.1.1.1, 1.2.3.4.5",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112 and 4111111111111111111111", "call +1 (555) 123-4567 or +12 34",
    "mail john.doe at example dot com now", "write to jane [at] mail (dot) org", "jоhn@еxample.com", "x ＋４４ ２０ ７９４６ ０９５８",
    "m​ary@site​.org", "call plus one five five five one two three four five six seven", "meet at noon. Then at home",
    "name at host . example . org end", "a@b.com. Next", "one two three apples", "日本語 テキスト 1.2.3.4 ok",
    "x@y.zz " * 2000, "4" * 50000,
]


def test_base_matches_plain_regex():
    for t in TEXTS:
        assert [s[:3] for s in pii.spans(t) if s[3]] == brute_base(t), t


def test_disguises_are_found_at_source_offsets():
    want = {
        "mail john.doe at example dot com now": ("email", "john.doe at example dot com"),
        "write to jane [at] mail (dot) org": ("email", "jane [at] mail (dot) org"),
        "jоhn@еxample.com": ("email", "jоhn@еxample.com"),
        "x ＋４４ ２０ ７９４６ ０９５８": ("phone", "＋４４ ２０ ７９４６ ０９５８"),
        "m​ary@site​.org": ("email", "m​ary@site​.org"),
        "call plus one five five five one two three four five six seven": ("phone", "plus one five five five one two three four five six seven"),
        "name at host . example . org end": ("email", "name at host . example . org"),
    }
    for text, (kind, piece) in want.items():
        added = [(k, text[s:e]) for k, s, e, b in pii.spans(text) if not b]
        assert added == [(kind, piece)], text


def test_clean_text_gets_nothing_added():
    for t in ["meet at noon. Then at home", "one two three apples", "a@b.com. Next", "plain words only", "at the end"]:
        assert all(b for *_, b in pii.spans(t)), t


def test_query_digest(spark):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "y", None), (3, TEXTS[3], "x", [2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii string, spans array<int>").repartition(3)
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.spans)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        base = brute_base(t)
        assert r.doc_id == i
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in base) for x in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e, _ in pii.spans(t))


def test_registered():
    assert "op12_pii_deobfuscation" in queries.__dict__
