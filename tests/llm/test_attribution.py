import base64

import pytest
from pyspark.sql import functions as F

from rebasis.llm import attribution as a


@pytest.fixture(scope="module")
def encoding():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(P.path(a.VOCABULARY), "rb"))}
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_chars(encoding, text):
    """The characters each token touches, one byte at a time."""
    owner = [n for n, c in enumerate(text) for _ in c.encode()]
    at, out = 0, []
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        out.append(sorted(set(owner[at:at + n])))
        at += n
    return out


def brute(encoding, text, sections, rule="most"):
    """{section: (tokens, of them boundary tokens)} with sections (name, start, end)."""
    counts = {s: [0, 0] for s, *_ in sections}
    for chars in token_chars(encoding, text):
        share = {s: sum(x <= c < y for c in chars) for s, x, y in sections}
        touched = [s for s, n in share.items() if n]
        if rule == "most":
            best = max(touched, key=lambda s: (share[s], -touched.index(s)), default=None)
        else:
            best = next((s for s, x, y in sections if x <= chars[0] < y), None)
        counts.setdefault(best, [0, 0])[0] += 1
        counts[best][1] += len(touched) > 1
    return counts


def lines(text):
    out, at = [], 0
    for n, line in enumerate(text.split("\n")):
        end = min(at + len(line) + 1, len(text))
        out.append((n, at, end))
        at = end
    return out


def test_lines(frame, edge_rows, encoding):
    rows = [r for r in edge_rows if r[0] not in (5, None)] + [(20, "a\n\n\nb \n \n\tc.\n\n", "a"), (21, "\n", "a"), (22, "é\n漢字😀\n\nx", "b")]
    got = {}
    for r in a.section_tokens(frame(rows)).collect():
        got.setdefault(r.doc_id, {})[r.section] = [r.n_tokens, r.n_boundary_tokens]
    assert got == {i: brute(encoding, t or "", lines(t or "")) for i, t, _ in rows}
    assert sum(b for d in got.values() for _, b in d.values()) > 0


@pytest.mark.parametrize("rule", ["most", "first"])
def test_spans_and_gaps(spark, encoding, rule):
    text = "The heading 漢字\n\n  Body text, with naïve words.\nTail"
    spans = [(7, 2, 9), (8, 9, 14), (9, 17, 30), (10, 33, 34)]
    df = spark.createDataFrame([(1, text, spans), (2, text, []), (3, None, None)],
                               "doc_id long, text string, spans array<struct<section:long,start:long,end:long>>")
    got = {}
    for r in a.section_tokens(df, rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = [r.n_tokens, r.n_boundary_tokens]
    assert got[1] == brute(encoding, text, spans, rule)
    assert got[2] == {None: [len(encoding.encode_ordinary(text)), 0]} and 3 not in got


def test_fields(spark, encoding):
    df = spark.createDataFrame([(1, "Title é", "some body text"), (2, None, "only body")], "doc_id long, title string, body string")
    joined = a.of_fields(df, ["title", "body"])
    for r in a.section_tokens(joined).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect():
        text = "Title é\nsome body text" if r.doc_id == 1 else "\nonly body"
        assert r.n == len(encoding.encode_ordinary(text))


def test_very_long_words(frame, encoding):
    rows = [(1, "a" * 50_000, "a"), (2, "ab cd\n" * 20_000, "a")]
    got = a.section_tokens(frame(rows)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(encoding.encode_ordinary(t)) for i, t, _ in rows}


def test_empty(frame):
    assert a.section_tokens(frame([])).count() == 0
