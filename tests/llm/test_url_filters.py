import math
from collections import Counter

from rebasis.llm import queries, url_filters as u


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    return host, tail[: next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]


def rule_of(host, path, rules):
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [
    None, "", "no scheme", "http://", "://x.com/", "http://example.com/en/1", "http://EXAMPLE.com/EN/1", "http://www.example.com/en/a?b=c&d=e#f",
    "https://a.www.example.com/en/", "http://notexample.com/en/", "http://example.com", "http://example.com?x=/en/", "http://example.com#/en/",
    "http://a.net/es/1", "http://a.net/fr/", "http://a.net/en/", "http://net/es/", "http://x.org/a/b//c?&&k=1&", "ftp://u:p@h.com:80/z",
    "http://a://b.com/q", "http://multi\nline.com/\npath?x", "http://" + "sub." * 60 + "example.com/en/" + "x" * 3000, "HTTP://ÀÉ.com/é",
    "http://.com/", "http://a..net/es/",
] + [f"http://site{i}.example.{t}/{p}/{i}" for i in range(40) for t in ("com", "net", "org") for p in ("en", "fr")]


def judge(spark, urls, rules):
    pages = spark.createDataFrame([(n, x, "<html>", 1.0, "s") for n, x in enumerate(urls)],
                                  "page_id long, url string, html string, depth double, suffix string").repartition(3)
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: r for r in u.judged(pages, table).collect()}


def test_rules_and_verdicts(spark):
    urls = URLS + URLS[5:9]
    got = judge(spark, urls, queries.URL_RULES)
    assert len(got) == len(urls)
    for n, url in enumerate(urls):
        host, path = split(url)
        rule, verdict = rule_of(host, path, queries.URL_RULES)
        assert (got[n].host, got[n].path, got[n].rule) == (host, path, rule), url
        assert got[n].verdict in ("allow", "block") and (verdict is None or got[n].verdict == verdict)
        assert 0 <= got[n].block_score <= 1


def test_no_rules_or_one_verdict(spark):
    assert {r.verdict for r in judge(spark, URLS, []).values()} == {"allow"}
    assert {r.verdict for r in judge(spark, URLS, [("com", "/", "block")]).values()} == {"block"}
    assert judge(spark, [], queries.URL_RULES) == {}


def test_features(spark):
    pages = spark.createDataFrame([(n, x) for n, x in enumerate(URLS)], "page_id long, url string")
    for r in u.lexical(u.parts(pages)).collect():
        url = r.url or ""
        counts = Counter(url)
        bits = -sum(c / len(url) * math.log2(c / len(url)) for c in counts.values())
        assert math.isclose(r.entropy, bits, abs_tol=1e-9)
        assert r.digits == (sum(c in "0123456789" for c in url) / len(url) if url else 0)
        query = url.split("?", 1)[1].split("#")[0] if "?" in url else ""
        assert r.parameters == sum(bool(x) for x in query.split("&"))
        assert r.depth == sum(bool(x) for x in r.path.split("/"))


def test_trees_learn_what_rules_show(spark):
    rules = [("good.org", "/", "allow"), ("bad.org", "/", "block")]
    urls = [f"http://good.org/a/{i}" for i in range(60)] + [f"http://bad.org/{i}?a=1&b=2&c=3&d={i * 7919}" for i in range(60)]
    new = ["http://new.example/a/77", "http://new.example/5?a=1&b=2&c=3&d=99991"]
    got = judge(spark, urls + new, rules)
    assert got[120].verdict == "allow" and got[121].verdict == "block"
