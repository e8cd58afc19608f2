import pytest
from pyspark.sql import functions as F

from rebasis.functions import text as X

FIXED = {
    "donâ€™t": "don't",
    "cafÃ©": "café",
    "cafÃ©\n日本": "café\n日本",
    "“q” ‘s’": "\"q\" 's'",
    "a\r\nb\rc": "a\nb\nc",
    "x\x00\x07y" + chr(0xFEFF) + "z": "xyz",
    "ﬁx Ａ１": "fix A1",
}
KEPT = ["café", "naïve → x", "日本", "plain", "", "tab\tand\nline", "Ã alone", "5 € ¢"]


@pytest.mark.parametrize("given,wanted", [*FIXED.items(), *((k, k) for k in KEPT), (None, None)])
def test_repair(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(X.repair("t")).first()[0] == wanted


def test_repair_undoes_corruption(spark):
    texts = ["Ünïcödé ßtraße", "déjà vu — été", "Ñandú €5", "ascii"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(X.repair(X.corrupt("t"))).collect()]
    assert got == texts


def test_repair_is_idempotent(spark):
    df = spark.createDataFrame([(t,) for t in [*FIXED, *KEPT]], "t string")
    once = X.repair("t")
    rows = df.select(once.alias("a"), X.repair(once).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_strip_equals_python(spark):
    pads = [" ", "\x1c", "\x1f", "\x85", "\x0b", "\x0c", " \t\r\n", chr(0xA0), chr(0x3000), chr(0x2003)]
    texts = [p + "a b" + p + "c" + p for p in pads] + ["", "  ", "x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.strip("t")).collect()] == [t.strip() for t in texts]


def test_title_and_text(spark):
    df = spark.createDataFrame(
        [(" T ", " body "), (None, " body "), ("T", None), ("", "")], "title string, text string"
    )
    assert [r[0] for r in df.select(X.title_and_text("text", "title")).collect()] == [
        "T body", "body", None, "",
    ]
    assert [r[0] for r in df.select(X.title_and_text("text")).collect()] == ["body", "body", None, ""]


def test_names_and_caps(spark):
    df = spark.createDataFrame([("org/a-rather-long-model-name", "a  b\nc d ")], "m string, t string")
    row = df.select(
        X.slug("m").alias("slug"), X.short_name("m").alias("short"),
        X.cap_tokens("t", 3).alias("cap"), X.with_prefix("query: ", "t").alias("p"),
        F.size(X.tokens("t")).alias("n"),
    ).first()
    assert row == ("org_a-rather-long-model-name", "a-rather-long-mode", "a b c", "query: a  b\nc d ", 4)
