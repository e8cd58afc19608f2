import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, w string, bad int, size string, fp string, host string"


def rows_of(pairs):
    """Document rows of (doc_id, text, source), with extra columns that operators use as names."""
    return [(i, t, "en", s, None if t is None else len(t), 1, "x", 2, "s", "f", "g") for i, t, s in pairs]


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text, source) triples."""
    def make(pairs):
        return spark.createDataFrame(rows_of(pairs), SCHEMA).repartition(3)
    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing at dawn near an old stone mill"
LONG = " ".join(f"word{i % 4999}" for i in range(60_000))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and white texts, short, long, repeated and tied rows, marks and other scripts."""
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n\x0b ", "b"), (4, "one", None), (5, PROSE, "a"), (5, PROSE, "a"),
        (6, PROSE + ".", "b"), (7, PROSE.upper(), None), (8, LONG, "a"), (None, PROSE, "b"), (None, None, None),
        (9, "x " * 400, "c"), (10, "naïve café Straße ÉCOLE ñandú — “quoted” ‘s don't I'll 123 4５6 日本語  nb́ é", "c"),
        (11, "line one\nline one\n\n  \nline two # $5 & <b>|</b> 100%\n", "c"), (12, "a" * 5000, "d"),
        (13, "<|endoftext|> and <|ENDOFTEXT|>\x1f\x85 end", "d"), (5, "another text of the same id", "a"),
        (-3, PROSE.replace("dog", "cat"), "a"),
    ]
