"""Column forms and small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebasis.functions.vectors import let
from rebasis.session import fresh_path, small, stored

__all__ = ["SPACE", "WORD", "QUERIES", "ORACLES", "query", "table", "text_words", "line_words", "let",
           "small", "stored", "fresh_path", "or_null", "long_of", "fold"]

# ASCII white space, as one run; and what lies between two runs.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL twin if it has one."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_words(text: Column | str) -> Column:
    """The words of a text between ASCII white space; none for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def line_words(text: Column | str) -> Column:
    """The words of each ``\\n``-split line of a text."""
    return F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), text_words)


def or_null(df: DataFrame, name: str, kind: str) -> DataFrame:
    """``df`` with column ``name``, null where the table has none."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def long_of(digest: Column) -> Column:
    """The first 15 hex digits of an MD5 as a number from 0 to 2^60 - 1; DuckDB can do the same."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")
