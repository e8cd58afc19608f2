"""Column forms of the vector functions: dot, norm, unit scaling, half rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Inside a lambda a plain reference would be inlined and re-evaluated for
    every array element.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product in double; the cosine when both sides have unit norm."""
    a, b = (_col(c).cast("array<double>") for c in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    v = _col(v).cast("array<double>")
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column | str, floor: float = NORM_FLOOR) -> Column:
    """Scale to unit length; a zero vector stays zero."""
    v = _col(v).cast("array<double>")
    return let(
        F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x / n)
    )


def half_round(v: Column | str) -> Column:
    """Round every element to the nearest value a 16-bit float can hold."""

    def one(x: Column) -> Column:
        exponent = F.greatest(F.floor(F.log2(F.abs(x))).cast("double"), F.lit(-14.0))
        return F.when(x == 0.0, F.lit(0.0)).otherwise(
            let(F.pow(F.lit(2.0), exponent - 10.0), lambda ulp: F.rint(x / ulp) * ulp)
        )

    return F.transform(_col(v).cast("array<double>"), one).cast("array<float>")


def ratio(part: Column | str, whole: Column | str) -> Column:
    """``part / whole``, or 0 where ``whole`` is 0."""
    part, whole = _col(part), _col(whole)
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def dim_of(df: DataFrame, vector: str = "embedding") -> int:
    """The vector length of the first row; 0 for an empty table."""
    row = df.select(F.size(vector).alias("d")).first()
    return row.d if row else 0
