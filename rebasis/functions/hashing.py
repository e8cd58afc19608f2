"""Seeded order keys and row hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(ident: Column | str, seed: int, stream: str = "") -> Column:
    """A uniform, seed-dependent sort key for an id.

    ``stream`` gives independent draws from one seed, as for sampling and
    shuffling the same ids.
    """
    ident = F.col(ident) if isinstance(ident, str) else ident
    return F.md5(F.concat(F.lit(f"{seed}:{stream}"), ident.cast("string")))


def sha16(text: Column) -> Column:
    """The first 16 hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)
