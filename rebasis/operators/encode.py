"""Text to unit vectors: pluggable encoders, shard layout and the resume plan."""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import ArrowUDFType

from rebasis.functions.text import TOKEN_SPACE, cap_tokens, with_prefix
from rebasis.functions.vectors import NORM_FLOOR
from rebasis.operators.arrow import list_column
from rebasis.registry import BATCH_SIZE, SHARD_ROWS


class Encoder(Protocol):
    """What a model has to offer. ``load`` runs once per Python worker.

    A model that brings a query prompt of its own has it as ``query_prompt``.
    """

    name: str
    revision: str
    dim: int

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        """A function from an array of texts to a float32 (texts, dim) matrix."""
        ...


class HashedTermEncoder:
    """Term frequencies in ``dim`` buckets by the MD5 of ``salt + token``.

    Tokens are lower-case and split at ASCII white space, as by ``text.tokens``. Needs no model files.
    """

    # Tokens whose bucket one worker remembers, and their greatest length in bytes.
    REMEMBERED = 1 << 17
    REMEMBERED_CHARS = 64

    def __init__(self, dim: int = 256, salt: str = "", name: str | None = None):
        self.dim, self.salt = dim, salt
        self.name = name or f"hashed-terms-{dim}" + (f"-{salt}" if salt else "")
        self.revision = "1"

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        dim, salt, most, longest = self.dim, self.salt, self.REMEMBERED, self.REMEMBERED_CHARS
        # two generations: most tokens come once, and those that come again move to the younger one
        seen: dict[bytes, int] = {b"": -1}
        older: dict[bytes, int] = {}
        start = hashlib.md5(salt.encode())

        def bucket(token: bytes) -> int:
            found = older.get(token)
            if found is None:
                digest = start.copy()
                digest.update(token)
                found = int.from_bytes(digest.digest()[:4], "big") % dim
            if len(token) <= longest and len(seen) < most // 2:
                seen[token] = found
            return found

        def encode(texts: np.ndarray) -> np.ndarray:
            nonlocal seen, older
            # each distinct token of a batch is looked up once; counts are one pass over all tokens
            lower = pa.array([t.lower() if t else "" for t in texts], pa.string())
            if pc.any(pc.match_substring(lower, "\v")).as_py():  # no space to TOKEN_SPACE
                lists = pc.split_pattern_regex(lower, pattern=TOKEN_SPACE)
            else:
                lists = pc.ascii_split_whitespace(lower)
            coded = lists.flatten().dictionary_encode()
            if len(seen) >= most // 2:
                seen, older = {b"": -1}, seen
            words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
            known = map(seen.get, words)
            place = np.array([bucket(t) if p is None else p for t, p in zip(words, known)], np.int64)
            place = place[coded.indices.to_numpy()] if len(coded) else place
            text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
            real = place >= 0
            cells = np.bincount(text[real] * dim + place[real], minlength=len(texts) * dim)
            return cells.reshape(len(texts), dim).astype(np.float32)

        return encode


# Models held by a worker, by the call that made them: loaded once, whatever the number of tasks.
_LOADED: OrderedDict[str, Callable[[np.ndarray], np.ndarray]] = OrderedDict()
MODELS_HELD = 4


def _model(key: str, encoder: Encoder) -> Callable[[np.ndarray], np.ndarray]:
    if key not in _LOADED:
        while len(_LOADED) >= MODELS_HELD:
            _LOADED.popitem(last=False)
        _LOADED[key] = encoder.load()
    _LOADED.move_to_end(key)
    return _LOADED[key]


def encode_udf(encoder: Encoder, batch_size: int = BATCH_SIZE, half: bool = False,
               distinct_calls: bool = False):
    """A column function text -> unit vector; ``half`` rounds to 16-bit floats.

    Texts become Python strings one batch of ``batch_size`` at a time; vectors stay in Arrow.
    With ``distinct_calls`` the optimizer may not merge equal calls, so that
    calling it twice encodes twice.
    """
    dim, name, key = encoder.dim, encoder.name, uuid.uuid4().hex

    def predict(model, texts: np.ndarray) -> pa.Array:
        vectors = np.asarray(model(texts))
        if vectors.dtype != np.float32:
            raise ValueError(f"{name} returned {vectors.dtype}, expected float32")
        if vectors.shape != (len(texts), dim):
            raise ValueError(f"{name} returned {vectors.shape}, expected {(len(texts), dim)}")
        wide = vectors.astype(np.float64)
        length = np.linalg.norm(wide, axis=1, keepdims=True)
        scaled = (wide / np.maximum(length, NORM_FLOOR)).astype(np.float32)
        return list_column(scaled.astype(np.float16).astype(np.float32) if half else scaled, pa.float32())

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(key, encoder)
        for texts in columns:
            made = [
                predict(model, texts.slice(lo, batch_size).to_numpy(zero_copy_only=False))
                for lo in range(0, len(texts), batch_size)
            ]
            yield pa.concat_arrays(made) if made else pa.array([], pa.list_(pa.float32()))

    udf = F.arrow_udf(run, T.ArrayType(T.FloatType()), ArrowUDFType.SCALAR_ITER)
    return udf.asNondeterministic() if distinct_calls else udf


def encode(df: DataFrame, encoder: Encoder, prefix: str = "", text: str = "text",
           output: str = "embedding", batch_size: int = BATCH_SIZE, half: bool = False,
           max_tokens: int | None = None) -> DataFrame:
    """Add the unit vector of ``prefix + text``; whole texts unless ``max_tokens`` is set."""
    given: Column = with_prefix(prefix, text)
    if max_tokens is not None:
        given = cap_tokens(given, max_tokens)
    return df.withColumn(output, encode_udf(encoder, batch_size, half)(given))


def shard_of(index: Column | str = "row_idx", rows: int = SHARD_ROWS) -> Column:
    index = F.col(index) if isinstance(index, str) else index
    return F.floor(index / rows)


def expected_shards(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard_id, n_rows) of a table with a dense ``row_idx``."""
    return rows.groupBy(shard_of("row_idx", shard_rows).alias("shard_id")).agg(
        F.count("*").alias("n_rows")
    )


def completed_shards(vectors: DataFrame) -> DataFrame:
    """Row counts of stored shards by what they were made from."""
    return vectors.groupBy(
        "model", "split", "prefix", "input_hash", "revision", "max_tokens", "shard_id"
    ).agg(F.count("*").alias("n_rows"))


def resume_plan(expected: DataFrame, vectors: DataFrame, model: str, split: str,
                prefix: str, input_hash: str, revision: str,
                max_tokens: int | None = None) -> DataFrame:
    """The expected shards not yet stored whole, with this prefix, input, revision and token cap."""
    done = completed_shards(
        vectors.where((F.col("model") == model) & (F.col("split") == split))
    ).where(
        (F.col("prefix") == prefix) & (F.col("input_hash") == input_hash) & (F.col("revision") == revision)
        & F.col("max_tokens").eqNullSafe(F.lit(max_tokens).cast("int"))
    )
    return expected.join(done.select("shard_id", "n_rows"), ["shard_id", "n_rows"], "left_anti")
