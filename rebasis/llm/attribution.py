"""Token counts by section, from one encoding of the whole document.

A document is encoded once, as sections encoded alone would be tokenized otherwise at
their edges. The vocabulary is byte-level, so tokens lay out the text's bytes without gap; byte
spans become character spans, and tokens and sections meet by an interval join (two
binary searches per token) inside the document.

Rule for a token that touches several sections: ``most`` gives it to the
section with most of its characters, the earlier one if equal; ``first`` to the
section of its first character. A token outside all sections counts for
none (section null), so counts always add up to the document's tokens.

Sections are lines by default, each with its line break, or the column ``spans``: an array of
(section, start, end) in characters, sorted and disjoint. ``of_fields`` builds both from columns.

A null text is an empty one: one line, no tokens. Null ids and repeated rows are
counted row by row. Long texts are handled whole. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
SPANS = "array<struct<section:bigint,start:bigint,end:bigint>>"


class SpanEncoder:
    """Byte lengths of the tokens of a text."""

    def __init__(self, path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(VOCABULARY), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def __call__(self, text: str) -> np.ndarray:
        return self.sizes[self.encoding.encode_ordinary(text)]


_encoders: dict[str | None, SpanEncoder] = {}


def encoder(path: str | None) -> SpanEncoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = SpanEncoder(path)
    return _encoders[path]


def char_spans(sizes: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last character of every token; a token inside a character has that character."""
    ends = np.cumsum(sizes)
    seen = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    starts = ends - sizes
    inside = starts < len(raw)
    first = seen[starts] - (inside & ((raw[np.minimum(starts, len(raw) - 1)] & 0xC0) == 0x80) if len(raw) else 0)
    return first, seen[ends]


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines, each with its line break."""
    begins = (raw & 0xC0) != 0x80
    chars = raw[begins]
    cuts = np.flatnonzero(chars == 10) + 1
    return np.concatenate([[0], cuts]), np.concatenate([cuts, [len(chars)]])


def attribute(first: np.ndarray, last: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "most"
              ) -> tuple[np.ndarray, np.ndarray]:
    """(section number or -1, touches several) of each token span."""
    if not len(starts):
        return np.full(len(first), -1), np.zeros(len(first), bool)
    a = np.searchsorted(ends, first, "right")
    b = np.searchsorted(starts, last, "left") - 1
    owner = np.where(b >= a, a, -1)
    several = b > a
    if rule == "first":
        owner = np.where(starts[np.minimum(a, len(starts) - 1)] > first, -1, owner)
    elif rule == "most":
        for t in np.flatnonzero(several):
            s = np.arange(a[t], b[t] + 1)
            owner[t] = s[np.argmax(np.minimum(ends[s], last[t]) - np.maximum(starts[s], first[t]))]
    else:
        raise ValueError(f"unknown rule {rule!r}")
    return owner, several


def _counter(path: str | None, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # imported by name: what is pickled with the task would start without the worker's encoder
        from rebasis.llm.attribution import encoder

        encode = encoder(path)
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            spans = batch.column("spans") if given else None
            for n, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"))):
                text = text.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                first, last = char_spans(encode(text), raw)
                if given:
                    rows = spans[n].as_py() or []
                    names = [r["section"] for r in rows]
                    starts, ends = (np.array([r[k] for r in rows], np.int64) for k in ("start", "end"))
                else:
                    starts, ends = line_spans(raw)
                    names = range(len(starts))
                owner, several = attribute(first, last, starts, ends, rule)
                tokens = np.bincount(owner + 1, minlength=len(starts) + 1)
                shared = np.bincount(owner[several] + 1, minlength=len(starts) + 1)
                outside = tokens[0] > 0
                at = 0 if outside else 1
                k = len(starts) + outside
                cols[0] += [doc_id] * k
                cols[1] += ([None] if outside else []) + list(names)
                cols[2] += ([None] if outside else []) + (ends - starts).tolist()
                cols[3] += tokens[at:].tolist()
                cols[4] += shared[at:].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in cols],
                ["doc_id", "section", "n_chars", "n_tokens", "n_boundary_tokens"])

    return run


def section_tokens(docs: DataFrame, rule: str = "most", path: str | None = None) -> DataFrame:
    """(doc_id, section, n_chars, n_tokens, n_boundary_tokens): a row per section of every document."""
    given = "spans" in docs.columns
    cols = [F.col("doc_id").cast("long").alias("doc_id"), "text"] + ([F.col("spans").cast(SPANS).alias("spans")] if given else [])
    return docs.select(*cols).mapInArrow(
        _counter(path, rule, given),
        "doc_id bigint, section bigint, n_chars bigint, n_tokens bigint, n_boundary_tokens bigint")


def of_fields(docs: DataFrame, fields: list[str], between: str = "\n") -> DataFrame:
    """``docs`` with the fields joined as ``text`` and each field's span; a null field is empty."""
    spans, at = [], F.lit(0).cast("long")
    for n, name in enumerate(fields):
        size = F.length(F.coalesce(F.col(name), F.lit(""))).cast("long")
        spans.append(F.struct(F.lit(n).cast("long").alias("section"), at.alias("start"), (at + size).alias("end")))
        at = at + size + len(between)
    joined = F.concat_ws(between, *(F.coalesce(F.col(f), F.lit("")) for f in fields))
    return docs.select("doc_id", joined.alias("text"), F.array(*spans).alias("spans"))
