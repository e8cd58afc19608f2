"""Personal data in texts, found through an offset-preserving deobfuscation.

Base detection runs four patterns on the text as it is (leftmost non-overlapping matches per
kind; a match failing its check is dropped, never retried shorter). The method then rewrites
the text through a chain of small transducers, each of which keeps, for every output
character, the source characters it came from:

1. characters: zero-width and soft-hyphen marks vanish, full-width forms and look-alike Cyrillic
   and Greek letters become ASCII, odd spaces, dots and dashes become plain ones;
2. at/dot disguises: ``[at]``, ``(dot)``, ``{at}``, and spaced ``at``/``dot`` words between
   the parts of an address become ``@`` and ``.``;
3. spelled digits: runs of three or more digit tokens (``zero`` ... ``nine`` or digits) have
   their words replaced by digits, and ``plus`` before such a run becomes ``+``.

The same four patterns run on the rewritten text, and every hit is mapped back to the source
characters of its first and last output character. Hits that overlap no base span of their kind
are added; base spans always stay.

Per document the result is an array of spans ``(kind, start, end, base)``, offsets in code
points of the source text, end exclusive, ordered by kind (email, ip, card, phone) and start.
A null or empty text has none; very long texts are scanned whole. Rows are independent, so
repeated rows, null ids and any other columns pass through unchanged.
"""

from __future__ import annotations

import re

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

# The base patterns and the order of the kinds.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}

# Look-alike letters and marks mapped to ASCII (full-width forms follow a rule).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M",
    "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "ο": "o", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "﹫": "@", "。": ".", "․": ".", "‧": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
VANISH = set("​‌‍⁠﻿­")
SPACES = set("              　")
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

_TOKEN = r"(?:[0-9]+|" + "|".join(DIGIT_WORDS) + r")"
_RUN = re.compile(r"(?i)\b(?:plus[\x20-]+)?" + _TOKEN + r"(?:[\x20,-]+" + _TOKEN + r"){2,}\b")
_WORD = re.compile(r"(?i)plus[\x20-]+|" + "|".join(DIGIT_WORDS))
_BRACKET_AT = re.compile(r"(?i)\s*[\[\(\{<]\s*(?:at|@)\s*[\]\)\}>]\s*")
_BRACKET_DOT = re.compile(r"(?i)\s*[\[\(\{<]\s*(?:dot|\.)\s*[\]\)\}>]\s*")
_BRACKETS = re.compile(r"[\[\(\{<]")
_AT_WORD = re.compile(r"(?i)\sat\s")
_SPELLED = re.compile(r"(?i)(?:" + "|".join(DIGIT_WORDS) + r")[\x20,-]+(?:[0-9]|" + "|".join(DIGIT_WORDS) + r")")
_LABEL = r"[A-Za-z0-9-]+"
_SEP = r"(?:\s+(?i:dot)\s+|\s+\.\s+|\.)"
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s+(?i:at)\s+|\s+@\s*|\s*@\s+)(?=" + _LABEL + r"(?:" + _SEP + _LABEL + r")*" + _SEP + r"[A-Za-z]{2,}(?![A-Za-z0-9-]))")
_SPACED_DOT = regex.compile(r"(?<=@" + _LABEL + r"(?:" + _SEP + _LABEL + r")*)(?:\s+(?i:dot)\s+|\s+\.\s+)(?=[A-Za-z0-9])")


class Mapped:
    """A rewritten text with, per character, the first and last+1 source offsets it stands for.

    The maps are built at the first change; until then every offset is its own.
    """

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | None = None
        self.end: list[int] | None = None

    def _maps(self) -> tuple[list[int], list[int]]:
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        return self.start, self.end

    def source(self, s: int, e: int) -> tuple[int, int]:
        """Source offsets of the rewritten span [s, e)."""
        return (s, e) if self.start is None else (self.start[s], self.end[e - 1])

    def chars(self, table: dict[int, str]) -> None:
        if self.text.translate(table) == self.text:
            return
        old_start, old_end = self._maps()
        out, start, end = [], [], []
        for c, s, e in zip(self.text, old_start, old_end):
            r = table.get(ord(c), c)
            out.append(r)
            start.extend([s] * len(r))
            end.extend([e] * len(r))
        self.text, self.start, self.end = "".join(out), start, end

    def sub(self, pattern, repl) -> None:
        """Replace each match by ``repl(match)``; new characters stand for the whole match."""
        matches = [m for m in pattern.finditer(self.text) if m.end() > m.start()]
        if not matches:
            return
        old_start, old_end = self._maps()
        pieces, start, end, at = [], [], [], 0
        for m in matches:
            a, b = m.span()
            pieces.append(self.text[at:a])
            start.extend(old_start[at:a])
            end.extend(old_end[at:a])
            r = repl(m)
            pieces.append(r)
            start.extend([old_start[a]] * len(r))
            end.extend([old_end[b - 1]] * len(r))
            at = b
        pieces.append(self.text[at:])
        start.extend(old_start[at:])
        end.extend(old_end[at:])
        self.text, self.start, self.end = "".join(pieces), start, end


def _char_table() -> dict[int, str]:
    table = {ord(c): "" for c in VANISH} | {ord(c): " " for c in SPACES}
    table |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width ASCII forms
    return table | {ord(k): v for k, v in HOMOGLYPHS.items()}


CHAR_TABLE = _char_table()


def _digits(m) -> str:
    return _WORD.sub(lambda w: "+" if w.group()[0] in "pP" else str(DIGIT_WORDS.index(w.group().lower())), m.group())


def deobfuscate(text: str) -> Mapped:
    """The rewritten text and its map back to source offsets."""
    t = Mapped(text)
    t.chars(CHAR_TABLE)
    # Each transducer runs only where its trigger occurs (a plain substring test).
    if _BRACKETS.search(t.text):
        t.sub(_BRACKET_AT, lambda m: "@")
        t.sub(_BRACKET_DOT, lambda m: ".")
    if "@" in t.text or _AT_WORD.search(t.text):
        t.sub(_SPACED_AT, lambda m: "@")
    if "@" in t.text:
        t.sub(_SPACED_DOT, lambda m: ".")
    if _SPELLED.search(t.text):
        t.sub(_RUN, _digits)
    return t


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def valid(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    digits = "".join(c for c in s if "0" <= c <= "9")
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    if kind == "phone":
        return 8 <= len(digits) <= 15
    return True


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass their check."""
    if not text:
        return []
    return [(k, m.start(), m.end()) for k in KINDS for m in COMPILED[k].finditer(text) if valid(k, m.group())]


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """Base spans, then the spans found only after deobfuscation, mapped to source offsets."""
    base = base_spans(text)
    found = [(k, s, e, True) for k, s, e in base]
    if text:
        t = deobfuscate(text)
        if t.start is not None:
            seen = set()
            for k, s, e in base_spans(t.text):
                a, b = t.source(s, e)
                if (k, a, b) in seen or any(k == k2 and a < e2 and s2 < b for k2, s2, e2 in base):
                    continue
                seen.add((k, a, b))
                found.append((k, a, b, False))
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                              StructField("end", IntegerType()), StructField("base", BooleanType())]))


@pandas_udf(SPANS)
def _spans(texts):
    import pandas as pd

    return pd.Series([[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in spans(t)]
                      for t in texts], dtype=object)


def find(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with column ``out``: the spans of each text (replacing a column of that name)."""
    return docs.withColumn(out, _spans(F.col(text)))


def joined(spans: Column, only_base: bool) -> Column:
    """``kind:start:end`` of the spans in their order, comma-joined."""
    kept = F.filter(spans, lambda s: s["base"]) if only_base else spans
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                  s["end"].cast("string"))), ",")


def digest(docs: DataFrame, column: str = "pii") -> DataFrame:
    """Per row: doc_id, base counts per kind, sha256 of the base spans, and all spans as text."""
    s = F.coalesce(F.col(column), F.array().cast(SPANS))
    def of(kind: str):
        return lambda x: x["base"] & (x["kind"] == kind)

    counts = [F.size(F.filter(s, of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return docs.select("doc_id", *counts, F.sha2(joined(s, True), 256).alias("base_sha256"),
                       joined(s, False).alias("spans"),
                       F.size(F.filter(s, lambda x: ~x["base"])).cast("long").alias("n_added"))
