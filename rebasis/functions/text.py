"""Column forms of the text functions: trim, title join, repair, prefix, cap, slug."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rebasis.functions.vectors import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# What Python's str.strip removes, as a regular-expression class.
SPACE_CLASS = r"[\s\p{Z}\x0B\x1C-\x1F\x85]+"

# Bytes 0x80-0x9F that windows-1252 shows as printable characters.
_CP1252 = {
    byte: bytes([byte]).decode("cp1252")
    for byte in range(0x80, 0xA0)
    if bytes([byte]).decode("cp1252", errors="ignore")
}
CP1252_SHOWN = "".join(_CP1252.values())
CP1252_BYTES = "".join(chr(byte) for byte in _CP1252)

# Typographic characters and their plain forms.
CURLY_SINGLE = "".join(map(chr, (0x2BC, 0x2018, 0x2019, 0x201A, 0x201B)))
CURLY_DOUBLE = "".join(map(chr, (0x201C, 0x201D, 0x201E, 0x201F)))
LIGATURES = {
    "Ĳ": "IJ", "ĳ": "ij", "ŉ": "ʼn",
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz",
    "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž",
    "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj",
    "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl",
    "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st",
}
CONTROL_CLASS = r"[\x00-\x08\x0B\x0E-\x1F\x7F\x{FEFF}\x{206A}-\x{206F}\x{FFF9}-\x{FFFC}]"
LINE_BREAKS = r"\r\n|[\r\x{2028}\x{2029}\x85]"

# Full-width forms of the printable ASCII range, and the wide space.
WIDE_CHARS = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + chr(0x3000)
NARROW_CHARS = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
WIDE_CLASS = f"[{WIDE_CHARS[0]}-{WIDE_CHARS[-2]}{WIDE_CHARS[-1]}]"

# Any character that the steps after mojibake repair would change.
TYPOGRAPHIC = "|".join([
    f"[{CURLY_SINGLE}{CURLY_DOUBLE}{''.join(LIGATURES)}]", WIDE_CLASS, LINE_BREAKS, CONTROL_CLASS,
])


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends, not only the space character.

    The pattern, which tries every space of a text, runs only where the first or last character is one.
    """

    def trimmed(text: Column) -> Column:
        ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
        return F.when(ends.rlike(SPACE_CLASS), F.regexp_replace(text, f"^{SPACE_CLASS}|{SPACE_CLASS}$", "")).otherwise(text)

    return let(_col(c), trimmed)


def title_and_text(text: Column | str, title: Column | str | None = None) -> Column:
    """``title + " " + text``, trimmed; a missing title counts as empty.

    A missing text stays missing, so that the corpus invariants can see it.
    """
    if title is None:
        return strip(text)
    title = strip(F.coalesce(_col(title), F.lit("")))
    return strip(F.concat(title, F.lit(" "), strip(text)))


# A UTF-8 lead byte and a continuation byte, each shown as a character.
MOJIBAKE = f"[\\xc2-\\xf4][\\x80-\\xbf{CP1252_SHOWN}]"


def _where(text: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """Apply ``fix`` only where ``pattern`` occurs; most text skips the costly steps."""
    return let(text, lambda t: F.when(t.rlike(pattern), fix(t)).otherwise(t))


def _undo_double_decoding(line: Column) -> Column:
    """Read the characters back as bytes and decode those as UTF-8.

    Applied only if every character is a byte and the bytes are valid UTF-8.
    """

    def decode(as_bytes: Column) -> Column:
        text = F.try_validate_utf8(F.encode(as_bytes, "ISO-8859-1").cast("string"))
        return F.when(as_bytes.rlike(r"^[\x00-\xff]*$"), F.coalesce(text, line)).otherwise(line)

    return let(F.translate(line, CP1252_SHOWN, CP1252_BYTES), decode)


def _spread_ligatures(text: Column) -> Column:
    for char, plain in LIGATURES.items():
        text = F.replace(text, F.lit(char), F.lit(plain))
    return text


def repair(c: Column | str) -> Column:
    """Undo mojibake line by line, then plain ligatures, quotes, widths, breaks, controls.

    Plain ASCII text without carriage returns or control characters is passed through.
    """

    def by_line(text: Column) -> Column:
        lines = F.split(text, "\n", -1)
        return F.array_join(
            F.transform(lines, lambda x: _where(x, MOJIBAKE, _undo_double_decoding)), "\n"
        )

    def typography(text: Column) -> Column:
        text = _where(text, f"[{''.join(LIGATURES)}]", _spread_ligatures)
        text = F.regexp_replace(text, f"[{CURLY_SINGLE}]", "'")
        text = F.regexp_replace(text, f"[{CURLY_DOUBLE}]", '"')
        text = _where(text, WIDE_CLASS, lambda t: F.translate(t, WIDE_CHARS, NARROW_CHARS))
        text = F.regexp_replace(text, LINE_BREAKS, "\n")
        return F.regexp_replace(text, CONTROL_CLASS, "")

    def all_steps(text: Column) -> Column:
        return _where(_where(text, MOJIBAKE, by_line), TYPOGRAPHIC, typography)

    return _where(_col(c), r"[^\n\t\x20-\x7e]", all_steps)


def corrupt(c: Column | str) -> Column:
    """The opposite of :func:`repair`'s first step: a fixture for it."""
    latin = F.decode(F.encode(_col(c), "UTF-8"), "ISO-8859-1")
    return F.translate(latin, CP1252_BYTES, CP1252_SHOWN)


# ASCII white space without the vertical tab, the same in Java, RE2 and DuckDB
TOKEN_SPACE = "[ \\t\\n\\f\\r]+"


def with_prefix(prefix: Column | str, text: Column | str) -> Column:
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, _col(text))


def cap_tokens(text: Column | str, n: int) -> Column:
    """The first ``n`` white-space tokens, joined by single spaces."""
    return F.array_join(F.slice(tokens(text), 1, n), " ")


def tokens(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), TOKEN_SPACE), lambda t: t != "")


def slug(name: Column | str) -> Column:
    return F.translate(_col(name), "/", "_")


def short_name(name: Column | str, length: int = 18) -> Column:
    return F.substring(F.substring_index(_col(name), "/", -1), 1, length)
