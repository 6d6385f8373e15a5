"""Column expressions for text preparation and basic tokenisation.

Everything here is a built-in Catalyst expression (regex, substring, split and
higher-order functions), so it stays inside whole-stage code generation and
never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CJK_CLASS, MAX_TEXT_CHARS, PUNCT_CLASS, SPACE_CLASS

# One regex class per kind (B5).  Built from the fixed ranges in constants.
CJK_RE = f"[{CJK_CLASS}]"
PUNCT_RE = f"[{PUNCT_CLASS}]"
SPACE_RE = f"[{SPACE_CLASS}]"
ISOLATE_RE = f"([{CJK_CLASS}{PUNCT_CLASS}])"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_chars(text, limit: int = MAX_TEXT_CHARS) -> Column:
    """B2: keep the first ``limit`` code points (service path only)."""
    return F.substring(_col(text), 1, limit)


def cut_at_nul(text) -> Column:
    """Text after the first U+0000 is ignored."""
    return F.substring_index(_col(text), "\u0000", 1)


def utf8_valid(text) -> Column:
    """Flag for the rejects branch (bytes or strings that are not UTF-8)."""
    return F.call_function("is_valid_utf8", _col(text))


def utf8_faults(text) -> Column:
    """struct(first_bad, n_bad) of a text's bytes: offset of the first bad byte
    (null: none) and their number.

    A lead byte with its one, two or three continuation bytes is a character;
    any other byte from 0x80 on is bad, and reading goes on with the next byte.
    Characters cannot overlap, so the bytes are read as characters U+0000 to
    U+00FF and every well-formed one is replaced by as many ASCII letters: what is
    left above U+007F is bad.
    """
    one = F.decode(_col(text).cast("binary"), "ISO-8859-1")
    for lead, n in (("\\xF0-\\xF7", 3), ("\\xE0-\\xEF", 2), ("\\xC0-\\xDF", 1)):
        one = F.regexp_replace(one, f"[{lead}][\\x80-\\xBF]{{{n}}}", "a" * (n + 1))
    bad = "[\\x80-\\xFF]"
    n_bad = F.length(F.regexp_replace(one, "[\\x00-\\x7F]+", ""))
    return F.struct(F.when(n_bad > 0, F.regexp_instr(one, F.lit(bad)) - 1).cast("long").alias("first_bad"),
                    n_bad.cast("long").alias("n_bad"))


def count_class(text, pattern: str) -> Column:
    """B5 helper: number of characters of one class in a text."""
    t = _col(text)
    return F.length(t) - F.length(F.regexp_replace(t, pattern, ""))


def basic_tokenize(text, max_chunks: int | None = None) -> Column:
    """Text -> chunks.

    Whitespace (space, tab, LF, CR, U+3000) separates chunks; every CJK
    ideograph and ASCII punctuation mark becomes a chunk of its own.  No lower
    casing, no accent stripping, non-ASCII punctuation stays attached.  Keeps
    at most ``max_chunks`` chunks (None = all).
    """
    t = cut_at_nul(text)
    spaced = F.regexp_replace(t, ISOLATE_RE, " $1 ")
    parts = F.split(spaced, f"{SPACE_RE}+")
    chunks = F.filter(parts, lambda x: x != F.lit(""))
    if max_chunks is not None:
        chunks = F.slice(chunks, 1, max_chunks)
    return chunks


def characters(word) -> Column:
    """A word as an array of single code points, in one pass."""
    return F.regexp_extract_all(_col(word), F.lit(r"(?s)."), F.lit(0))
