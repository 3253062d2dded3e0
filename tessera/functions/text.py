"""Text column functions: the lossless word tokeniser, whitespace tests, detectors' patterns.

All patterns are written in the common subset of Java regex (Spark) and RE2 (the SQL
oracle), so both engines cut and match text identically. Python's ``\\w`` and ``isspace``
are Unicode-aware; the classes below spell that out instead of relying on a dialect flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (patterns).
# Whitespace exactly as Python's str.isspace() defines it.
WHITESPACE_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F\x{85}\p{Z}]"
# Lossless word tokeniser: group 1 = word, group 2 = one trailing space (or empty).
WORD_PATTERN = r"([\p{L}\p{N}_.+@-]+|\n+| +|(?s:.))( ?)"
# E-mail, matched against a whole word ("\w" written as [\p{L}\p{N}_]).
EMAIL_PATTERN = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
# Phone numbers, searched in the full text; group 1 is the number, a whitespace must follow.
# Digits are Unicode decimal digits.
PHONE_PATTERN = r"(\(\p{Nd}{3}\)\p{Nd}{3}\-\p{Nd}{4}[\p{L}\p{N}_]*|\p{Nd}{3}\.\p{Nd}{3}\.\p{Nd}{4})" + WHITESPACE_CLASS
# Same, also accepting one space after the area code: "(743) 555-3824".
PHONE_PATTERN_EXTENDED = (
    r"(\(\p{Nd}{3}\) ?\p{Nd}{3}\-\p{Nd}{4}[\p{L}\p{N}_]*|\p{Nd}{3}\.\p{Nd}{3}\.\p{Nd}{4})" + WHITESPACE_CLASS
)
# Identity numbers of the silver labels: a word of sixteen digits.
ID_NUM_PATTERN = r"\d{16}"
# ---------------------------------------------------------------------------


def full_match(col: Column, pattern: str) -> Column:
    """True when the whole string matches ``pattern`` (``\\z``: no slack before a final newline)."""
    return col.rlike("^(?:" + pattern + r")\z")


def is_blank(col: Column) -> Column:
    """Python ``str.isspace()``: non-empty and only whitespace.

    A word that begins with a visible ASCII character is told by that alone; the pattern is for the others.
    """
    return F.when(F.ascii(col).between(33, 126), F.lit(False)).otherwise(full_match(col, WHITESPACE_CLASS + "+"))


def word_matches(text: Column) -> Column:
    """Array of tokeniser matches (word plus its optional trailing space), in text order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def match_has_space(m: Column) -> Column:
    """Whether a tokeniser match carries a trailing space.

    A space run is a word of its own and never has a trailing space, so a match ends in a
    separator exactly when its last character is a space and the one before is not.
    """
    return m.endswith(" ") & ~m.endswith("  ") & (m != " ")


def match_word(m: Column) -> Column:
    """The word part of a tokeniser match."""
    return F.when(match_has_space(m), F.rtrim(m)).otherwise(m)


def detokenize(tokens: Column, trailing_whitespace: Column) -> Column:
    """Rebuild text: each token followed by one space where its flag is set."""
    return F.array_join(
        F.zip_with(tokens, trailing_whitespace,
                   lambda t, w: F.concat(t, F.when(w, F.lit(" ")).otherwise(F.lit("")))),
        "",
    )
