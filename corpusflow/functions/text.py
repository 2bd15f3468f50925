"""Text column expressions (JVM-side, whole-stage-codegen friendly).

Python's ``str.strip`` / ``str.split`` / ``\\s`` treat all Unicode white space
plus the information separators U+001C..U+001F as white space.  Spark's
``trim`` removes only U+0020, so every helper here uses an explicit Unicode
pattern instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.isspace() set, as a Java regex class (UNICODE_CHARACTER_CLASS).
WS_CLASS = r"[\s\x1c-\x1f]"
_STRIP_RE = r"(?U)^" + WS_CLASS + r"+|" + WS_CLASS + r"+$"
_WS_RUN_RE = r"(?U)" + WS_CLASS + r"+"
# str.splitlines() boundaries.
_LINE_BREAK_RE = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    """``str.strip()`` with Python's white-space set."""
    return F.regexp_replace(_c(col), _STRIP_RE, "")


def collapse_whitespace(col) -> Column:
    """Runs of white space -> one space, then strip."""
    return py_strip(F.regexp_replace(_c(col), _WS_RUN_RE, " "))


def content_hash(col) -> Column:
    """MD5 hex digest of the UTF-8 bytes."""
    return F.md5(_c(col))


def char_length(col) -> Column:
    """Length in code points (Python ``len``)."""
    return F.length(_c(col)).cast("bigint")


def is_long_enough(col, min_chars: int) -> Column:
    """A string of at least ``min_chars`` code points (null -> false)."""
    return F.coalesce(F.length(_c(col)) >= F.lit(min_chars), F.lit(False))


def split_lines(col) -> Column:
    """``text.split('\\n')`` — keeps empty pieces, including a trailing one."""
    return F.split(_c(col), "\n", -1)


def splitlines(col) -> Column:
    """``str.splitlines()`` — all line boundaries, no trailing empty piece."""
    parts = F.split(_c(col), _LINE_BREAK_RE, -1)
    # a final boundary does not open a new line
    return F.when(F.size(parts) > 0,
                  F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1))
                  .otherwise(parts)).otherwise(parts)


def word_tokens(col, lowercase: bool = True) -> Column:
    """``text.lower().split()`` as ARRAY<STRING>."""
    c = F.lower(_c(col)) if lowercase else _c(col)
    return F.array_remove(F.split(c, _WS_RUN_RE), "")          # built-in, no lambda


def char_tokens(col) -> Column:
    """One element per code point, case kept (empty text -> [])."""
    c = _c(col)
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.split(c, "", -1))


def clean_text(col, min_chars: int = 1) -> Column:
    """Strip; null when not a string of at least ``min_chars`` code points
    (``min_chars <= 1`` means non-empty)."""
    s = py_strip(col)
    return F.when(F.length(s) >= F.lit(max(1, min_chars)), s)


def clean_metric_name(col) -> Column:
    """Drop ``eval_``, then ``str.capitalize()``."""
    s = F.replace(_c(col), F.lit("eval_"), F.lit(""))
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))
