"""B2: heuristic conversion of a label column to 0/1, as one Column expression
chosen by the column's data type (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The label vocabularies the reference tests, in its order.
# A string label is positive when it contains any positive term (tested first),
# else negative when it contains any negative term.
POSITIVE_TERMS = ["hate", "hatespeech", "hate_speech", "toxic", "offensive", "abusive", "insult", "hs"]
NEGATIVE_TERMS = ["not_hate", "non-toxic", "clean", "neutral", "normal", "nonhate", "non-hate", "no"]


def _contains_any(s: Column, terms: list[str]) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | s.contains(t)
    return cond


def string_to_binary(c: Column, strict: bool = False) -> Column:
    """Rules for string labels.  ``strict=True`` tests the negative terms first
    (so ``"not_hate"`` -> 0); the default keeps the reference's order, where
    ``"not_hate"`` and ``"non-toxic"`` contain a positive term and map to 1."""
    s = F.lower(F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    pos, neg = _contains_any(s, POSITIVE_TERMS), _contains_any(s, NEGATIVE_TERMS)
    # all-digit strings: int(s) >= 1 iff some digit is non-zero (ASCII digits)
    digits = s.rlike(r"^[0-9]+$")
    numeric = F.when(digits & s.rlike(r"[1-9]"), 1).otherwise(0)
    first, second = (neg, pos) if strict else (pos, neg)
    first_v, second_v = (0, 1) if strict else (1, 0)
    return (F.when(c.isNull(), 0)
            .when(first, first_v)
            .when(second, second_v)
            .when(s.isin("none", "neutral", "clean"), 0)
            .when(digits, numeric)
            .otherwise(0))


def numeric_to_binary(c: Column) -> Column:
    """``int(v) >= 1`` (truncation toward zero); NaN / inf / null -> 0."""
    d = c.cast("double")
    bad = c.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, 0).when(d >= 1, 1).otherwise(0)


def to_binary_label(df: DataFrame, col: str, strict: bool = False) -> Column:
    """Pick the rule set from the column's type: bool, numeric, string, else 0."""
    dtype = df.schema[col].dataType
    c = F.col(col)
    if isinstance(dtype, T.BooleanType):
        out = F.coalesce(c.cast("int"), F.lit(0))
    elif isinstance(dtype, T.NumericType):
        out = numeric_to_binary(c)
    elif isinstance(dtype, T.StringType):
        out = string_to_binary(c, strict)
    else:
        out = F.lit(0)
    return out.cast("int")
