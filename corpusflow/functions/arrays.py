"""Score-array expressions: softmax, argmax, confidence, thresholding
(B13-B17, B25) — all higher-order functions, no UDF."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow.functions.text import py_strip


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def softmax(col) -> Column:
    """Numerically stable softmax of an ARRAY<DOUBLE>."""
    a = _c(col).cast("array<double>")
    m = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - m))
    total = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / total)


def argmax(col) -> Column:
    """Index of the largest value, first index on ties (0-based)."""
    a = _c(col)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def confidence(probs, pred) -> Column:
    """Probability of the predicted class."""
    return F.element_at(_c(probs), _c(pred) + 1)


def threshold_label(p_pos, threshold: float = 0.5) -> tuple[Column, Column]:
    """Positive iff ``p(pos) >= threshold``; confidence of the chosen label."""
    p = _c(p_pos)
    pred = F.when(p >= threshold, F.lit(1)).otherwise(F.lit(0))
    conf = F.when(p >= threshold, p).otherwise(1 - p)
    return pred, conf


def empty_input_default(text, probs, mode: str = "default") -> Column:
    """A blank text scores ``[1.0, 0.0]`` (``mode='default'``) or raises
    (``mode='error'``)."""
    blank = F.coalesce(py_strip(_c(text)) == "", F.lit(True))
    if mode == "error":
        return F.when(blank, F.raise_error(F.lit("Input text is empty"))).otherwise(_c(probs))
    return F.when(blank, F.array(F.lit(1.0), F.lit(0.0))).otherwise(_c(probs).cast("array<double>"))


def valid_predictions(*pred_cols: str, sentinel: int = -1) -> Column:
    """Every model produced a prediction (none equals the sentinel)."""
    cond = F.lit(True)
    for c in pred_cols:
        cond = cond & (F.col(c) != sentinel)
    return cond


def by_slices(function, *columns: pa.Array, size: int = 4 << 20) -> pa.Array:
    """``function`` of Arrow columns (the first holds text), given slices of about
    ``size`` bytes of that text each (a row at least), so that only so much of a batch
    stands as Python objects at a time."""
    column = columns[0]
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)])
    parts, at = [], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        parts.append(function(*[c.slice(at, end - at) for c in columns]))
        at = end
    return pa.concat_arrays(parts) if parts else function(*columns)
