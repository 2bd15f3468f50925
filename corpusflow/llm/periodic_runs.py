"""Periodic run detection by a dictionary of basic factors.

For each power of two L every position gets the number of its factor of L words
(a pair of the numbers of its two halves).  Two successive occurrences at a
distance d <= L lie within 2L words; there, occurrences of a factor form an
arithmetic progression whose difference is its smallest period.  A stretch of
positions with the same successor distance d therefore proposes a run of period
d; the proposal is extended while words d apart agree, and proposals of several
levels are reduced to distinct runs.  A run of smallest period q and of at least
2q words holds a factor of L >= q words at its start and again q later, so the
level of the least L >= q finds it.

Numbers are given per document, a factor that occurs once in its document is
dropped with all longer ones that hold it, so ordinary prose ends after a few
levels.  Texts are worked off in slices of bounded size; a document is never
cut.  The tables of a document take some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import byte_list, crc32_of, give_back, row_slices, table

_SLICE_BYTES = 2 << 20            # text in work at a time

Run = tuple[int, int, int]        # start, length, period


def words_of(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text (``bytes.split`` knows ASCII white space only)."""
    return text.split()


def _stretches(at: np.ndarray, distance: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """``(first position, end, period)`` of the stretches of neighbouring positions
    (sorted) whose factor of ``size`` words comes back at the same distance."""
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(distance) != 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)] - 1
    start, period = at[first], distance[first]
    end = at[last] + size + period
    return zip(start.tolist(), end.tolist(), period.tolist())


def _extended(x: np.ndarray, lo: int, hi: int, start: int, end: int, period: int) -> tuple[int, int]:
    """A proposal carried on to both sides, within its document ``lo..hi``, while words ``period`` apart agree."""
    while start > lo and x[start - 1] == x[start - 1 + period]:
        start -= 1
    while end < hi and x[end] == x[end - period]:
        end += 1
    return start, end


def runs_of(docs: list[list], min_length: int = 24, min_repeats: int = 3) -> list[list[Run]]:
    """The runs of each document (a list of hashable words), by start, then period.

    A run is a stretch of smallest period q, at least ``max(min_length,
    min_repeats * q)`` words long, that cannot be extended.  ``min_repeats`` is
    3 or more: shorter squares need not hold a whole factor twice."""
    if min_repeats < 3:
        raise ValueError("min_repeats must be 3 or more")
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    number: dict = {}
    x = np.fromiter((number.setdefault(w, len(number)) for d in docs for w in d), np.int64, int(sizes.sum()))
    found: list[set[Run]] = [set() for _ in docs]
    most = int(sizes.max() // min_repeats) if len(sizes) else 0           # no longer period can matter
    doc = np.repeat(np.arange(len(docs)), sizes)
    at, key = np.arange(len(x)), doc * max(1, len(number)) + x
    names = np.full(len(x), -1, np.int64)
    size = 1
    while len(at):
        order = np.argsort(key, kind="stable")                            # equal factors, by position
        same = np.diff(key[order]) == 0
        here, there = at[order[:-1]][same], at[order[1:]][same]
        near = there - here <= min(size, most)
        here, distance = here[near], (there - here)[near]
        by_place = np.argsort(here)
        here, distance = here[by_place], distance[by_place]
        for start, end, period in _stretches(here, distance, size) if len(here) else ():
            d = int(doc[start])
            lo, hi = int(ends[d] - sizes[d]), int(ends[d])
            start, end = _extended(x, lo, hi, start, end, period)
            if end - start >= max(min_length, min_repeats * period):
                found[d].add((start - lo, end - start, period))
        if size >= most:
            break
        # factors twice as long: both halves must come back in their document
        again = np.r_[False, same] | np.r_[same, False]
        group = np.cumsum(np.r_[True, ~same])
        names.fill(-1)
        names[at[order[again]]] = group[again]
        at = np.sort(at[order[again]])
        at = at[at + size < len(x)]
        at = at[names[at + size] >= 0]
        key = names[at] * (len(x) + 1) + names[at + size]
        size *= 2
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in found]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest exact length / period (ties: smallest start, then period)."""
    def order(a: Run, b: Run) -> int:
        return b[1] * a[2] - a[1] * b[2] or a[0] - b[0] or a[2] - b[2]
    return min(runs, key=cmp_to_key(order)) if runs else None


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.struct([("runs", pa.list_(_RUN)), ("strongest", _RUN), ("text", pa.string())])
_RUN_DDL = "struct<start: long, length: long, period: long>"
_FOUND_DDL = f"struct<runs: array<{_RUN_DDL}>, strongest: {_RUN_DDL}, text: string>"


def _named(run: Run | None) -> dict | None:
    return run and dict(zip(("start", "length", "period"), run))


def _detector(min_length: int, min_repeats: int, words: Callable):
    def judge(ids: pa.Array, texts: pa.Array) -> pa.Array:
        docs = [words(i, t) if t else [] for i, t in zip(ids.to_pylist(), byte_list(texts))]
        runs = runs_of(docs, min_length, min_repeats)
        return pa.StructArray.from_arrays(
            [pa.array([[_named(r) for r in rs] for rs in runs], _FOUND[0].type),
             pa.array([_named(strongest(rs)) for rs in runs], _RUN),
             pa.array([b" ".join(collapsed(d, rs)) for d, rs in zip(docs, runs)], pa.binary()).cast(pa.string())],
            fields=list(_FOUND))

    def detect(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in columns:
            yield pa.concat_arrays([pa.array([], _FOUND)] + [
                judge(ids.slice(at, end - at), texts.slice(at, end - at)) for at, end in row_slices(texts, _SLICE_BYTES)])
        give_back()

    return detect


def detect_runs(docs: DataFrame, min_length: int = 24, min_repeats: int = 3, words: Callable = words_of) -> DataFrame:
    """``(row, found)``: every row of ``docs`` as a struct (so that no column name
    can clash) and ``found = (runs, strongest, text)``: its runs by start and
    period, the run of greatest exponent (null without runs) and the words left
    when each run is reduced to its first period, joined by one space.

    ``words(doc_id, text)`` cuts a text to its words.  A null or empty text has
    no words, no runs and an empty collapsed text; repeated rows and rows without
    doc_id are each judged alone; an empty table gives an empty one.
    """
    found = F.arrow_udf(_detector(min_length, min_repeats, words), _FOUND_DDL)
    return docs.select(F.struct("*").alias("row"), found(
        F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("found"))


def folded_words(doc_id: int | None, text: bytes) -> list[bytes]:
    """The words of a text; where crc32(doc_id) ends in 0, those from a place on
    repeat a period (the query's fold)."""
    words = text.split()
    h = 1 if doc_id is None else crc32_of(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    out = detect_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), words=folded_words)
    lines = F.transform("found.runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = F.col("found.strongest")
    return out.select(
        "row.doc_id", F.size("found.runs").cast("long").alias("n_runs"),
        best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("found.strongest.length * 1000 div found.strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("found.text"), 256).alias("collapsed_sha256"))
