"""Periodic runs against a brute force over all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

import __spark_entry__ as E
from corpusflow.llm import periodic_runs as P

SF = "/root/testdata/sf0.001"


def brute(x, min_length=24, min_repeats=3):
    """Runs by comparing every word with the one q behind it, for every q."""
    out = []
    n = len(x)
    for q in range(1, n // min_repeats + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            start, length = i, j - i + q
            i = j
            if length < max(min_length, min_repeats * q):
                continue
            if not any(all(x[k] == x[k + d] for k in range(start, start + length - d)) for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_docs(seed, n_docs=60):
    rnd = random.Random(seed)
    for _ in range(n_docs):
        doc = []
        while len(doc) < rnd.choice([3, 20, 90, 200]):
            block = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randint(1, 14))]
            doc += (block * rnd.randint(1, 7))[:rnd.randint(1, 80)]
        yield doc


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("least", [(24, 3), (9, 4), (1, 3)])
def test_runs_equal_brute_force(seed, least):
    docs = list(random_docs(seed))
    assert P.runs_of(docs, *least) == [brute(d, *least) for d in docs]


def test_nested_and_neighbouring_runs():
    inner = ["a"] * 30
    doc = (inner + ["b"]) * 4 + ["c"] + ["x", "y"] * 12
    assert P.runs_of([doc, [], ["a"], inner]) == [brute(doc), [], [], [(0, 30, 1)]]
    fib = ["a"], ["a", "b"]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    assert P.runs_of([fib[1]], 6, 3) == [brute(fib[1], 6, 3)]


def test_long_text_is_not_cut():
    doc = [str(i) for i in range(40_000)] + ["p", "q", "r"] * 30_000 + ["end"]
    assert P.runs_of([doc]) == [[(40_000, 90_000, 3)]]


def test_fewer_repeats_are_refused():
    with pytest.raises(ValueError):
        P.runs_of([["a"]], 4, 2)


def test_strongest_is_exact():
    big = 10 ** 17
    assert P.strongest([(0, big + 1, 3), (1, big + 2, 3), (5, 2 * (big + 2), 6), (2, big, 3)]) == (1, big + 2, 3)
    assert P.strongest([]) is None


def test_collapsed_keeps_first_period():
    doc = ["s"] + ["a", "b"] * 15 + ["t"]
    assert P.collapsed(doc, P.runs_of([doc])[0]) == ["s", "a", "b", "t"]


def expected_row(doc_id, text):
    x = (text or "").encode().split()
    n, h = len(x), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
    runs = brute(x)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    digest = [hashlib.sha256(v).hexdigest() for v in (
        "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode(),
        b" ".join(w for i, w in enumerate(x) if i not in gone))]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark):
    name = next(n for n in E.queries() if n.startswith("op13_"))
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in E.queries()[name](spark, SF).collect()}
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(got) == len(docs)
    for r in docs:
        if len((r.text or "").split()) < 1500:
            assert got[r.doc_id] == expected_row(r.doc_id, r.text)


def test_edge_rows_and_clashing_columns(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \t\n", "c", 3), (None, "x y " * 20, "d", 4), (4, "x y " * 20, "e", 5),
            (4, "x y " * 20, "e", 5), (5, "x " * 100_000 + "z", "f", 6), (6, "ab cd " * 24, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, runs int")
    got = P.detect_runs(docs)
    out = sorted(((r.row.doc_id or 0, [tuple(x) for x in r.found.runs], r.found.text) for r in got.collect()))
    assert out == [(0, [(0, 40, 2)], "x y"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 40, 2)], "x y"),
                   (4, [(0, 40, 2)], "x y"), (5, [(0, 100_000, 1)], "x z"), (6, [(0, 24, 1)], "ab cd")]
    assert P.detect_runs(docs.limit(0)).count() == 0
    assert got.select("row.*").columns == docs.columns
